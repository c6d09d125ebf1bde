"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .arrow_text import text_udf

#: Lengths of the character n-grams, and buckets that their hashes fall into.
GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
#: Texts and characters worked on at one time, so that long texts need bounded memory.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 64, 1 << 19
#: Learning reads at most so many documents, those with the least hashes of their ids.
SAMPLE_DOCS = 8_000

LETTER = regex.compile(r"\p{L}")
_FACTOR = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def gram_buckets(chars: np.ndarray) -> list[np.ndarray]:
    """Bucket of every n-gram of an array of code points, one array for each length."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out, key = [], np.zeros(len(chars), np.uint32)
    for n in GRAMS:
        if len(chars) < n:
            break
        key = (key[: len(chars) - n + 1] * _FACTOR[0]) ^ ((chars[n - 1 :] + np.uint32(n)) * _FACTOR[1])
        out.append(((key ^ (key >> np.uint32(15))) * _FACTOR[2]) >> shift)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _spans(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of characters that overlap, so that every n-gram begins in one of them."""
    for at in range(0, n, CHARS_AT_ONCE):
        yield at, min(n, at + CHARS_AT_ONCE)


def gram_counts(text: str) -> np.ndarray:
    """n-grams of the whole text in each bucket."""
    chars, total = code_points(text), np.zeros(BUCKETS, np.int64)
    for start, end in _spans(len(chars)):
        for n, buckets in zip(GRAMS, gram_buckets(chars[start : end + max(GRAMS) - 1])):
            total += np.bincount(buckets[: end - start], minlength=BUCKETS)
    return total


def log_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of weights[bucket] over all n-grams of each text: texts x languages.

    Texts are taken in batches of up to TEXTS_AT_ONCE and CHARS_AT_ONCE, a longer one in
    spans. The n-grams of a batch are counted by (text, bucket) in one pass; the counts that
    are not zero, a sparse matrix, are multiplied with the weights and summed by text.
    """
    out = np.zeros((len(texts), weights.shape[1]))
    batch: list[tuple[int, list[np.ndarray]]] = []

    def flush() -> None:
        keys = np.concatenate([place * BUCKETS + buckets for place, (_, parts) in enumerate(batch) for buckets in parts] or [np.zeros(0, np.int64)])
        counts = np.bincount(keys, minlength=0)
        there = np.flatnonzero(counts)
        if there.size:
            row = there // BUCKETS
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums = np.add.reduceat(counts[there, None] * weights[there % BUCKETS], first)
            np.add.at(out, [batch[k][0] for k in row[first]], sums)
        batch.clear()

    held = 0
    for number, text in enumerate(texts):
        chars = code_points(text)
        for start, end in _spans(len(chars)):
            if batch and (held + end - start > CHARS_AT_ONCE or len(batch) == TEXTS_AT_ONCE):
                flush()
                held = 0
            batch.append((number, [buckets[: end - start].astype(np.int64) for buckets in gram_buckets(chars[start : end + max(GRAMS) - 1])]))
            held += end - start
    flush()
    return out


def held_out(id_col: str, folds: int = 5):
    """Whether an id belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities: buckets x languages).

    Takes rows with a language outside the held-out fold, at most `sample` of them by the
    least hash of the id. Counts are summed in the workers and by a Spark aggregate, so only
    (languages x buckets) sums reach the driver.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = own.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    chosen = known.select(F.col("id").alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(sample)
    texts = known.join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                sums[lang] = sums.get(lang, 0) + gram_counts(text or "")
                seen[lang] = seen.get(lang, 0) + 1
        for lang, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.record_batch({"lang": [lang] * (len(full) + 1), "bucket": np.r_[full, -1], "n": np.r_[total[full], seen[lang]]})

    summed = texts.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(summed["lang"].to_pylist()))
    counts, docs_in = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for lang, bucket, n in zip(summed["lang"].to_pylist(), summed["bucket"].to_pylist(), summed["n"].to_pylist()):
        if bucket < 0:
            docs_in[langs.index(lang)] = n
        else:
            counts[bucket, langs.index(lang)] = n
    smoothed = counts + 0.5
    return langs, np.log((docs_in + 1) / (docs_in.sum() + len(langs))) if langs else docs_in, np.log(smoothed / smoothed.sum(axis=0))


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of `docs`.

    score is the probability of the predicted language. A text that is null or has no letter
    is `und` with score 0, and so is every text when there is nothing to learn from. Ties go
    to the language that sorts first. Rows with a null id are predicted, never learned from.
    Repeated ids keep their rows; other columns are not read; an empty table gives an empty
    result. The log-probability matrix has a fixed number of rows and a column for each
    language, and is broadcast.
    """
    langs, prior, weights = learn(docs, id_col, text_col, lang_col, sample)
    model = docs.sparkSession.sparkContext.broadcast((langs, prior, weights))

    def make():
        langs, prior, weights = model.value

        def work(texts: list[str]) -> list[tuple]:
            rows = [("und", 0.0)] * len(texts)
            scored = [k for k, t in enumerate(texts) if langs and LETTER.search(t)]
            totals = log_scores([texts[k] for k in scored], weights) + prior
            for k, total in zip(scored, totals):
                best = int(total.argmax())
                rows[k] = (langs[best], float(1 / np.exp(total - total[best]).sum()))
            return rows

        return work

    told = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), text_udf(make, lang_pred=pa.string(), score=pa.float64())(F.col(text_col)).alias("p"))
    return told.select(id_col, "held_out", "p.lang_pred", "p.score")
