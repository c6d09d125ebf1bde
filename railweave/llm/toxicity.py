"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .arrow_text import text_udf
from .durable import checkpointed

#: Learning reads at most so many labelled documents, those with the least hashes of their ids.
SAMPLE_DOCS = 12_000
#: Terms of the learned lexicon at most: those that tell most.
LEXICON_TERMS = 3_000
#: A term must be this many times likelier (natural logarithm) in toxic documents.
LEAST_ODDS = 2.5
#: Folds of crc32(id) mod 5: 0 is held out, of the others each is described by a lexicon of the rest, and each half calibrates trees of the other.
HELD_OUT, FOLDS, HALVES = 0, (1, 2, 3, 4), ((1, 2), (3, 4))

WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Pronouns of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer ti tus usted ustedes vosotros".encode().split())
OBFUSCATED = re.compile(rb"[a-z][@$*!0-9]+[a-z]")
#: A lexicon word counts as said to someone with such a pronoun at most so many words away.
NEAR = 6
PREFIXES = (4, 5)


def terms(word: bytes) -> list[bytes]:
    """The lexicon terms that a word can hit: itself, and its longer beginnings marked by a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    """Dense features of a whole text; zeros for one without words."""
    words = words_of(text)
    n, raw = len(words) or 1, text.encode("utf-8", "surrogatepass")
    size = len(raw) or 1
    hits: dict[bytes, float] = {}
    stems: dict[bytes, float] = {}
    counts = Counter(words)
    for word in counts:
        if word in lexicon:
            hits[word] = lexicon[word]
        for k in PREFIXES:
            if len(word) > k and (w := lexicon.get(word[:k] + b"*")):
                stems[word] = max(w, stems.get(word, 0.0))
    n_hits, n_stems = sum(counts[w] for w in hits), sum(counts[w] for w in stems)
    said = 0
    if hits or stems:
        people = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        at = 0
        for k, word in enumerate(words):
            if word in hits or word in stems:
                while at < len(people) and people[at] < k - NEAR:
                    at += 1
                said += at < len(people) and people[at] <= k + NEAR
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        n_hits / n,
        math.log1p(n_hits),
        n_stems / n,
        math.log1p(n_stems),
        max([0.0, *hits.values()]),
        max([0.0, *stems.values()]),
        sum(w * counts[k] for k, w in hits.items()) + sum(w * counts[k] for k, w in stems.items()),
        said / (n_hits + n_stems) if n_hits + n_stems else 0.0,
        math.log1p(said),
        capitals / size,
        (raw.count(b"!") + raw.count(b"?")) / size,
        (size - len(raw.translate(None, b".,;:-'\"()"))) / size,
        len(OBFUSCATED.findall(text.lower().encode("utf-8", "surrogatepass"))) / n,
        math.log1p(len(words)),
    ]


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, toxic, clean by fold): documents that have each term, from rows (toxic, fold, text), summed by Spark; the empty term counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for toxic, fold_, text in zip(*(batch[c].to_pylist() for c in ("toxic", "fold", "text"))):
                own = sums.setdefault((fold_, toxic), Counter())
                own.update({t for w in set(words_of(text or "")) for t in terms(w)})
                own[b""] += 1
        for (fold_, toxic), counts in sums.items():
            told = list(counts.items())
            for at in range(0, len(told), 50_000):
                part = told[at : at + 50_000]
                yield pa.record_batch({"term": pa.array([t for t, _ in part], pa.binary()), "fold": pa.array([fold_] * len(part), pa.int64()), "toxic": pa.array([n * toxic for _, n in part], pa.int64()), "clean": pa.array([n * (1 - toxic) for _, n in part], pa.int64())})

    made = texts.mapInArrow(count, "term binary, fold bigint, toxic bigint, clean bigint")
    return checkpointed(made.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in FOLDS for c in ("toxic", "clean"))))


def _lexicon(counts: DataFrame, folds: tuple[int, ...]) -> dict[bytes, float]:
    """Log odds of the terms that tell most, from the documents of the given folds."""
    lexicon: dict[bytes, float] = {}
    over = lambda c: sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}"))
    summed = counts.select("term", over("toxic").alias("toxic"), over("clean").alias("clean"))
    docs = summed.where(F.length("term") == 0).first()
    if not docs or not docs["toxic"]:
        return lexicon
    odds = F.log((F.col("toxic") + 0.5) / (docs["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (docs["clean"] + 1))
    least = max(2, min(6, docs["toxic"] // 80 + 2))
    telling = summed.where((F.length("term") > 1) & (F.col("toxic") >= least)).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS)
    return lexicon | {bytes(r["term"]): r["w"] for r in telling.orderBy((F.col("w") * F.col("toxic")).desc(), "term").limit(LEXICON_TERMS).collect()}


def _dense(lexicon: dict[bytes, float], text_col: str):
    udf = text_udf(lambda: lambda texts: [(features(t, lexicon),) for t in texts], dense=pa.list_(pa.float64()))
    return array_to_vector(udf(F.col(text_col))["dense"])


class Scorer:
    """A learned lexicon, trees of each half and their calibration; or a score that all texts get, if there was nothing to tell apart."""

    def __init__(self, lexicon: dict[bytes, float], trees=(), shape=None, constant: float = 0.0):
        self.lexicon, self.trees, self.shape, self.constant = lexicon, trees, shape, constant

    def scored(self, rows: DataFrame, text_col: str) -> DataFrame:
        """(row, told): the rows as structs, each scored where it lies, by the mean of all trees."""
        packed = rows.select(F.struct("*").alias("row"), *([_dense(self.lexicon, text_col).alias("features")] if self.trees else []))
        if not self.trees:
            return packed.withColumn("told", F.lit(self.constant))
        for k, trees in enumerate(self.trees):
            packed = _likely(trees, packed, f"raw{k}")
        told = self.shape.transform(packed.withColumn("raw", sum((F.col(f"raw{k}") for k in range(1, len(self.trees))), F.col("raw0")) / len(self.trees)))
        return told.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("told"))


def _likely(trees, frame: DataFrame, into: str = "raw") -> DataFrame:
    """`frame` with the trees' probability of class 1."""
    told = trees.copy().setProbabilityCol("p").setRawPredictionCol("r").setPredictionCol("d").transform(frame)
    return told.withColumn(into, vector_to_array("p")[1]).drop("p", "r", "d")


def _trees(rows: DataFrame):
    return GBTClassifier(maxDepth=3, maxIter=15, stepSize=0.3, minInstancesPerNode=2, seed=11).fit(rows)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> Scorer:
    """A scorer from at most `sample` labelled rows outside fold 0, those of the least hashes of their ids.

    All of them teach each part, by cross-fitting: a row's features come from a lexicon of
    the other folds; each half of the folds teaches trees, which score the other half; the
    isotonic calibration learns from those scores of all rows. Where a half lacks a class,
    one set of trees learns from all rows. New texts meet the lexicon of all folds and the
    mean of both trees. Of several labels for an id the larger counts; null ids are never
    learned from. The texts of the sample are written once, and everything is learned from those.
    """
    taught = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_chosen")).agg(F.max(label_col).cast("int").alias("toxic"))
    taught = taught.withColumn("fold", fold("_chosen")).where(F.col("fold") != HELD_OUT).orderBy(F.xxhash64("_chosen"), "_chosen").limit(sample)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = checkpointed(own.join(F.broadcast(taught), F.col("id") == F.col("_chosen")).select("toxic", "fold", "text"))
    there = {(r["fold"], r["toxic"]) for r in texts.select("fold", "toxic").distinct().collect()}
    classes = {y for _, y in there}
    if len(classes) < 2:
        return Scorer({}, constant=float(max(classes, default=0)))
    counts = _term_counts(texts)
    described = None
    for f in FOLDS:
        part = texts.where(F.col("fold") == f).select(F.col("toxic").cast("double").alias("label"), "fold", _dense(_lexicon(counts, tuple(x for x in FOLDS if x != f)), "text").alias("features"))
        described = part if described is None else described.unionByName(part)
    known = checkpointed(described).coalesce(4)
    halves = [known.where(F.col("fold").isin(*half)) for half in HALVES]
    whole = all(any((f, y) in there for f in half) for half in HALVES for y in classes)
    trees = [_trees(half) for half in halves] if whole else [_trees(known)]
    scored = [_likely(trees[1 - k if whole else 0], half).select("raw", "label") for k, half in enumerate(halves)]
    shape = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(scored[0].unionByName(scored[1]))
    return Scorer(_lexicon(counts, FOLDS), trees, shape)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`; score is a calibrated probability.

    Without both classes among the labels the score is the one label there is, or 0. Null
    and empty texts are scored as texts without words; null ids are scored and never learned
    from. Repeated ids keep their rows; other columns are not read; an empty table gives an
    empty result.
    """
    scorer = learn(docs, labels, id_col, text_col, label_col, sample)
    scored = scorer.scored(docs.select(F.col(id_col), F.col(text_col)), text_col).select(F.col("row")[id_col].alias(id_col), F.col("told").alias("score"))
    held = F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    return scored.select(id_col, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they were; each row is judged by its own text, without a join."""
    return learn(docs, labels, id_col, text_col).scored(docs, text_col).where("told < 0.5").select("row.*")
