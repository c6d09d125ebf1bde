"""Token counts of whole texts, as the tokenizer's own library gives them."""

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import held, text_udf
from .segments import parts

#: A batch for the library has about so many bytes, so batches cost alike whatever texts are in them.
BATCH_BYTES = 1 << 20
#: For tokenizers without a known word boundary, texts are cut near this many characters.
LONG_TEXT = 1 << 16
#: Distinct words remembered in a generation, characters of them in all, and the longest word remembered.
MEMO_WORDS, MEMO_CHARS, MEMO_LONGEST = 300_000, 4_000_000, 48
#: A place that no rule of the supported tokenizers looks across: one space between ASCII letters or digits.
PLAIN_GAP = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def balanced(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of consecutive texts of about `limit` bytes; a longer text has a list of its own."""
    batch, held = [], 0
    for text in texts:
        n = len(text.encode("utf-8", "surrogatepass"))
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += n
    if batch:
        yield batch


def _chunks(text: str, drop_gap: bool) -> list[str]:
    """`text` cut at plain gaps near every LONG_TEXT characters; drop_gap: the space goes with the cut."""
    out, at = [], 0
    while len(text) - at > LONG_TEXT:
        gap = PLAIN_GAP.search(text, at + LONG_TEXT)
        if not gap:
            break
        out.append(text[at : gap.start()])
        at = gap.end() if drop_gap else gap.start()
    return [*out, text[at:]]


class Known:
    """Lengths of strings seen before, in two generations so that common ones stay.

    Strings over MEMO_LONGEST characters (texts without spaces are one) are measured for a
    batch and then forgotten, so what is held has a bound of its own, whatever the texts are.
    """

    def __init__(self, measure: Callable[[list[str]], list[int]]):
        self.measure, self.young, self.old, self.held = measure, {}, {}, 0

    def learn(self, seen: set[str]) -> list[str]:
        """Afterwards `young` has all of `seen`; the long ones among them, to be forgotten when the batch is done."""
        new = [x for x in seen if x not in self.young]
        size = sum(map(len, new))
        if len(self.young) + len(new) > MEMO_WORDS or self.held + size > MEMO_CHARS:
            self.old, self.young, self.held = self.young, {}, 0
            new = list(seen)
        known = [x for x in new if x in self.old]
        self.young.update((x, self.old[x]) for x in known)
        new = [x for x in new if x not in self.old]
        self.young.update(zip(new, self.measure(new)))
        long = [x for x in new if len(x) > MEMO_LONGEST]
        self.held += sum(map(len, known)) + sum(map(len, new)) - sum(map(len, long))
        return long

    def forget(self, long: list[str]) -> None:
        for x in long:
            del self.young[x]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts for a list of texts by the tokenizer file at `path`; one for each worker process.

    .json: the tokenizers library, no added special tokens, no truncation or padding; the
    strings of special tokens inside texts are special tokens, its default. .model: the
    sentencepiece library without begin and end.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        encode, words, drop = (lambda batch: map(len, model.encode(batch, num_threads=1))), False, True
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split = told.get("pre_tokenizer") or {}
        # A special token may hold no white space, else a cut could fall into it.
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer") and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"])
        tokenizer, drop = Tokenizer.from_file(path), False
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda batch: map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))

    def lengths(texts: Iterable[str]) -> list[int]:
        return [n for batch in balanced(texts) for n in encode(batch)]

    if not words:

        def count(texts: list[str]) -> list[int]:
            cut = [_chunks(t, drop) for t in texts]
            each = iter(lengths(x for chunks in cut for x in chunks))
            return [sum(next(each) for _ in chunks) for chunks in cut]

        return count

    feed = lengths(["\n"])[0]
    heads_known, tails_known = Known(lambda new: lengths(new)), Known(lambda new: lengths(" " + x for x in new))

    def count(texts: list[str]) -> list[int]:
        out = []
        for batch in balanced(texts):
            cut = [parts(t) for t in batch]
            long = [heads_known.learn({x for heads, _, _ in cut for x in heads}), tails_known.learn({x for _, tails, _ in cut for x in tails})]
            head, tail = heads_known.young.__getitem__, tails_known.young.__getitem__
            out += [sum(map(head, heads)) + sum(map(tail, tails)) + feed * feeds for heads, tails, feeds in cut]
            heads_known.forget(long[0])
            tails_known.forget(long[1])
        return out

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    tokenizer: path of a tokenizer file that every worker has, as it is installed with the
    Python environment. Only lengths leave the Arrow function. Distinct words of a batch are
    encoded once, in batches of equal bytes; a text without a safe boundary is encoded
    whole. Null or empty text: 0 bytes, 0 tokens. Null and repeated ids keep their rows;
    other columns are not read; an empty table gives an empty result.
    """

    def make():
        held(__name__, counter.cache_clear)
        count = counter(tokenizer)
        return lambda texts: [(n,) for n in count(texts)]

    udf = text_udf(make, n=pa.int64())
    told = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), udf(F.col(text_col)).alias("t"))
    return told.select(id_col, "n_bytes", F.col("t.n").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
