"""Ranked lexical search: documents at a time over compressed postings, shard by shard.

A shard holds some thousand documents, numbered in the order of their ids. The postings of
a term are sorted by that number and packed in blocks: gaps and frequencies in the fewest
bytes that the block needs. A query opens a cursor on each of its terms and keeps the
cursors in a heap by document; the documents come up in order, each is scored when all
cursors that stand on it are known, and a heap of the k best, by score and then document,
is kept. Terms whose greatest scores together cannot lift a document into that heap stay
out of the merge and are only looked up, so the result is exact. A second ranking over the
k best of each shard gives the whole.
"""

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import written
from .arrow_text import held, text_udf

#: Documents of a shard, about.
SHARD_DOCS = 4_096
#: Postings of a block.
BLOCK_POSTINGS = 256
#: Distinct query terms of one pass over the documents.
BLOCK_TERMS = 200_000
#: Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_SHARE, LENGTH_FACTOR = 1000, 1_000_000_000, 1000, 25, 12

#: A-Z to lower case; bytes of terms (digits, letters and all that is not ASCII) stay; all others part terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text, as UTF-8, in order; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return width, values.astype(f"<u{width}").tobytes()


class Postings:
    """A term's documents and frequencies in packed blocks of gaps, with the last document of each block."""

    def __init__(self, docs: np.ndarray, tfs: np.ndarray):
        self.size, self.blocks = len(docs), []
        self.lasts = docs[BLOCK_POSTINGS - 1 :: BLOCK_POSTINGS].tolist() + ([int(docs[-1])] if len(docs) % BLOCK_POSTINGS else [])
        before = 0
        for at in range(0, len(docs), BLOCK_POSTINGS):
            some = docs[at : at + BLOCK_POSTINGS].astype(np.int64)
            self.blocks.append((before, *_narrow(np.diff(some, prepend=before)), *_narrow(tfs[at : at + BLOCK_POSTINGS])))
            before = int(some[-1])

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        before, gap_width, gaps, tf_width, tfs = self.blocks[k]
        return np.cumsum(np.frombuffer(gaps, f"<u{gap_width}").astype(np.int64)) + before, np.frombuffer(tfs, f"<u{tf_width}").astype(np.int64)


class Cursor:
    """Walks a term's postings in order of documents; a posting's value is its share of the score."""

    def __init__(self, postings: Postings, factor: int, lengths: np.ndarray):
        self.postings, self.factor, self.lengths, self.k, self.at = postings, factor, lengths, -1, 0
        self.docs: list[int] = []
        self.values: list[int] = []

    def _open(self, k: int) -> None:
        docs, tfs = self.postings.block(k)
        self.values = (self.factor * (TF_SCALE * tfs // (TF_UNIT * tfs + LENGTH_FACTOR * self.lengths[docs]))).tolist()
        self.docs, self.k, self.at = docs.tolist(), k, 0

    def next(self) -> int | None:
        """The document of the next posting, None at the end."""
        self.at += 1
        if self.at >= len(self.docs):
            if self.k + 1 >= len(self.postings.blocks):
                return None
            self._open(self.k + 1)
        return self.docs[self.at]

    def value_of(self, doc: int) -> int:
        """The value of `doc`, 0 if it has none; for documents that are asked in rising order. Blocks before it are not unpacked."""
        lasts = self.postings.lasts
        if self.k < 0 or lasts[self.k] < doc:
            k = bisect_left(lasts, doc, max(self.k, 0))
            if k == len(lasts):
                return 0
            self._open(k)
        self.at = bisect_left(self.docs, doc, self.at)
        return self.values[self.at] if self.at < len(self.docs) and self.docs[self.at] == doc else 0


class Shard:
    """Postings of some documents: `doc` numbers rise with the order of results among equal scores."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, words: np.ndarray, tfs: np.ndarray):
        """lengths: `m` of each document; docs, words, tfs: one entry for each term of a document."""
        order = np.lexsort((docs, words))
        docs, words, tfs = docs[order], words[order], tfs[order]
        found, begins = np.unique(words, return_index=True)
        ends = np.append(begins[1:], len(words))
        self.lengths = lengths
        self.postings = {int(w): Postings(docs[a:b], tfs[a:b]) for w, a, b in zip(found, begins.tolist(), ends.tolist())}
        #: The greatest share of a score that a posting of the term has, at factor 1.
        shares = TF_SCALE * tfs // (TF_UNIT * tfs + LENGTH_FACTOR * lengths[docs]) if len(docs) else docs
        self.greatest = {int(w): int(x) for w, x in zip(found, np.maximum.reduceat(shares, begins) if len(begins) else [])}

    def search(self, factors: dict[int, int], k: int) -> list[tuple[int, int]]:
        """(score, document) of the best k with a score above 0, greatest first, then by document.

        factors: weight times repeats of each query term; terms without weight add nothing.
        """
        some = sorted((f * self.greatest[w], w) for w, f in factors.items() if f > 0 and w in self.postings)
        cursors = [Cursor(self.postings[w], factors[w], self.lengths) for _, w in some]
        #: What the terms up to each, of the least bounds, can add together.
        reach = [0]
        for bound, _ in some:
            reach.append(reach[-1] + bound)
        best: list[tuple[int, int]] = []  # (score, -document): the least is the worst of the best
        floor, aside = 0, 0  # a document needs more than `floor`; terms before `aside` are only looked up
        heap = [(doc, c) for c in range(len(cursors)) if (doc := cursors[c].next()) is not None]
        heapq.heapify(heap)
        while heap:
            doc, score = heap[0][0], 0
            while heap and heap[0][0] == doc:
                c = heap[0][1]
                cursor = cursors[c]
                if c < aside:  # set aside since it was put here
                    heapq.heappop(heap)
                    continue
                score += cursor.values[cursor.at]
                following = cursor.next()
                if following is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (following, c))
            for c in range(aside - 1, -1, -1):
                if score + reach[c + 1] <= floor:
                    break
                score += cursors[c].value_of(doc)
            else:
                # Later documents lose ties, so only a greater score displaces the worst.
                if score > floor:
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -doc))
                    if len(best) == k:
                        floor = best[0][0]
                        while aside < len(cursors) and reach[aside + 1] <= floor:
                            aside += 1
        return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, dict[bytes, int], list[dict[int, int]]]]:
    """(item ids, number of each term, repeats by term of each item), so many items at a time that BLOCK_TERMS bounds their distinct terms."""
    ids, numbers, asked = [], {}, []
    for item, text in items.select(id_col, text_col).toLocalIterator():
        counts = Counter(terms(text))
        if ids and len(numbers) + len(counts) > BLOCK_TERMS:
            yield ids, numbers, asked
            ids, numbers, asked = [], {}, []
        ids.append(item)
        asked.append({numbers.setdefault(t, len(numbers)): n for t, n in counts.items()})
    if ids:
        yield ids, numbers, asked


def postings_table(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, id, n, words, tfs) for each row of `docs` with a term: all its terms counted, and those of `numbers` with their frequencies.

    Written, as statistics and search both read it. Rows are dealt to shards by a draw, so
    no id and no text makes a shard large.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))

    def make():
        held(__name__)

        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                found = terms(text)
                counts = Counter(found)
                told = {numbers[t]: n for t, n in counts.items() if t in numbers}
                rows.append((len(found), list(told), list(told.values())))
            return rows

        return work

    told = text_udf(make, n=pa.int64(), words=pa.list_(pa.int64()), tfs=pa.list_(pa.int64()))
    rows = docs.select(F.floor(F.rand(11) * shards).cast("int").alias("shard"), F.col(id_col).cast("bigint").alias("id"), told(F.col(text_col)).alias("t"))
    return written(rows.select("shard", "id", "t.n", "t.words", "t.tfs").where("n > 0"))


def _shard_search(n_docs: int, n_terms: int, factors: list[dict[int, int]], k: int):
    """A function from the rows of a shard to the best k for each query."""

    def run(rows: pa.Table) -> pa.Table:
        held(__name__)
        ids = rows.column("id").combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid())))  # rows without an id first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = rows.column("n").to_numpy()
        lengths = np.empty(len(order), np.int64)
        lengths[place] = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
        words, tfs = rows.column("words").combine_chunks(), rows.column("tfs").combine_chunks()
        sizes = np.diff(words.offsets.to_numpy())
        shard = Shard(lengths, np.repeat(place, sizes), words.flatten().to_numpy(), tfs.flatten().to_numpy())
        found = [(item, score, doc) for item, asked in enumerate(factors) for score, doc in shard.search(asked, k)]
        docs = ids.take(pa.array([order[doc] for _, _, doc in found], pa.int64()))
        return pa.table({"item": pa.array([x[0] for x in found], pa.int64()), "score": pa.array([x[1] for x in found], pa.int64()), "doc": docs})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, id, score): the k rows of `docs` with the highest scores above 0 for each row of `items`, by its own text column `text_col`.

    A score sums, over the terms of the item with their repeats, the term's weight times
    (10^9 tf) div (1000 tf + 12 m); weights and m come from counts over all of `docs`.
    Ranks count from 1; equal scores go by rising id, rows without an id first. Items are
    taken in blocks of at most BLOCK_TERMS distinct terms (an item with more is a block of
    its own), each with one pass over the documents; only a block, its terms' document
    counts and two sums are ever on the driver. Null and empty texts have no terms: such
    documents are nowhere, such items have no rows. Repeated rows of either table keep their
    own ranks; other columns are not read; an empty table gives an empty result. Numbers are
    64-bit: terms of one document times documents must stay under 3 x 10^17.
    """
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} bigint, score bigint")
    for ids, numbers, asked in _blocks(items, item_col, text_col):
        table = postings_table(docs, numbers, id_col, text_col)
        n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = {r["word"]: r["df"] for r in table.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
        factors = [{w: n * weight(n_docs, df[w]) for w, n in counts.items() if w in df} for counts in asked]
        found = table.groupBy("shard").applyInArrow(_shard_search(n_docs, n_terms, factors, k), "item bigint, score bigint, doc bigint")
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc")))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, {item_col} {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select(item_col, "rank", F.col("doc").alias(id_col), "score"))
    return out
