"""Benchmark passages in training text, found by a generalised suffix automaton over words."""

from fractions import Fraction
from itertools import chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrow_text import held, text_udf
from .durable import checkpointed

#: Lower-cases A-Z and blanks the ASCII characters that are not letters or digits; the bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of benchmark items in one automaton, about; more items make more passes, each with one automaton.
BLOCK_WORDS = 500_000
#: Longer items are cut into pieces of so many words, so that blocks are of even size.
PIECE_WORDS = 20_000
NOBODY: frozenset = frozenset()


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ")


def split_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


class ItemAutomaton:
    """Suffix automaton of all item word lists; items of fewer than `window` words count whole."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = 13):
        self.window = window
        lists = [(item, words) for item, text in items if (words := split_words(text))]
        self.word_id = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in lists for w in words))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.word_id[w] for w in words]) for item, words in lists]
        for _, ids in coded:
            last = 0
            for word in ids:
                last = self._extended(last, word)
        #: Items that have the window which a state stands for at length `window`.
        self.windows: dict[int, set[str]] = {}
        #: Short items that are the longest suffix of some length of a state: state -> length -> items.
        self.whole: dict[int, dict[int, set[str]]] = {}
        for item, ids in coded:
            if len(ids) < window:
                state = 0
                for word in ids:
                    state = self.step[state][word]
                self.whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
            else:
                state = length = 0
                for k, word in enumerate(ids):
                    state, length = self.follow(state, length, word)
                    if k >= window - 1:
                        self.windows.setdefault(state, set()).add(item)
        self.short = bool(self.whole)
        #: The nearest state with short items among each state and its ever shorter suffixes; -1: none.
        self.near = [-1] * len(self.step)
        for state in sorted(range(len(self.step)), key=self.length.__getitem__):
            self.near[state] = state if state in self.whole else self.near[self.link[state]] if state else -1
        #: The fewest words of anything that counts, and the gate over so many (at most 4) words.
        least = min([window, *(n for by in self.whole.values() for n in by)], default=window)
        self.gram = min(4, least)
        self.gate = np.zeros(1 << 22, bool)
        for _, ids in coded:
            self.gate[self._grams(np.array(ids, np.int64))] = True

    def _extended(self, last: int, word: int) -> int:
        """The state after one more word behind `last`; a word list that is there already makes no new states."""
        step, link, length = self.step, self.link, self.length

        def cloned(above: int, old: int) -> int:
            new = len(step)
            step.append(dict(step[old]))
            link.append(link[old])
            length.append(length[above] + 1)
            link[old] = new
            while above >= 0 and step[above].get(word) == old:
                step[above][word] = new
                above = link[above]
            return new

        if (there := step[last].get(word)) is not None:
            return there if length[there] == length[last] + 1 else cloned(last, there)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while last >= 0 and word not in step[last]:
            step[last][word] = new
            last = link[last]
        if last >= 0:
            there = step[last][word]
            link[new] = there if length[there] == length[last] + 1 else cloned(last, there)
        return new

    def follow(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length, `window` at most, of the longest match that ends with `word`.

        A match is cut to its last `window` words before the next word, so that each word
        climbs a bounded number of links, however long and repetitive the text is.
        """
        while state and word not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        if word not in self.step[state]:
            return 0, 0
        state, length = self.step[state][word], length + 1
        if length > self.window:
            length = self.window
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state, length

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < self.gram:
            return np.zeros(0, np.int64)
        key = np.zeros(len(ids) - self.gram + 1, np.uint64)
        for k in range(self.gram):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(key)].astype(np.uint64) + np.uint64(1)
        return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, end exclusive; items with an occurring window, but for those without an id).

        Words are streamed through the automaton wherever the word grams of the gate occur
        without a break; elsewhere no match can be as long as anything that counts.
        """
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter(map(self.word_id.get, words, repeat(-1)), np.int64, len(words))
        hit = self.gate[self._grams(ids)]
        if not hit.any():
            return spans, items
        edge = np.diff(np.r_[0, hit.view(np.int8), 0])
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            state = length = 0
            for at, word in enumerate(ids[start : end + self.gram - 1].tolist(), start):
                state, length = self.follow(state, length, word)
                if length == self.window:
                    items |= self.windows.get(state, NOBODY)
                    self._mark(spans, at + 1 - length, at + 1)
                if self.short and length:
                    up = self.near[state]
                    while up > 0:  # short items that end here have different lengths, so under `window` steps
                        for n, found in self.whole[up].items():
                            if n <= length:
                                items |= found
                                self._mark(spans, at + 1 - n, at + 1)
                        up = self.near[self.link[up]]
        items.discard(None)
        return spans, items

    @staticmethod
    def _mark(spans: list[tuple[int, int]], start: int, end: int) -> None:
        """Adds a span to an ordered list of spans; it ends last of all."""
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of the spans and what stands between them; a line feed where each span was."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    blank = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) == 32
    edge = np.diff(np.r_[1, blank.view(np.int8), 1])
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"\n".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


#: The automaton that this worker used last, by the mark of its block: only one is held.
_LAST: dict[str, ItemAutomaton] = {}


def _automaton(mark: str, items: list, window: int) -> ItemAutomaton:
    if mark not in _LAST:
        _LAST.clear()
        _LAST[mark] = ItemAutomaton(items, window)
    return _LAST[mark]


def item_table(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, item, text) of the benchmark's distinct pieces, and the number of blocks of about BLOCK_WORDS words.

    A piece has PIECE_WORDS words and the `window` - 1 next ones, so each window of an item
    is in one of its pieces. Only the sum of their sizes comes to the driver.
    """
    cut = text_udf(lambda: lambda texts: [(_pieces(t, window),) for t in texts], pieces=pa.list_(pa.string()))
    parts = checkpointed(benchmark.select(F.col(id_col).cast("string").alias("item"), F.explode(cut(F.col(text_col))["pieces"]).alias("text")).distinct())
    total = parts.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    return parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1)))), blocks


def _pieces(text: str, window: int) -> list[str]:
    words = [w.decode("utf-8", "surrogatepass") for w in split_words(text)]
    return [" ".join(words[k : k + PIECE_WORDS + window - 1]) for k in range(0, max(len(words) - window + 1, 1), PIECE_WORDS)] if words else []


def _finder(session: SparkSession, items: list, window: int):
    """UDF from a text to its n_words, n_hit, spans (start, end, start, ... in words) and items, by one block of items."""
    block, mark = session.sparkContext.broadcast(items), uuid4().hex

    def make():
        held(__name__, _LAST.clear)
        automaton = _automaton(mark, block.value, window)

        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                words = split_words(text)
                spans, found = automaton.match(words) if words else ([], set())
                rows.append((len(words), sum(b - a for a, b in spans), list(chain(*spans)), sorted(found)))
            return rows

        return work

    return text_udf(make, n_words=pa.int64(), n_hit=pa.int64(), spans=pa.list_(pa.int64()), items=pa.list_(pa.string()))


@F.arrow_udf(T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))]))
def _union(lists: pa.Array) -> pa.Array:
    """Spans of several blocks, one list after the other, as spans that neither meet nor overlap, and their words."""
    rows = []
    for flat in lists.to_pylist():
        spans: list[tuple[int, int]] = []
        for a, b in sorted(zip(flat[::2], flat[1::2])):
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        rows.append({"n_hit": sum(b - a for a, b in spans), "spans": list(chain(*spans))})
    return pa.array(rows, pa.struct([("n_hit", pa.int64()), ("spans", pa.list_(pa.int64()))]))


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, keep: list[str] | None = None) -> DataFrame:
    """(row, told): the rows of `docs` as structs of the columns `keep` (all, if None), and n_words, n_hit, n_items, items_sha256, items and spans (start, end, start, ... in words) of each.

    A benchmark of one block is sent to all workers and matched where the texts lie. Of a
    larger one each block has a pass of its own, so a worker holds one automaton at a time
    and the driver one block; a pass keeps the distinct texts that it hits, by their SHA-256,
    these are merged by an aggregate and joined to the rows by the same key.
    """
    parts, blocks = item_table(benchmark, window, item_col, item_text)
    block = lambda k: sorted(((r["item"], r["text"]) for r in parts.where(F.col("block") == k).select("item", "text").collect()), key=lambda r: (r[0] is None, r))
    session, text, row = docs.sparkSession, F.col(text_col), F.struct(*(keep or docs.columns)).alias("row")
    if blocks <= 1:
        found = docs.select(row, _finder(session, block(0) if blocks else [], window)(text).alias("f")).select("row", "f.*")
    else:
        key, hits = F.sha2(F.coalesce(text, F.lit("")), 256).alias("key"), None
        for k in range(blocks):
            one = docs.select(key, _finder(session, block(k), window)(text).alias("f")).where("f.n_hit > 0").select("key", "f.spans", "f.items").dropDuplicates(["key"])
            hits = checkpointed(one) if hits is None else hits.unionByName(checkpointed(one))
        # Stored, so that the join has plain exchanges on both sides and Spark can split a text that many rows have.
        merged = hits.groupBy("key").agg(_union(F.flatten(F.collect_list("spans"))).alias("u"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = checkpointed(merged.select("key", "u.*", "items"))
        counted = docs.select(row, key, _finder(session, [], window)(text)["n_words"].alias("n_words"))
        empty = {"n_hit": F.lit(0).cast("bigint"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")}
        found = counted.join(merged, "key", "left").select("row", "n_words", *(F.coalesce(c, none).alias(c) for c, none in empty.items()))
    told = F.struct("n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans")
    return found.select("row", told.alias("told"))


def _over(n_hit: Column, n_words: Column, coverage: float) -> Column:
    """Whether hit words are at least `coverage` of all, by its exact decimal fraction."""
    share = Fraction(str(coverage))
    return (n_hit > 0) & (n_hit * F.lit(share.denominator) >= n_words * F.lit(share.numerator))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    contaminated: at least one word is hit and hit words are at least `coverage` of all. A
    null or word-less text has no words and no hit; items without a word match nothing;
    words of items without an id are hit, but such items are not counted; items that repeat
    count once. Null and repeated ids keep their rows; other columns are not read; empty
    tables give empty results or no hits.
    """
    found = matched(docs.select(*dict.fromkeys((id_col, text_col))), benchmark, text_col, item_col, item_text, window, keep=[id_col])
    told = found.select(F.col("row")[id_col].alias(id_col), *(F.col(f"told.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256")))
    return told.withColumn("contaminated", _over(F.col("n_hit"), F.col("n_words"), coverage))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, drop_coverage: float | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with the hit spans of contaminated texts cut out; all other texts stay as they are.

    A span counts by its length (`window` words or a whole short item); a text loses its
    spans when they cover at least `coverage` of its words, and its row goes when they cover
    at least `drop_coverage` (never, if None; 0 drops every contaminated row). All columns
    keep their names; null texts stay null.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_spans(t, list(zip(flat[::2], flat[1::2]))) if flat else t for t, flat in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    found = matched(docs, benchmark, text_col, item_col, item_text, window)
    over = _over(F.col("told.n_hit"), F.col("told.n_words"), coverage)
    if drop_coverage is not None:
        found = found.where(~(over & _over(F.col("told.n_hit"), F.col("told.n_words"), drop_coverage)))
        if Fraction(str(drop_coverage)) <= Fraction(str(coverage)):
            return found.select("row.*")  # all that would be cut is dropped
    told = found.select("row", cut(F.col("row")[text_col], F.when(over, F.col("told.spans")).otherwise(F.array().cast("array<bigint>"))).alias("text"))
    return told.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
