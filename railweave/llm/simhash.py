"""Near duplicates by SimHash fingerprints that differ in few bits.

Fingerprints are compared through a pivot table. Two texts linked at `radius` bits agree on
at least blocks - radius of any `blocks` bit blocks, so equal blocks deal the fingerprints
into buckets. Inside a bucket each fingerprint has its Hamming distances to a list of
reference fingerprints; by the triangle inequality a pair whose distances to any reference
differ by more than the radius cannot be linked and is discarded; survivors are verified.
"""

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow_text import text_udf
from .components import connected_components
from .durable import checkpointed

#: Words hashed at one time, so that one very long text needs bounded memory.
WORDS_AT_ONCE = 50_000


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of `text` as a signed 64-bit number; no word gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    total = max(len(words) - shingle + 1, 1) if words else 0
    if not total:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, total, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(part)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def pivots(count: int) -> np.ndarray:
    """The reference fingerprints: XXH64 of 0, 1, 2 ... with a seed of their own."""
    return np.array([xxhash.xxh64_intdigest(str(k), 7) for k in range(count)], np.uint64)


def bucket_edges(prints: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span the linked fingerprints of one bucket, fewer than it has members.

    Grows each component from a seed and compares its members only with what no component
    has yet, so a dense group costs far less than all its pairs. table: pivot distances.
    """
    edges, left = [], np.arange(len(prints))
    while left.size > 1:
        grown, left = [left[0]], left[1:]
        while grown and left.size:
            one = grown.pop()
            near = left
            for k in range(table.shape[1]):
                near = near[np.abs(table[near, k] - table[one, k]) <= radius]
                if not near.size:
                    break
            near = near[np.bitwise_count(prints[near] ^ prints[one]) <= radius]
            if near.size:
                edges += [(one, x) for x in near]
                grown += list(near)
                left = left[~np.isin(left, near, assume_unique=True)]
    return edges


def _scan(radius: int, n_pivots: int):
    """mapInArrow function over rows sorted by bucket; holds one bucket at a time."""
    fields = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def edges_of(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(parts)
        prints = np.ascontiguousarray(rows["fp"].to_numpy()).view(np.uint64)
        keys = [rows[c].to_numpy() for c in ("t", "key", "ci", "cj")]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        sizes = np.diff(np.r_[starts, len(prints)])
        table = np.bitwise_count(prints[:, None] ^ references).astype(np.int8)
        src, dst = [], []
        for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            for a, b in bucket_edges(prints[at : at + n], table[at : at + n], radius):
                src.append(at + a)
                dst.append(at + b)
        signed = prints.view(np.int64)
        yield pa.record_batch([pa.array(signed[np.array(x, np.int64)]) for x in (src, dst)], schema=fields)

    references = pivots(n_pivots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = [rows[c].to_numpy() for c in ("t", "key", "ci", "cj")]
            changed = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            first = tuple(k[0] for k in keys)
            if held and tuple(held[-1][c][-1].as_py() for c in ("t", "key", "ci", "cj")) != first:
                yield from edges_of(held)
                held = []
            if changed.size:  # the last bucket may go on in the next batch
                cut = int(changed[-1]) + 1
                yield from edges_of([*held, rows.slice(0, cut)])
                held = [rows.slice(cut)]
            else:
                held.append(rows)
        if held:
            yield from edges_of(held)

    return scan


def blocks_for(n: int, radius: int, per_bucket: int = 64) -> int:
    """Bit blocks so that even spread leaves about `per_bucket` of `n` fingerprints together."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) // blocks) > per_bucket and blocks < 2 * radius + 3:
        blocks += 1
    return blocks


def fingerprint_edges(prints: DataFrame, radius: int = 3, n_pivots: int = 24, bucket_rows: int = 8192, blocks: int | None = None) -> DataFrame:
    """(src, dst): edges that connect all distinct fingerprints `fp` within `radius` bits.

    No link is lost: they span every component, though not every pair has its own edge.
    A bucket over `bucket_rows` is cut in chunks, and each two chunks meet in one task of
    their own, so a task never holds more than 2 x bucket_rows (on average) of a bucket.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    ends = [64 * k // blocks for k in range(blocks + 1)]
    block = [(2**64 - 1) & ~(2 ** ends[k] - 1) & (2 ** ends[k + 1] - 1) for k in range(blocks)]
    masks = [sum(block[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for t, m in enumerate(signed)))
    dealt = prints.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    hot = dealt.groupBy("t", "key").count().where(F.col("count") > bucket_rows).select("t", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("n"))
    dealt = dealt.join(hot, ["t", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    met = dealt.select("fp", "t", "key", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    met = met.select("fp", "t", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    met = met.repartition("t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj")
    return met.mapInArrow(_scan(radius, n_pivots), "src bigint, dst bigint")


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint `fp` of `marked`."""
    prints = checkpointed(marked.select("fp").distinct())
    roots = connected_components(fingerprint_edges(prints, radius)).withColumnRenamed("node", "fp")
    return checkpointed(prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def _print_udf(shingle: int):
    return text_udf(lambda: lambda texts: [(fingerprint(t, shingle),) for t in texts], fp=pa.int64())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): near-duplicate groups of a document table.

    One row for each row of `docs`, repeated rows and repeated ids included. component_id is
    the least id reachable over links of at most `radius` differing bits, its own included.
    A null or word-less text has fingerprint zero and is linked like any other; a null id
    keeps its row and takes the least non-null id of its group (null if there is none).
    Other columns are not read. An empty table gives an empty result.
    """
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), _print_udf(shingle)(F.col(text_col)).alias("s")).select("id", "s.fp"))
    labelled = _grouped(marked, radius)
    least = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    # Written first, so that the joins below have plain exchanges on both sides and Spark can split a large group.
    groups = checkpointed(least.join(labelled, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(labelled.join(groups, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of `docs` for each near-duplicate group, all columns as they were.

    It is the row of the least id, null ids last; of rows that share an id, that of the least
    text hash and then of the least hash over all columns but maps and variants; rows that
    are alike in all of these are one row to this operator. Rows are chosen by such keys
    before any text moves: the texts are read again and only rows that are not chosen are
    looked up, so few of them (under Spark's broadcast limit) cost no shuffle of texts.
    """
    names = [f.name for f in docs.schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.xxhash64(*names).alias("all"))
    marked = checkpointed(docs.select(key.alias("key"), _print_udf(shingle)(F.col(text_col)).alias("s")).select("key", "s.fp"))
    labelled = _grouped(marked, radius)
    first = checkpointed(marked.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    chosen = checkpointed(first.join(labelled, "fp").groupBy("root").agg(F.min("key").alias("chosen")))
    named = checkpointed(labelled.join(chosen, "root").select("fp", "chosen"))
    told = marked.join(named, "fp").groupBy("key").agg(F.max(F.col("key") == F.col("chosen")).alias("stays"), F.count("*").alias("n"))
    odd = checkpointed(told.where("NOT stays OR n > 1").select(*(F.col(f"key.{c}").alias(f"_{c}") for c in ("id", "text", "all")), "stays"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.xxhash64(*names).alias("ah"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_text")) & (F.col("ah") == F.col("_all"))
    kept = rows.join(odd, same, "left_anti").select("row.*")
    if odd.where("stays").isEmpty():
        return kept
    # Chosen rows that are there several times: one of each.
    repeated = rows.join(odd.where("stays"), same, "left_semi").groupBy("id", "th", "ah").agg(F.any_value("row").alias("row"))
    return kept.unionByName(repeated.select("row.*"))
