"""Reproducible shuffling into shards by a Feistel permutation of global row numbers."""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import checkpointed

#: Rounds of the permutation: each half is changed three times.
ROUNDS = 6
#: Rows of a range partition of the numbering pass, about.
ROWS_A_PART = 500_000


def _mixed(values: np.ndarray, key: int, below: int) -> np.ndarray:
    """A round function: well mixed numbers under `below`."""
    x = values + np.uint64((key * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(below)


def permuted(numbers: np.ndarray, total: int, seed: int = 0) -> np.ndarray:
    """Where a shuffle of 0 .. total - 1 puts the given numbers; a bijection for every total and seed.

    A number is a pair of halves on a grid of a x b >= total places, and each round adds a
    function of one half to the other, modulo that half's size. A result outside total walks
    on along its cycle until it is inside; under one in sqrt(total) needs that.
    """
    a = isqrt(max(total - 1, 0)) + 1
    b = -(-total // a) if total else 1
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while walking.size:
        left, right = np.divmod(out[walking], np.uint64(b))
        for k in range(ROUNDS):
            if k % 2:
                left = (left + _mixed(right, seed * ROUNDS + k + 1, a)) % np.uint64(a)
            else:
                right = (right + _mixed(left, seed * ROUNDS + k + 1, b)) % np.uint64(b)
        out[walking] = left * np.uint64(b) + right
        walking = walking[out[walking] >= np.uint64(total)]
    return out.astype(np.int64)


def numbered(rows: DataFrame, *order: str, into: str = "row_number") -> DataFrame:
    """`rows` with their place, from 0, in the order of all the given columns (nulls first).

    Range partitions are sorted by themselves; only their row counts are summed over the
    partitions. Rows equal in all columns are dealt apart by a random tail, so no partition
    holds a large group of them; equal rows are alike, so their order does not matter. The
    dealt rows are checkpointed, so counting and numbering see the same partitions.
    """
    parts = max(1, -(-rows.count() // ROWS_A_PART), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("_tail", F.rand(5)).repartitionByRange(parts, *order, "_tail").sortWithinPartitions(*order, "_tail")
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Ids count up by one within a partition; one row a partition is a bounded thing to broadcast.
    return dealt.join(F.broadcast(before.select("_part", "_least", "_before")), "_part").withColumn(into, F.col("_before") + F.col("_id") - F.col("_least")).drop("_part", "_id", "_tail", "_least", "_before")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`.

    Rows are numbered in the order of id, size and crc; the permuted number modulo `shards`
    is the shard and its quotient the slot, so both can be computed for any row number, and
    shard sizes differ by one at most (law `rows`; grown_shard is null). Null texts have
    size 8 and crc 0; null ids come first; repeated rows keep their rows. Other columns are
    not read; an empty table gives an empty result.
    """
    placed = _placed(docs.select(*_keys(id_col, text_col)), seed)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` (id, size, text_crc32 and more) with `place`: where the shuffle puts them."""
    numbers = numbered(rows, "id", "size", "text_crc32")
    total = numbers.count()

    @F.arrow_udf("bigint")
    def place(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(zero_copy_only=False), total, seed))

    return numbers.withColumn("place", place.asNondeterministic()("row_number"))


def unused(name: str, columns: list[str]) -> str:
    """`name`, or name_2, name_3 ..., whichever no column has first; case does not tell columns apart."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))) if n not in taken)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = ROWS_A_PART) -> tuple[str, str]:
    """Writes whole rows of `docs` as Parquet, partitioned by shard and ordered by slot; returns the names of these two columns.

    They are `shard` and `slot`, or other names where `docs` has such columns, which stay.
    Rows travel with their keys, so they are numbered and written without a join. A shard is
    dealt to tasks by ranges of slots: each file holds a range of about `rows_a_file` rows
    of one shard, or of several small ones.
    """
    placed = _placed(docs.select(*_keys(id_col, text_col), F.struct("*").alias("row")), seed)
    shard, slot = unused("shard", docs.columns), unused("slot", docs.columns)
    told = placed.select("row.*", (F.col("place") % shards).cast("int").alias(shard), F.floor(F.col("place") / shards).cast("bigint").alias(slot))
    parts = max(1, -(-placed.count() // rows_a_file))
    told.repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot
