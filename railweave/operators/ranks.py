"""Places within groups of any size: no group is ever gathered in one task."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import stored


def ranked(rows: DataFrame, keys: list[str], order: list[str], into: str = "place", store: Callable[[DataFrame], DataFrame] = stored, total: str | None = None) -> DataFrame:
    """`rows` with their place, from 1, among those of equal `keys`, by the columns `order` (nulls first); `total`: a column for how many these are.

    Rows are dealt to ranges of (keys, order), so a large group is spread over many tasks;
    each range is sorted by itself, and only how many rows of a key it has is summed over
    the ranges. The dealt rows are stored, so that counting and numbering see the same
    ranges. Rows that are equal in keys and order stay together, in any order. Null keys are
    a group; an empty table gives an empty result.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = store(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    runs = dealt.groupBy("_part", *keys).agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = {total: F.sum("_n").over(Window.partitionBy(*keys))} if total else {}
    told = runs.select(*(c.alias(name) for name, c in sums.items()), F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{n}") for n, k in enumerate(keys)), (before - F.col("_least") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k_{n}"))
    return dealt.join(told, same).withColumn(into, F.col("_id") + F.col("_shift")).drop("_part", "_id", "_p", "_shift", *(f"_k_{n}" for n in range(len(keys))))
