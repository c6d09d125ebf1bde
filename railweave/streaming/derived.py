"""Counts that follow a store: only the rows of changed keys are looked at, as signed changes."""

from pyspark.sql import DataFrame, functions as F


def signed(before: DataFrame | None, after: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows of `keys` as they were, with `sign` -1, and as they are, with 1; a missing store before has none.

    Rows that are the same in both meet again in every count and cancel there.
    """
    named = keys.select(key).distinct()
    of = lambda store, sign: store.where(F.col(key).isNotNull()).join(named, key, "left_semi").withColumn("sign", F.lit(sign))
    now = of(after, 1)
    return now if before is None else of(before, -1).unionByName(now, allowMissingColumns=True)


def changes(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., change): what signed rows add to, or take from, the count of each group; groups that stay as they are have no row."""
    return rows.groupBy(*by).agg(F.sum("sign").alias("change")).where("change <> 0")


def applied(counts: DataFrame | None, change: DataFrame, *by: str) -> DataFrame:
    """(by..., n): counts after a change; groups that nothing is left of go."""
    told = change.select(*by, F.col("change").alias("n"))
    both = told if counts is None else counts.select(*by, "n").unionByName(told)
    return both.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def date_changes(rows: DataFrame) -> DataFrame:
    """(date, change) of signed trains (date): how many trains each date has more or less."""
    return changes(rows, "date")


def segment_changes(rows: DataFrame) -> DataFrame:
    """(seg_key, change) of signed trains (id, segments as an array of keys): how many trains share each segment more or less; a train counts once."""
    each = rows.select("sign", F.explode(F.array_distinct("segments")).alias("seg_key"))
    return changes(each, "seg_key")


def or_default(store: DataFrame | None, default: DataFrame) -> DataFrame:
    """The store, or the default where there is none, or nothing is left in it, as after a clearing."""
    return default if store is None or store.isEmpty() else store
