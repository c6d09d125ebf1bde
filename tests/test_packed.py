"""Stored tables of routes in few bytes."""

import os

from pyspark.sql import functions as F

from railweave import checkpoints
from railweave.operators import solve


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)


def test_packed_rows_take_few_bytes_and_come_back_whole(spark):
    rows = spark.range(20_000).select("id", F.array(*map(F.lit, "12345")).alias("allowed"), F.array(F.struct(F.col("id").alias("node"), F.lit(None).cast("double").alias("snap_m"))).alias("ends"))
    folder = checkpoints.folder(spark)
    before = size(folder)
    kept = checkpoints.packed(rows)
    packed = size(folder) - before
    checkpoints.stored(rows)
    assert packed * 4 < size(folder) - before - packed
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty() and rows.exceptAll(kept).isEmpty()
    assert checkpoints.packed(rows.limit(0)).count() == 0


def test_the_ladder_keeps_columns_without_a_join(spark):
    none = F.array().cast("array<string>")
    hints = spark.range(8).select(F.col("id").alias("section_id"), none.alias("explicit_lines"), none.alias("explicit_operators"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(none).alias("common_lines"), none.alias("common_operators"), (F.col("id") * 3).alias("more"))
    kept = solve.attempt_ladder(hints, ("more",))
    plain = solve.attempt_ladder(hints).join(hints.select("section_id", "more"), "section_id")
    assert kept.exceptAll(plain.select(kept.columns)).isEmpty() and kept.count() == plain.count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
