"""Joins whose pairs are many more than their rows."""

from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stored

#: Pairs that one task makes, about.
PAIRS_A_TASK = 4_000_000


def met(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """The inner join on `key`, in tasks of about so many pairs.

    Rows of a key that has more pairs are cut in parts, the more numerous side by a column
    of its own, and the other side goes to every part. The number of tasks follows the
    pairs, as few bytes may make very many of them.
    """
    size = lambda frame, name: frame.groupBy(key).agg(F.count("*").alias(name))
    sizes = stored(size(left, "_l").join(size(right, "_r"), key).withColumn("_n", F.greatest(F.least(F.ceil(F.col("_l").cast("double") * F.col("_r") / pairs_a_task), F.greatest("_l", "_r")), F.lit(1))))
    pairs = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // pairs_a_task) + 1)
    every, more = F.sequence(F.lit(0), F.col("_n").cast("int") - 1), F.col("_l") >= F.col("_r")
    one = lambda by: F.array(F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    dealt = lambda frame, by, cut: frame.join(sizes, key).withColumn("_part", F.explode(F.when(cut, one(by)).otherwise(every))).drop("_l", "_r", "_n").repartition(tasks, key, "_part")
    return dealt(left, left_by, more).join(dealt(right, right_by, ~more).hint("shuffle_hash"), [key, "_part"]).drop("_part")
