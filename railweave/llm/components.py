"""Connected components of a distributed edge list by alternating star contractions."""

from pyspark.sql import DataFrame, functions as F

from .durable import checkpointed


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node id reachable.

    `edges` has two bigint columns; direction, repeats and loops do not matter, rows with a
    null end are left out, an empty list gives an empty result. Each round is a large star
    (hang larger neighbours on the least neighbour) and a small star (hang smaller ones on
    the least of them). A node's neighbours never meet in one task: the least of them comes
    from a partial aggregate, which is stored, so that the join that brings it back has plain
    exchanges on both sides and Spark can split a node with very many neighbours. Every round
    is checkpointed, so the lineage stays one round deep.
    """
    pairs = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b")).where("a <> b")
    now = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, after = None, _signature(now)
    while before != after and after[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, after = after, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
