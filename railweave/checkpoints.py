"""Cutting lineage in the folder that the whole cluster shares."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(session: SparkSession) -> str:
    """The session's checkpoint folder, below spark.checkpoint.dir; a folder of our own only in local mode, where none is named."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("name a folder that the whole cluster shares in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="railweave-checkpoint-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """`frame`, checkpointed in `folder`: for keys and links."""
    folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def new_path(session: SparkSession) -> str:
    """The path of a table or data set in `folder` that does not exist yet."""
    return f"{folder(session)}/{uuid4()}"


def written(frame: DataFrame) -> DataFrame:
    """`frame`, written as Parquet in `folder` and read from there: for texts, of which a reader may want some columns."""
    path = new_path(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def packed(frame: DataFrame) -> DataFrame:
    """`frame`, written as Parquet in `folder` in as few bytes as it takes: for rows with many repeats and lists, which checkpoints keep as they are in memory."""
    path = new_path(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
