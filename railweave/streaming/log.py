"""A log of changes in numbered segments, and the stream that reads it from any number on."""

import json
from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import versions
from ..sources.schemas import EVENT

#: Segments of one task of a batch at most.
SEGMENTS_A_TASK = 200


def _segments(path: str) -> list[int]:
    """The first numbers of all segments, in order; an empty log has none."""
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def _lines(path: str, first: int) -> list[str]:
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{folder}/{first:020d}.json") as stream:
        return stream.read().decode().splitlines()


def last_number(path: str) -> int:
    """The number of the newest change; -1 where there is none."""
    found = _segments(path)
    return found[-1] + len(_lines(path, found[-1])) - 1 if found else -1


def append(spark: SparkSession, path: str, changes: list[dict]) -> int:
    """Adds the changes of one writer as a segment, numbered on from the newest; their first number.

    The name of a segment is its first number, and it is made in one step that fails where
    another writer was first: then the changes are numbered anew. So numbers have no gaps
    and none is given twice.
    """
    if not changes:
        raise ValueError("there is nothing to add")
    while True:
        first = last_number(path) + 1
        try:
            versions.exclusive(spark, path, f"{first:020d}.json", "\n".join(json.dumps(c, default=str) for c in changes))
            return first
        except versions.Conflict:
            continue


class _Part(InputPartition):
    def __init__(self, path: str, segments: list[int], after: int, until: int):
        self.path, self.segments, self.after, self.until = path, segments, after, until


class _Reader(DataSourceStreamReader):
    """Offsets are numbers of changes: a batch has those after its start, up to its end, whenever it is read again."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.names
        self.times = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)}
        self.path, self.most = options["path"], int(options.get("max_changes", 0))
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        last = last_number(self.path)
        # Spark asks this before it tells where a stream goes on, so the first batch is not held back.
        if self.most and self.reached is not None:
            last = min(last, self.reached + self.most)
        return {"seq": last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.reached = end["seq"]
        found = _segments(self.path)
        wanted = [a for a, b in zip(found, [*found[1:], float("inf")]) if b > start["seq"] + 1 and a <= end["seq"]]
        return [_Part(self.path, wanted[at : at + SEGMENTS_A_TASK], start["seq"], end["seq"]) for at in range(0, len(wanted), SEGMENTS_A_TASK)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for first in partition.segments:
            for seq, line in enumerate(_lines(partition.path, first), first):
                if partition.after < seq <= partition.until:
                    told = json.loads(line) | {"seq": seq}
                    yield tuple(datetime.fromisoformat(v) if (v := told.get(n)) is not None and n in self.times else v for n in self.names)


class ChangeLog(DataSource):
    """Source `change_log`: option path, a folder that all workers reach, and max_changes, the most that each batch but a stream's first takes (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(schema, self.options)


def change_log(spark: SparkSession, path: str, schema: str = EVENT, max_changes: int = 0) -> DataFrame:
    """The changes of a log as a stream, with `seq`, their numbers; a stream that is started again goes on where its checkpoint says.

    Parts of a batch are read by tasks with PyArrow's file systems, so `path` may be a
    folder of a shared disk or a store that these know.
    """
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("change_log").schema(schema).option("path", path).option("max_changes", str(max_changes)).load()
