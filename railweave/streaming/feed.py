"""The change feed as a stream, and the store that follows it."""

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources import versions
from ..sources.schemas import EVENT

#: Shards of the keys' state; changes that may come late after a newer one, counted in `seq`; commits after which the store's parts are joined.
SHARDS, LATE, COMPACT = 32, 10_000, 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_feed(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """Changes from a folder to which writers add JSON files; what was missed is read later, in order of seq."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def from_others(client: str) -> Column:
    """Changes that this client did not make itself."""
    return F.col("origin").isNull() | (F.col("origin") != client)


def replayed(changes: DataFrame, key: str = "id") -> DataFrame:
    """The store after all `changes` at once: the newest row by `seq` of each key, and the place (least seq) where the key came first.

    A change whose `cleared` is true empties the store: rows of its seq and below go, also
    those that come later, and positions count anew. The change itself is no row. This is
    what `follow` keeps up to date.
    """
    rows = changes.withColumn("position", F.col("seq"))
    if "cleared" in changes.columns:
        cut = rows.agg(F.max(F.when(F.coalesce("cleared", F.lit(False)), F.col("seq"))).alias("_cut"))
        rows = rows.crossJoin(F.broadcast(cut)).where("(_cut IS NULL OR seq > _cut) AND NOT coalesce(cleared, false)").drop("_cut")
    rest = [c for c in rows.columns if c not in (key, "position")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_last"), F.min("position").alias("position"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest), "position")


class Newest(StatefulProcessor):
    """Per shard of keys: the newest row of each key, the seqs from which its position follows, and the mark of the last clearing.

    Rows at or below the mark are dropped whenever they come. A clearing removes what is of
    its seq or below; a key that also has newer changes stays, with the first of these as its
    position, for which the seqs of the last LATE are remembered. Of a batch only the changed
    keys are held, and told: the row that counts now, or that there is none any more.
    """

    def __init__(self, schema: T.StructType, key: str):
        self.key, self.schema = key, schema

    def init(self, handle) -> None:
        key = T.StructType([T.StructField("key", self.schema[self.key].dataType)])
        self.keys = handle.getMapState("keys", key, T.StructType([T.StructField("row", self.schema), T.StructField("seqs", T.ArrayType(T.LongType()))]))
        self.mark = handle.getValueState("mark", "seq bigint, newest bigint")

    def _told(self, values: dict, position: int | None, gone: bool, cut: int | None = None) -> Row:
        return Row(**dict.fromkeys(self.schema.names) | values, position=position, _gone=gone, _cut=cut)

    def _merged(self, rows: Iterator[Row]) -> Iterator[Row]:
        names, at = self.schema.names, self.schema.names.index("seq")
        before, newest = self.mark.get() if self.mark.exists() else (None, None)
        cut, fresh = before, {}
        for r in rows:
            newest = r["seq"] if newest is None else max(newest, r["seq"])
            if r["_cleared"]:
                cut = r["seq"] if cut is None else max(cut, r["seq"])
                continue
            row, seqs = fresh.setdefault(r[self.key], ([], []))
            if not row or r["seq"] >= row[at]:
                row[:] = [r[c] for c in names]
            seqs += r["_seqs"] or [r["seq"]]
        if newest is not None:
            self.mark.update((cut, newest))
        if cut != before:
            yield self._told({"seq": cut}, None, True, cut)
        for key in set(fresh) | ({k[0] for k in self.keys.keys()} if cut != before else set()):
            held = self.keys.getValue((key,)) if self.keys.containsKey((key,)) else None
            row, seqs = fresh.get(key, ([], []))
            if held and (not row or held[0][at] > row[at]):
                row = list(held[0])
            seqs = sorted({s for s in (*(held[1] if held else ()), *seqs) if cut is None or s > cut})
            if not seqs:
                if held:
                    self.keys.removeKey((key,))
                    yield self._told({self.key: key}, None, True)
                continue
            # Seqs too old for a clearing to come between them count by their least alone.
            settled = [s for s in seqs if s <= newest - LATE]
            seqs = settled[:1] + seqs[len(settled) :]
            if held and list(held[1]) == seqs and held[0][at] == row[at]:
                continue
            self.keys.updateValue((key,), (tuple(row), seqs))
            yield self._told(dict(zip(names, row)), seqs[0], False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._merged(rows)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for _ in self._merged(iter([initialState])):
            pass

    def close(self) -> None:
        pass


def _dealt(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """`rows` with `_shard`; a clearing goes to every shard."""
    cleared = F.coalesce("cleared", F.lit(False)) if "cleared" in rows.columns else F.lit(False)
    told = rows.withColumn("_cleared", cleared)
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    return told.withColumn("_shard", F.explode(F.when(F.col("_cleared"), every).otherwise(own)))


def keyed_changes(changes: DataFrame, key: str = "id", initial: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """A stream of what the store's rows become: for each key that a batch changes, its columns, `position` and `_gone`.

    Keeps keys in Spark's state (RocksDB), so work grows with the changes, not with the
    store. initial: rows of the store to start from, with `position`, or with `cleared` for
    the mark of its last clearing. Changes without a seq are none; those without a key are
    changes of one nameless thing.
    """
    spark, schema = changes.sparkSession, changes.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    wider = lambda frame, seqs: _dealt(frame.where("seq IS NOT NULL").withColumn("_seqs", seqs), key, shards)
    grouped = wider(changes, F.lit(None).cast("array<bigint>")).groupBy("_shard")
    start = None
    if initial is not None:
        seqs = F.when(F.col("position") < F.col("seq"), F.array("position", "seq")).otherwise(F.array("seq"))
        start = wider(initial, seqs).select(*schema.names, "_seqs", "_cleared", "_shard").groupBy("_shard")
    out = T.StructType([*schema.fields, T.StructField("position", T.LongType()), T.StructField("_gone", T.BooleanType()), T.StructField("_cut", T.LongType())])
    return grouped.transformWithState(Newest(schema, key), out, "Update", "None", start)


def follow(changes: DataFrame, store_path: str, checkpoint: str, key: str = "id", keep: int = 2, changed: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the newest row of each key in the store under `store_path`; `latest` reads it.

    Each batch adds the rows that it changes as a part of the store, by a commit that keeps
    what other writers did meanwhile; every COMPACT commits the parts are joined. A store
    that is there when the stream starts is kept, with the mark of its last clearing, also
    under a new checkpoint. A batch that runs again after a failure is not added twice.
    `changed` gets the keys of each batch after it counts, for instance to solve the routes
    of these trains anew.
    """
    spark = changes.sparkSession
    version, told = versions.head(spark, store_path)
    initial = None
    if version >= 0:
        rows = latest(spark, store_path, key)
        mark = spark.createDataFrame([(told.get("cut"),)], "seq bigint").where("seq IS NOT NULL")
        # The mark goes first, as a row that clears what is not there any more.
        initial = mark.withColumns({"cleared": F.lit(True), "position": F.col("seq")}).unionByName(rows, allowMissingColumns=True)
        initial = initial.select(*(F.col(c) if c in initial.columns else F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in changes.columns), "position", *(["cleared"] if "cleared" not in changes.columns else []))

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        data = versions.written(batch, store_path)  # once, as this also moves the state on
        made = spark.read.parquet(f"{store_path}/data/{data}")
        cut = made.agg(F.max("_cut")).first()[0]
        while True:
            version, told = versions.head(spark, store_path)
            if told.get("streams", {}).get(checkpoint, -1) >= epoch:
                break
            cuts = [c for c in (cut, told.get("cut")) if c is not None]
            more = {"data": [*told.get("data", []), data], "streams": told.get("streams", {}) | {checkpoint: epoch}, "cut": max(cuts, default=None)}
            try:
                versions.commit(spark, store_path, version + 1, told | more)
            except versions.Conflict:
                continue
            if len(more["data"]) > COMPACT:
                compact(spark, store_path, key)
            break
        if changed:
            changed(made.where("_cut IS NULL").select(key).where(F.col(key).isNotNull()).distinct())
        versions.drop_old(spark, store_path, keep)

    return keyed_changes(changes, key, initial).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str = "id") -> DataFrame | None:
    """The store as it is now, the newest of its parts for each key; None before the first batch."""
    version, told = versions.head(spark, path)
    if version < 0:
        return None
    rows = None
    for at, name in enumerate(told["data"]):
        part = spark.read.parquet(f"{path}/data/{name}")
        part = part.where("_cut IS NULL").drop("_cut") if "_cut" in part.columns else part.withColumn("_gone", F.lit(False))
        part = part.withColumn("_at", F.lit(at))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "_at")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_last")).where("NOT _last._gone")
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest if c != "_gone"))


def compact(spark: SparkSession, path: str, key: str = "id") -> None:
    """Joins the parts of a store into one; what other writers publish meanwhile stays."""
    while True:
        version, told = versions.head(spark, path)
        if version < 0 or len(told["data"]) == 1:
            return
        data = versions.written(latest(spark, path, key), path)
        try:
            return versions.commit(spark, path, version + 1, told | {"data": [data]})
        except versions.Conflict:
            continue
