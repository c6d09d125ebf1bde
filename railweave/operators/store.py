"""Changing a store of trains: append, replace, upsert, and edits of single trains."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stored
from .ranks import ranked


def upsert(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row by `seq` of each key, with `position`: the place (least seq) where the key came first.

    Rows without a key are changes of one nameless thing, as they share the missing value.
    Aggregates only, so a key with many changes is combined before it is shuffled.
    """
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last"), F.min(seq).alias("position"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest), "position")


def upsert_counters(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """One row (trains_total, added, replaced, trains_after): first sights of new keys are added, all else is replaced; rows without a key are added."""
    old = existing.select(F.col(key)).distinct().withColumn("_old", F.lit(True))
    batch = incoming.groupBy(key).agg(F.count("*").alias("_n")).join(old, key, "left")
    fresh = F.when(F.col(key).isNull(), F.col("_n")).when(F.col("_old").isNull(), 1).otherwise(0)
    told = batch.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("trains_total"), F.coalesce(F.sum(fresh), F.lit(0)).alias("added"), F.coalesce(F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)), F.lit(0)).alias("_new"))
    return told.crossJoin(old.agg(F.count("*").alias("_had"))).select("trains_total", "added", (F.col("trains_total") - F.col("added")).alias("replaced"), (F.col("_had") + F.col("_new")).alias("trains_after"))


_SKIPS = pa.schema([("base", pa.string()), ("id", pa.string()), ("skipped", pa.bool_()), ("at", pa.int64())])
#: A numbered id: its base, and a number of 2 or more without leading zeros.
_NUMBERED = r"^(.*)-([2-9]|[1-9][0-9]{1,17})$"


def _skips(rows: pa.Table) -> pa.Table:
    """Which numbered ids of a base its renamed rows step over, and with which of these rows; the others they take, or leave.

    rows: (base, id, k, old, before), `before`: how many of the base's renamed rows come before the id's own first row.
    """
    out, stepped = [], 0
    for base, name, k, old, before in zip(*(rows.sort_by("k")[c].to_pylist() for c in ("base", "id", "k", "old", "before"))):
        at = k - 1 - stepped  # the renamed row that would take it
        skipped = old or before < at
        stepped += skipped
        out.append((base, name, skipped, at))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), (), ()), _SKIPS)], schema=_SKIPS)


def _counted_below(points: DataFrame, marks: DataFrame, key: str, at: str, into: str, store: Callable[[DataFrame], DataFrame], own: str | None = None) -> DataFrame:
    """`points` with `into`: how many `marks` (key, at) of their key lie at or below their `at`; `own`: a column with the points' places, where they are known. No pair of a point and a mark is made."""
    own = points.withColumn("_own", F.col(own)) if own else ranked(points, [key], [at], "_own", store)
    both = own.withColumn("_mark", F.lit(1)).unionByName(marks.select(key, at).withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    all_ = ranked(both, [key], [at, "_mark", "_own"], "_all", store)
    return all_.where("_mark = 1").withColumn(into, F.col("_all") - F.col("_own")).drop("_mark", "_own", "_all")


def unique_ids(existing: DataFrame, incoming: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(ord, id, unique_id): incoming ids (id, ord) made unique against existing ones (id) and each other, in order of `ord`.

    An id that is free is kept, another becomes id-2, id-3 ... by the first that is free. As
    `a-2` can come in by itself and also be what a row `a` becomes, what happens to `a-2`
    depends on `a`, never the other way: so ids are settled by how many numbers they end in.
    At each level the rows of an id are ranked, the numbered ids that are in the way are
    placed among them by rank, and one pass over the distinct numbered ids of each base
    tells which of these its rows step over; only that pass has a base in one task, with a
    few numbers for each distinct id. Rows are never gathered by id. Null ids stay null.
    """
    rows = incoming.select("id", F.col("ord").cast("bigint").alias("ord"))
    new = store(ranked(rows.where("id IS NOT NULL"), ["id"], ["ord"], "nth", store))
    asked = new.groupBy("id").agg(F.min("ord").alias("first"), F.count("*").alias("rows"))
    old = existing.select("id").where("id IS NOT NULL").distinct().withColumn("old", F.lit(True))
    base, number = F.regexp_extract("id", _NUMBERED, 1), F.regexp_extract("id", _NUMBERED, 2)
    depth = F.size(F.split(F.regexp_extract("id", r"((-([2-9]|[1-9][0-9]{1,17}))*)$", 1), "-")) - 1
    names = asked.join(old, "id", "full").withColumns({"old": F.coalesce("old", F.lit(False)), "base": F.when(number != "", base), "k": F.when(number != "", number.cast("bigint")), "depth": F.when(F.col("rows").isNotNull(), depth)})
    names = store(names)
    # Ids whose rows are renamed at all, if only because their base takes the id first, and the numbered ids in their way.
    bases = names.where("rows IS NOT NULL").select(F.col("id").alias("base"), F.col("depth").alias("level"))
    specials = store(names.where("base IS NOT NULL").select("base", "id", "k", "old", "first").join(bases, "base"))
    crowded = {r["level"] for r in specials.select("level").distinct().collect()}
    taken = store(names.where("old").select("id"))
    done, last = None, names.agg(F.max("depth")).first()[0]
    for level in range(0 if last is None else last + 1):
        here = names.where(F.col("depth") == level).select("id", "first", "rows").join(taken.withColumn("_t", F.lit(1)), "id", "left")
        here = store(here.select("id", (F.col("_t").isNull()).cast("bigint").alias("kept")))
        mine = new.join(here, "id").withColumn("j", F.col("nth") - F.col("kept"))
        renamed = mine.where("j > 0").select("id", "ord", "j")
        shifted = renamed.withColumn("over", F.lit(0).cast("bigint"))
        skips = None
        if level in crowded:
            near = specials.join(here.select(F.col("id").alias("base")), "base")
            # How many renamed rows of the base come before an id's own first row; for ids that only exist it does not matter.
            placed = _counted_below(near.withColumn("ord", F.col("first")), renamed.select(F.col("id").alias("base"), "ord"), "base", "ord", "before", store)
            skips = store(placed.select("base", "id", "k", "old", F.coalesce("before", F.lit(0)).alias("before")).groupBy("base").applyInArrow(_skips, "base string, id string, skipped boolean, at bigint"))
            met = skips.where("skipped").select(F.col("base").alias("id"), F.col("at").alias("j"))
            in_way = met.select("id").distinct()
            moved_on = _counted_below(renamed.join(in_way, "id", "left_semi"), met, "id", "j", "over", store, own="j")
            shifted = moved_on.unionByName(shifted.join(in_way, "id", "left_anti"))
        named = shifted.select("ord", "id", F.concat("id", F.lit("-"), (F.col("j") + 1 + F.col("over")).cast("string")).alias("unique_id"))
        part = named.unionByName(mine.where("j = 0").select("ord", "id", F.col("id").alias("unique_id")))
        done = part if done is None else done.unionByName(part)
        if skips is None:
            continue
        # Numbered ids that their base took before they came in by themselves.
        more = skips.where("NOT skipped").join(here.select(F.col("id").alias("base"), "kept"), "base").join(asked.select(F.col("id").alias("base"), "rows"), "base").where("at <= rows - kept").select("id")
        taken = store(taken.unionByName(more).distinct())
    nulls = rows.where("id IS NULL").select("ord", "id", F.col("id").alias("unique_id"))
    return nulls if done is None else done.unionByName(nulls)


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows and then incoming ones, renamed where their id is taken."""
    renamed = unique_ids(existing, incoming).select("ord", "unique_id")
    fresh = incoming.join(renamed, "ord").withColumn("id", F.col("unique_id")).drop("unique_id")
    after = existing.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    return existing.unionByName(fresh.crossJoin(after).withColumn("ord", F.col("ord") + F.col("_last") + 1).drop("_last"))


def edited(trains: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """`trains` with the columns of `patch` (one row a key) in place of theirs where they are not null."""
    changes = patch.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in patch.columns if c != key))
    told = trains.join(changes, F.col(key) == F.col("_k"), "left")
    return told.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c != key and c in patch.columns else F.col(c) for c in trains.columns))


def replaced(trains: DataFrame, full: DataFrame, key: str = "id") -> DataFrame:
    """`trains` with each row of a key that `full` (one row a key, the same columns) has replaced as a whole, at its old `ord`; other rows of `full` are left out."""
    told = full.select(F.col(key).alias("_k"), F.struct(*(c for c in full.columns if c != "ord")).alias("_full"))
    found = trains.join(told, F.col(key) == F.col("_k"), "left")
    return found.select(*(F.when(F.col("_k").isNotNull(), F.col(f"_full.{c}")).otherwise(F.col(c)).alias(c) if c != "ord" else F.col(c) for c in trains.columns))


def duplicated(trains: DataFrame, keys: DataFrame) -> DataFrame:
    """`trains` with copies of those of `keys` (id) at the end, in their order: ids end in -copy, made unique, names in Copy."""
    name = F.when(F.coalesce("name", F.lit("")) == "", "Train").otherwise(F.col("name"))
    copies = trains.join(keys.select("id").distinct(), "id", "left_semi").withColumns({"id": F.concat("id", F.lit("-copy")), "name": F.concat(name, F.lit(" Copy"))})
    return append(trains, copies.select(*trains.columns))


def emptied(trains: DataFrame) -> DataFrame:
    """A store without trains."""
    return trains.limit(0)


def placed(trains: DataFrame, into: str = "place") -> DataFrame:
    """`trains` with their place, from 1, by `ord` over the whole store."""
    return ranked(trains.withColumn("_all", F.lit(0)), ["_all"], ["ord"], into).drop("_all")


def removed(trains: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return trains.join(keys.select(key), key, "left_anti")


def toggled(trains: DataFrame, which: Column) -> DataFrame:
    """`trains` with the visibility of some turned over; a missing flag counts as visible."""
    shown = F.coalesce(F.col("visible"), F.lit(True))
    return trains.withColumn("visible", F.when(which, ~shown).otherwise(shown))


def moved(trains: DataFrame, train_id: str, by: int, key: str = "id") -> DataFrame:
    """`trains` with one train and its neighbour (by -1 or 1) changing their `ord`; at the rim nothing moves."""
    me = trains.where(F.col(key) == train_id).select(F.col("ord").alias("_mine"))
    beside = F.max(F.when(F.col("ord") < F.col("_mine"), F.col("ord"))) if by < 0 else F.min(F.when(F.col("ord") > F.col("_mine"), F.col("ord")))
    two = trains.select("ord").crossJoin(F.broadcast(me)).groupBy("_mine").agg(beside.alias("_other"))
    told = trains.join(F.broadcast(two), F.lit(True), "left")
    swap = F.when(F.col("_other").isNull(), F.col("ord")).when(F.col("ord") == F.col("_mine"), F.col("_other")).when(F.col("ord") == F.col("_other"), F.col("_mine")).otherwise(F.col("ord"))
    return told.withColumn("ord", swap).drop("_mine", "_other")


def stops_edited(stops: DataFrame, edits: DataFrame) -> DataFrame:
    """`stops` (train_id, idx, ...) after one edit of a train at most: edits (train_id, idx, action) move a stop up or down, or delete it.

    idx counts from 0 without gaps, before and after. An edit past the ends moves nothing, one
    of a stop that is not there does nothing; of several edits of a train the least idx, then
    the least action, is taken.
    """
    taken = edits.groupBy("train_id").agg(F.min(F.struct("idx", "action")).alias("_e"))
    told = stops.join(taken, "train_id", "left").withColumn("_last", F.max("idx").over(Window.partitionBy("train_id")))
    at, action, idx = F.col("_e.idx"), F.col("_e.action"), F.col("idx")
    up = (action == "up") & (at > 0) & (at <= F.col("_last"))
    down = (action == "down") & (at >= 0) & (at < F.col("_last"))
    other = F.when(up, at - 1).when(down, at + 1)
    now = F.when(idx == at, F.coalesce(other, idx)).when(idx == other, at).when((action == "delete") & (at >= 0) & (idx > at), idx - 1).otherwise(idx)
    kept = told.where(~F.coalesce((action == "delete") & (idx == at), F.lit(False)))
    return kept.withColumn("idx", now).drop("_e", "_last")
