"""Stops, sections and trains of an itinerary store.

stops: (train_id, idx, stop_type, ride, station_id ...); a train's stops are few, so windows
are by train.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import UNDATED
from ..functions.text import blank_to_null, first_truthy
from .ranks import ranked

PASSING = "pass_through"


def _by_train(order: str = "idx"):
    return Window.partitionBy("train_id").orderBy(order)


def adjacent_pairs(stops: DataFrame, *columns: str) -> DataFrame:
    """(train_id, segment, from_<c>, to_<c> ...): each stop with the next; the last has none."""
    w = _by_train()
    pairs = stops.select("train_id", F.col("idx").alias("segment"), *(F.col(c).alias(f"from_{c}") for c in columns), *(F.lead(c).over(w).alias(f"to_{c}") for c in columns), F.lead("idx").over(w).alias("_next"))
    return pairs.where("_next IS NOT NULL").drop("_next")


def stopping_neighbours(stops: DataFrame) -> DataFrame:
    """`stops` with prev_stopping and next_stopping: idx of the nearest stops that are not passed through."""
    w, stopping = _by_train(), F.when(F.col("stop_type") != PASSING, F.col("idx"))
    return stops.withColumn("prev_stopping", F.last(stopping, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next_stopping", F.first(stopping, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def effective_ride(stops: DataFrame) -> DataFrame:
    """`stops` with effective_ride: a passed stop is ridden if the stopping ones on both sides are; else its own flag."""
    w, flag = _by_train(), F.when(F.col("stop_type") != PASSING, F.col("ride"))
    before = F.last(flag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(flag, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    passed = (F.col("stop_type") == PASSING) & before.isNotNull() & after.isNotNull()
    return stops.withColumn("effective_ride", F.when(passed, before & after).otherwise(F.col("ride")))


def segment_ride(stops: DataFrame) -> DataFrame:
    """(train_id, segment, ridden): a segment is ridden if both its stops are."""
    pairs = adjacent_pairs(effective_ride(stops), "effective_ride")
    return pairs.select("train_id", "segment", (F.col("from_effective_ride") & F.col("to_effective_ride")).alias("ridden"))


def propagate_ride(stops: DataFrame) -> DataFrame:
    """`stops` where passed stops take the effective flag as their own, as after a toggle next to them."""
    return effective_ride(stops).withColumn("ride", F.col("effective_ride")).drop("effective_ride")


def branches(sections: DataFrame) -> DataFrame:
    """(train_id, branch, first_stop, last_stop, branch_key): runs of sections with an equal key.

    sections: (train_id, segment, branch_key); neighbouring branches share the stop between them.
    """
    w = _by_train("segment")
    starts = F.when(F.col("branch_key").eqNullSafe(F.lag("branch_key").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = sections.withColumn("_starts", starts).withColumn("branch", F.sum("_starts").over(w) - 1)
    return runs.groupBy("train_id", "branch").agg(F.min("segment").alias("first_stop"), (F.max("segment") + 1).alias("last_stop"), F.first("branch_key").alias("branch_key"))


def branch_owners(stops: DataFrame, found: DataFrame) -> DataFrame:
    """(train_id, idx, branch): the first branch that has the stop."""
    b = found.select(F.col("train_id").alias("_t"), "branch", "first_stop", "last_stop")
    return stops.join(b, (F.col("train_id") == F.col("_t")) & F.col("idx").between(F.col("first_stop"), F.col("last_stop"))).groupBy("train_id", "idx").agg(F.min("branch").alias("branch"))


def branch_toggles(stops: DataFrame, owners: DataFrame) -> DataFrame:
    """(train_id, branch, state): on, off or mixed, from the ride flags of the stops a branch owns."""
    own = stops.join(owners, ["train_id", "idx"]).groupBy("train_id", "branch").agg(F.count_if("ride").alias("_on"), F.count("*").alias("_n"))
    return own.select("train_id", "branch", F.when(F.col("_on") == F.col("_n"), "on").when(F.col("_on") == 0, "off").otherwise("mixed").alias("state"))


def first_departures(stops: DataFrame) -> DataFrame:
    """(train_id, departure): minutes at the first stop, else at the first origin, else at the first stop that has any."""
    rank = F.when(F.col("idx") == 0, 0).when(F.col("stop_type") == "origin", 1).otherwise(2)
    timed = stops.withColumn("_rank", F.struct(rank.alias("rank"), F.col("idx").alias("idx")))
    return timed.groupBy("train_id").agg(F.min_by(F.col("departure"), F.when(F.col("departure").isNotNull(), F.col("_rank"))).alias("departure"))


def date_buckets(trains: DataFrame, date_col: str = "date", manual: DataFrame | None = None) -> DataFrame:
    """(date, trains): counts for each date, 0 for dates only in `manual` (date), and a null date for all."""
    counts = trains.rollup(date_col).agg(F.count("*").alias("trains")).select(F.col(date_col).alias("date"), "trains")
    if manual is None:
        return counts
    more = manual.select(F.col("date")).distinct().join(counts, "date", "left_anti").select("date", F.lit(0).cast("bigint").alias("trains"))
    return counts.unionByName(more)


def _date_order(date: Column) -> list[Column]:
    return [(date == UNDATED).cast("int").asc(), date.asc()]


def order_trains(trains: DataFrame, into: str = "place") -> DataFrame:
    """`trains` with their place within their date: by departure (none last), then id in binary order.

    Dates sort by themselves with `undated` last; the order over all dates is (date, place).
    A date, as `undated`, may hold any share of the trains.
    """
    late = trains.withColumn("_late", F.col("departure").isNull())
    return ranked(late, ["date"], ["_late", "departure", "train_id"], into).drop("_late")


def endpoints(trips: DataFrame, *scope: str) -> DataFrame:
    """(scope..., first_train, last_train) by the trips' order numbers (train_id, ord)."""
    return trips.groupBy(*scope).agg(F.min_by("train_id", "ord").alias("first_train"), F.max_by("train_id", "ord").alias("last_train"))


def matches_query(query: str, fields: list[Column], stop_names: Column) -> Column:
    """Whether the lower-cased fields and stop names, joined by spaces, contain the query; nulls count as empty."""
    text = F.concat_ws(" ", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields), F.array_join(stop_names, " ", ""))
    return F.contains(F.lower(text), F.lit(query.strip().lower()))


def visible_in_scope(trains: DataFrame, date: str | None = None, hide_others: bool = False) -> DataFrame:
    """Trains that are not switched off, and, if others are hidden, run on the selected date."""
    shown = F.coalesce(F.col("visible"), F.lit(True))
    return trains.where(shown & (F.col("date") == date) if hide_others and date else shown)


def emphasis(selected: Column, in_scope: Column) -> Column:
    """2 for the selected train, 1 in the selected scope, 0 outside it."""
    return F.when(selected, 2).when(in_scope, 1).otherwise(0)


def only_endpoints(stops: DataFrame, ends: DataFrame) -> DataFrame:
    """First stop of the first train and last stop of the last one: the markers that are shown alone."""
    w = Window.partitionBy("train_id")
    told = stops.withColumns({"_first": F.min("idx").over(w), "_last": F.max("idx").over(w)})
    first, last = ends.select(F.col("first_train").alias("train_id")), ends.select(F.col("last_train").alias("train_id"))
    return told.join(first, "train_id", "left_semi").where("idx = _first").unionByName(told.join(last, "train_id", "left_semi").where("idx = _last")).drop("_first", "_last")


def reconciled_date(buckets: DataFrame, selected: str) -> DataFrame:
    """One row `date`: the selected date if it is there, else the earliest dated one, else `undated`."""
    dates = buckets.where("date IS NOT NULL")
    kept = F.max(F.when(F.col("date") == selected, F.col("date")))
    return dates.agg(F.coalesce(kept, F.min(F.when(F.col("date") != UNDATED, F.col("date"))), F.lit(UNDATED)).alias("date"))


def segment_label(section_number: Column, section_name: Column, number: Column, name: Column) -> Column:
    """What a segment is called: the section's name, else the train's, else its number; then the section's number, or the train's where that differs from its name."""
    short = F.coalesce(first_truthy(section_number), F.when(~number.eqNullSafe(name), first_truthy(number)))
    return F.concat_ws("\u3000", F.coalesce(first_truthy(section_name, name, number), F.lit("")), short)
