"""Which station a stop means, and which places are near which.

stations: (station_id, ord, code, name, norm_name, line, operator, institution, group_code,
lon, lat). Every tie goes to the station that comes first by ord.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stored
from ..functions.geo import EARTH_M, cells_within, haversine_m
from .pairs import met


def station_keys(stations: DataFrame) -> DataFrame:
    """(key, station_id, ord): code, name and normalised name of each station, once each."""
    keys = F.array_distinct(F.filter(F.array(F.trim("code"), F.trim("name"), F.col("norm_name")), lambda k: k.isNotNull() & (k != "")))
    return stations.select(F.explode(keys).alias("key"), "station_id", "ord")


def resolve_stops(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(stop_id, station_id, ord, prio): the candidate stations of each stop.

    stops: (stop_id, code, name, norm_name). Of these the first that has any: stations by
    code whose normalised name agrees, or any by code if the stop has no name; by the exact
    name; by the normalised name; by code with another name. Which of these it is, is settled
    by the keys alone, so no other pairs are made, and those of a hot name in many tasks.
    """
    return _hits(_best_keys(stops, stations), _named_keys(stations)).select("stop_id", "station_id", "ord", "prio")


def _named_keys(stations: DataFrame, *columns: str) -> DataFrame:
    """`station_keys` with the normalised name and more columns, once each."""
    keyed = station_keys(stations).join(stations.select("station_id", F.col("norm_name").alias("s_norm"), *columns), "station_id")
    return keyed.distinct()


def _agrees() -> Column:
    return F.coalesce((F.col("norm") == "") | (F.col("norm") == F.col("s_norm")), F.lit(False))


def _best_keys(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(stop_id, key, norm, prio): by what each stop finds stations, seen from the keys that there are and before any pairs are made."""
    ask = lambda col, what: stops.where(F.coalesce(F.trim(col), F.lit("")) != "").select("stop_id", F.trim(col).alias("key"), F.coalesce("norm_name", F.lit("")).alias("norm"), F.lit(what).alias("what")).distinct()
    there = station_keys(stations).join(stations.select("station_id", F.col("norm_name").alias("s_norm")), "station_id").select("key", "s_norm").distinct()
    coded = ask("code", "code").join(there, "key").groupBy("stop_id", "key", "norm").agg(F.min(F.when(_agrees(), 0).otherwise(3)).alias("prio"))
    named = lambda col, what, prio: ask(col, what).drop("what").join(there.select("key"), "key", "left_semi").withColumn("prio", F.lit(prio))
    found = coded.unionByName(named("name", "name", 1)).unionByName(named("norm_name", "norm", 2))
    return stored(found.withColumn("_least", F.min("prio").over(Window.partitionBy("stop_id"))).where("prio = _least").drop("_least"))


def _hits(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs of `_best_keys` and the stations of each key."""
    pairs = met(asked, keys, "key", "stop_id", "station_id")
    return pairs.where(F.when(F.col("prio") == 0, _agrees()).when(F.col("prio") == 3, ~_agrees()).otherwise(F.lit(True)))


def dedupe_stations(stations: DataFrame) -> DataFrame:
    """The first of the stations that share code, name, line, operator and first point."""
    signature = ["code", "name", "line", "operator", "lon", "lat"]
    first = stations.groupBy(*signature).agg(F.min_by("station_id", "ord").alias("station_id"))
    return stations.join(first.select("station_id"), "station_id", "left_semi")


def nearest_anchor(candidates: DataFrame, anchors: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(stop_id, station_id): the candidate nearest to any anchor of its train, the first at a tie.

    candidates: (train_id, stop_id, station_id, ord, lon, lat); anchors: (train_id, stop_id,
    lon, lat), of which those of other stops count. Candidates that are `allowed` go first.
    Without an anchor the first candidate is taken.
    """
    a = anchors.select(F.col("train_id").alias("_t"), F.col("stop_id").alias("_s"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    met = candidates.join(a, (F.col("train_id") == F.col("_t")) & (F.col("stop_id") != F.col("_s")), "left")
    far = met.withColumn("_m", haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))).withColumn("_off", F.when(allowed, 0).otherwise(1) if allowed is not None else F.lit(0))
    rank = F.struct(F.col("_off"), F.coalesce(F.col("_m"), F.lit(float("inf"))), F.col("ord"))
    return far.groupBy("stop_id").agg(F.min_by("station_id", rank).alias("station_id"))


def nearest_resolved(stops: DataFrame, stations: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(stop_id, station_id): `nearest_anchor` of what `resolve_stops` finds, the anchors being the stops of a train that mean one station.

    stops: as of `resolve_stops`, with train_id; `allowed`: of columns of stations. The
    candidates of a stop never leave the task that finds them: what is least of each comes
    from partial aggregates of plain numbers, first the distance, then the order.
    """
    best = _best_keys(stops, stations).join(stops.select("stop_id", "train_id"), "stop_id")
    # No key is empty and no pair is told twice, so a count of one is one station.
    sure = _hits(best, _named_keys(stations)).groupBy("stop_id", "train_id").agg(F.count("*").alias("_n"), F.min("station_id").alias("station_id")).where("_n = 1")
    at = sure.join(stations.select("station_id", "lon", "lat"), "station_id").groupBy("train_id").agg(F.collect_list(F.struct("stop_id", "lon", "lat")).alias("_at"))
    others = F.filter("_at", lambda x: x["stop_id"] != F.col("stop_id"))
    asked = stored(best.join(at, "train_id", "left").select("stop_id", "key", "norm", "prio", F.explode_outer(others).alias("_x")).select("stop_id", "key", "norm", "prio", F.col("_x.lon").alias("_lon"), F.col("_x.lat").alias("_lat")))
    off = F.when(allowed, 0).otherwise(1) if allowed is not None else F.lit(0)
    keys = _named_keys(stations.withColumn("_off", off), "lon", "lat", "_off")
    far = F.coalesce(haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")), F.lit(float("inf")))
    hits = _hits(asked, keys).withColumn("_m", far).select("stop_id", "station_id", "ord", "_off", "_m")
    least = hits.groupBy("stop_id").agg(F.min("_off").alias("_b"), F.min(F.when(F.col("_off") == 0, F.col("_m"))).alias("_m0"), F.min(F.when(F.col("_off") == 1, F.col("_m"))).alias("_m1"))
    least = stored(least.select("stop_id", "_b", F.when(F.col("_b") == 0, F.col("_m0")).otherwise(F.col("_m1")).alias("_bm")))
    again = _hits(asked.join(least, "stop_id"), keys).withColumn("_m", far).where((F.col("_off") == F.col("_b")) & (F.col("_m") == F.col("_bm")))
    return again.groupBy("stop_id").agg(F.min_by("station_id", "ord").alias("station_id"))


def expand_endpoint(candidates: DataFrame, stations: DataFrame, allowed: list[str] | None = None, radius_m: float = 1800.0) -> DataFrame:
    """(stop_id, station_id, place): candidates of an endpoint with allowed stations of its name put first.

    candidates: (stop_id, norm_name, station_id, ord), with `allowed`, the institutions of
    each endpoint, where these are not the same for all. Allowed stations of the same name
    within the radius of a candidate come first; where there are none and no candidate is
    allowed, those of the name anywhere; then the candidates. A blank institution is allowed.
    """
    c = candidates if allowed is None else candidates.withColumn("allowed", F.array(*map(F.lit, allowed)))
    here = c.join(stations.select("station_id", "lon", "lat", "institution"), "station_id").withColumn("_ok", institution_allowed(F.col("institution"), F.col("allowed")))
    named = stations.select("norm_name", F.col("station_id").alias("other"), F.col("ord").alias("other_ord"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.col("institution").alias("o_institution"))
    ok = institution_allowed(F.col("o_institution"), F.col("allowed"))
    # Stations of a name meet by cells of twice the radius; only where none is near, all of the name count.
    cell = lambda lon, lat, reach: F.explode(cells_within(F.col(lon), F.col(lat), 2 * radius_m, reach))
    near = here.withColumn("_c", cell("lon", "lat", radius_m)).join(named.withColumn("_c", cell("o_lon", "o_lat", 0.0)), ["norm_name", "_c"]).where(ok)
    near = near.where(haversine_m(F.col("lon"), F.col("lat"), F.col("o_lon"), F.col("o_lat")) <= radius_m).select("stop_id", "other", "other_ord")
    open_ = here.groupBy("stop_id").agg(F.max("_ok").alias("has_allowed")).where("NOT has_allowed").join(near.select("stop_id"), "stop_id", "left_anti").select("stop_id")
    far = here.join(open_, "stop_id").select("stop_id", "norm_name", "allowed").join(named.drop("o_lon", "o_lat"), "norm_name").where(ok).select("stop_id", "other", "other_ord")
    more = near.unionByName(far).select("stop_id", F.col("other").alias("station_id"), F.struct(F.lit(0).alias("part"), F.col("other_ord").alias("ord")).alias("_rank"))
    own = candidates.select("stop_id", "station_id", F.struct(F.lit(1).alias("part"), F.col("ord").alias("ord")).alias("_rank"))
    first = more.unionByName(own).groupBy("stop_id", "station_id").agg(F.min("_rank").alias("_rank"))
    return first.select("stop_id", "station_id", F.row_number().over(Window.partitionBy("stop_id").orderBy("_rank")).alias("place"))


def match_sections(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """(train_id, segment, section): the route section of each adjacent stop pair, null if none.

    pairs: (train_id, segment, from_code, to_code, from_name, to_name); sections the same
    with `section`. A match needs both codes or both names equal and not empty; the section
    of the pair's own index is preferred, then the first. The OR is two equal-key joins.
    """
    s = sections.select(F.col("train_id").alias("_t"), "section", *(F.col(c).alias(f"s_{c}") for c in ("from_code", "to_code", "from_name", "to_name")))

    def by(kind: str) -> DataFrame:
        f, t = f"from_{kind}", f"to_{kind}"
        both = (F.col(f) != "") & (F.col(t) != "")
        return pairs.join(s, (F.col("train_id") == F.col("_t")) & (F.col(f) == F.col(f"s_{f}")) & (F.col(t) == F.col(f"s_{t}")) & both).select("train_id", "segment", "section")

    found = by("code").unionByName(by("name"))
    rank = F.struct((F.col("section") != F.col("segment")).cast("int").alias("other"), F.col("section"))
    best = found.groupBy("train_id", "segment").agg(F.min_by("section", rank).alias("section"))
    return pairs.select("train_id", "segment").join(best, ["train_id", "segment"], "left")


def pass_through_stations(endpoints: DataFrame, stops: DataFrame) -> DataFrame:
    """(train_id, station_id, at): section ends at which the train has no stop, once each, where they come first.

    endpoints: (train_id, at, station_id); stops: (train_id, station_id).
    """
    return endpoints.join(stops.select("train_id", "station_id").distinct(), ["train_id", "station_id"], "left_anti").groupBy("train_id", "station_id").agg(F.min("at").alias("at"))


def near_nodes(points: DataFrame, nodes: DataFrame, limit: int | None = 30, cell: int = 1000, within_m: float | None = None) -> DataFrame:
    """(point_id, node_id, metres, place): the nearest nodes in the 3 x 3 grid cells around each point; without `limit` all, with `within_m` those no farther.

    Both have lon_e5 and lat_e5. How far a point must look is known beforehand: no farther
    than `within_m`, and no farther than the corners of the least cell, of a cell halved
    again and again, that holds it and `limit` nodes. It meets nodes by equal cell of that
    size, so what it meets grows with `limit` and not with how crowded its cells are. Of
    nodes at one place the `limit` first can count alone. Ties go to the smaller node id.
    """
    sizes = [cell]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    at = points.select("point_id", F.col("lon_e5").alias("p_lon"), F.col("lat_e5").alias("p_lat"))
    n = nodes.select("node_id", "lon_e5", "lat_e5")
    to_e5 = 180 / math.pi * 100000 / EARTH_M
    far = cell if within_m is None else min(s for s in sizes if s >= min(cell, within_m * to_e5))
    dealt = lambda frame, lon, lat: frame.withColumn("_s", F.explode(F.array(*map(F.lit, sizes)))).withColumns({"cx": F.floor(F.col(lon) / F.col("_s")), "cy": F.floor(F.col(lat) / F.col("_s"))})
    reach = F.lit(within_m).cast("double")
    if limit is None:
        sizes, at = [far], at.withColumn("_s", F.lit(far))
        n = dealt(n, "lon_e5", "lat_e5")
    else:
        # A number of parts of its own, as few bytes become many rows.
        parts = max(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")), n.sparkSession.sparkContext.defaultParallelism)
        n = n.repartition(parts, "lon_e5", "lat_e5").withColumn("_k", F.row_number().over(Window.partitionBy("lon_e5", "lat_e5").orderBy("node_id"))).where(F.col("_k") <= limit).drop("_k")
        n = dealt(n, "lon_e5", "lat_e5")
        full = n.groupBy("_s", "cx", "cy").agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select("_s", "cx", "cy")
        least = dealt(at, "p_lon", "p_lat").join(full, ["_s", "cx", "cy"]).groupBy("point_id").agg(F.min("_s").alias("_f"))
        at = at.join(least, "point_id", "left").withColumn("_s", F.least(F.coalesce("_f", F.lit(far)), F.lit(far)))
        corner = lambda c: F.greatest(F.col(c) - F.floor(F.col(c) / F.col("_f")) * F.col("_f"), (F.floor(F.col(c) / F.col("_f")) + 1) * F.col("_f") - F.col(c)) / to_e5
        # No way along a parallel is longer than on the equator.
        reach = F.least(F.sqrt(corner("p_lon") * corner("p_lon") + corner("p_lat") * corner("p_lat")), reach)
    angle, across = reach / EARTH_M, F.cos(F.radians(F.col("p_lat") / 100000))
    wide = F.when(F.sin(angle) < across, F.ceil(F.degrees(F.asin(F.sin(angle) / across)) * 100000) + 1)
    block = lambda c: F.floor(F.col(c) / cell)
    low = lambda c, by: F.floor(F.greatest((block(c) - 1) * cell, F.col(c) - by) / F.col("_s"))
    high = lambda c, by: F.floor(F.least((block(c) + 2) * cell - 1, F.col(c) + by) / F.col("_s"))
    at = at.withColumns({"_wide": wide, "_high": F.ceil(reach * to_e5) + 1})
    at = at.withColumn("cx", F.explode(F.sequence(low("p_lon", F.col("_wide")), high("p_lon", F.col("_wide"))))).withColumn("cy", F.explode(F.sequence(low("p_lat", F.col("_high")), high("p_lat", F.col("_high"))))).select("point_id", "p_lon", "p_lat", "_s", "cx", "cy")
    beside = lambda a, b: F.abs(block(a) - block(b)) <= 1
    if limit is None:
        # As many pairs as there are: dealt by their number, and neither side is sent to every task.
        cell_of = lambda frame: frame.withColumn("_c", F.struct("cx", "cy")).drop("_s", "cx", "cy").hint("merge")
        pairs = met(cell_of(at), cell_of(n), "_c", "point_id", "node_id")
    else:
        pairs = at.hint("merge").join(n, ["_s", "cx", "cy"])
    near = pairs.where(beside("p_lon", "lon_e5") & beside("p_lat", "lat_e5")).withColumn("metres", haversine_m(F.col("p_lon") / 100000, F.col("p_lat") / 100000, F.col("lon_e5") / 100000, F.col("lat_e5") / 100000))
    if within_m is not None:
        near = near.where(F.col("metres") <= within_m)
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("point_id").orderBy("metres", "node_id")))
    kept = ranked if limit is None else ranked.where(F.col("place") <= limit)
    return kept.select("point_id", "node_id", "metres", "place")


def in_boxes(items: DataFrame, boxes: DataFrame, cell: int = 10000) -> DataFrame:
    """(item_id, box_id): items whose closed box meets a region's, by grid cells and then by the boxes themselves.

    Both have west, south, east, north in 1e-5 degrees. Items and regions go to the cells
    they cover and meet by equal cell; a pair that shares several is made in the first alone.
    """

    at = lambda c: F.floor(F.col(c) / cell)

    def dealt(frame: DataFrame, key: str, mark: str) -> DataFrame:
        told = frame.select(key, *(F.col(c).alias(mark + c) for c in ("west", "south", "east", "north")), F.explode(F.sequence(at("west"), at("east"))).alias("cx"), "south", "north")
        return told.withColumn("cy", F.explode(F.sequence(at("south"), at("north")))).drop("south", "north")

    met = dealt(items, "item_id", "i_").join(dealt(boxes, "box_id", "b_"), ["cx", "cy"])
    touching = (F.col("i_west") <= F.col("b_east")) & (F.col("b_west") <= F.col("i_east")) & (F.col("i_south") <= F.col("b_north")) & (F.col("b_south") <= F.col("i_north"))
    first = (F.col("cx") == F.greatest(at("i_west"), at("b_west"))) & (F.col("cy") == F.greatest(at("i_south"), at("b_south")))
    return met.where(touching & first).select("item_id", "box_id")


def allowed_codes(explicit: Column, default: tuple[str, ...] = ("1", "2", "3", "4", "5")) -> Column:
    """The distinct sorted institution codes of a policy; all five where none is given."""
    return F.array_sort(F.array_distinct(F.when(F.size(explicit) > 0, explicit).otherwise(F.array(*map(F.lit, default)))))


def institution_allowed(code: Column, allowed: Column) -> Column:
    """A blank code passes; another must be allowed."""
    return (F.coalesce(code, F.lit("")) == "") | F.array_contains(allowed, code)


def stop_features(stops: DataFrame, matched: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stops (train_id, idx, name, code, group_code) with the place to draw them at.

    matched: places found earlier (train_id, place, station, name, code, group_code, line,
    operator, lon, lat); the first of the train by `place` with the stop's code or name is
    taken. Else that of `resolved` (train_id, idx, code, group_code, line, operator, lon, lat).
    A stop's own code and group come first; blank codes and names meet none; source is
    `matched`, `resolved`, or NULL for stops without a place.
    """
    fields = ("code", "group_code", "line", "operator", "lon", "lat")
    keys = lambda *pairs: F.explode(F.array_distinct(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in pairs))))
    asked = stops.select("train_id", "idx", keys(("code", "code"), ("name", "name")).alias("_k")).where("_k.value <> ''")
    there = matched.select("train_id", "place", F.struct(*fields).alias("_m"), keys(("code", "code"), ("name", "station"), ("name", "name")).alias("_k")).where("_k.value <> ''")
    found = asked.join(there, ["train_id", "_k"]).groupBy("train_id", "idx").agg(F.min_by("_m", "place").alias("_m"))
    other = resolved.select("train_id", "idx", F.struct(*fields).alias("_r"))
    told = stops.join(found, ["train_id", "idx"], "left").join(other, ["train_id", "idx"], "left")
    at = F.coalesce("_m", "_r")
    own = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), at[c]).alias(c)
    source = F.when(F.col("_m").isNotNull(), "matched").when(F.col("_r").isNotNull(), "resolved")
    return told.select("train_id", "idx", "name", own("code"), own("group_code"), *(at[c].alias(c) for c in ("line", "operator", "lon", "lat")), source.alias("source"))


def filled(stops: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stops (train_id, idx, name, code) with name, code and group_code of their station; those that are not among `resolved` (train_id, idx, name, code, group_code) keep their own, without a group."""
    told = resolved.select("train_id", "idx", F.struct("name", "code", "group_code").alias("_s"))
    has = F.col("_s").isNotNull()
    return stops.join(told, ["train_id", "idx"], "left").select("train_id", "idx", *(F.when(has, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "code")), F.col("_s.group_code").alias("group_code"))
