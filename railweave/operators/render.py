"""Flat tables to draw from: route runs, markers and their styles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_m, offset_degrees, offset_path, tile_x, tile_y
from ..functions.text import hex_to_rgb
from .ranks import ranked


def shared_segments(segments: DataFrame) -> DataFrame:
    """(seg_key, train_id, trains, slot): how many trains share a segment, and which of them each is.

    segments: (train_id, train_ord, seg_key). slot counts trains by their order; it is 0 on
    segments of one train. A segment may have any share of the trains: places come from ranges, not from a window by segment.
    """
    once = segments.groupBy("seg_key", "train_id").agg(F.min("train_ord").alias("train_ord"))
    placed = ranked(once, ["seg_key"], ["train_ord", "train_id"], "_place", total="trains")
    return placed.select("seg_key", "train_id", "trains", F.when(F.col("trains") > 1, F.col("_place") - 1).otherwise(0).cast("int").alias("slot"))


def first_occurrences(segments: DataFrame) -> DataFrame:
    """Per train the first of each undirected segment (train_id, seq, src, dst), loops dropped, with `line`: the stretch it belongs to."""
    key = F.concat_ws("|", F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string"))
    first = segments.where("src <> dst").withColumn("_rn", F.row_number().over(Window.partitionBy("train_id", key).orderBy("seq"))).where("_rn = 1").drop("_rn")
    w = Window.partitionBy("train_id").orderBy("seq")
    breaks = F.when(F.lag("dst").over(w).eqNullSafe(F.col("src")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return first.withColumn("_break", breaks).withColumn("line", F.sum("_break").over(w) - 1).drop("_break")


def overlap_runs(segments: DataFrame) -> DataFrame:
    """(train_id, run, first_seq, last_seq, trains, slot): stretches of consecutive segments with equal sharing; runs share their border vertex."""
    w = Window.partitionBy("train_id").orderBy("seq")
    same = F.lag("trains").over(w).eqNullSafe(F.col("trains")) & F.lag("slot").over(w).eqNullSafe(F.col("slot")) & (F.row_number().over(w) > 1)
    runs = segments.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w) - 1)
    return runs.groupBy("train_id", "run").agg(F.min("seq").alias("first_seq"), (F.max("seq") + 1).alias("last_seq"), F.first("trains").alias("trains"), F.first("slot").alias("slot"))


def route_style(emphasis: Column, weight: Column, ridden: Column, dim: float = 0.25, wider: float = 2.0) -> Column:
    """struct<shown, width, opacity>: a segment that is not ridden is not drawn; the selected train is wider, others dim."""
    width = F.when(F.coalesce(weight, F.lit(0.0)) == 0, F.lit(6.0)).otherwise(weight) + F.when(emphasis == 2, F.lit(wider)).otherwise(0.0)
    return F.struct(F.coalesce(ridden, F.lit(False)).alias("shown"), width.alias("width"), F.when(emphasis == 0, F.lit(dim)).otherwise(F.lit(1.0)).alias("opacity"))


def marker_style(stop_type: Column, emphasis: Column, radius: float = 6.0) -> Column:
    """struct<category, radius, opacity> of a stop's marker."""
    category = F.when(stop_type.isin("origin", "destination"), "terminal").when(stop_type == "pass_through", "passed").otherwise("stop")
    size = F.when(stop_type.isin("origin", "destination"), radius * 1.25).when(stop_type == "pass_through", radius * 0.5).otherwise(radius)
    return F.struct(category.alias("category"), (size + F.when(emphasis == 2, 1.5).otherwise(0.0)).alias("radius"), F.when(emphasis == 0, 0.25).otherwise(1.0).alias("opacity"))


def markers(stops: DataFrame, passed: DataFrame) -> DataFrame:
    """Stops that are ridden and stations only passed through, in one table with a category and a null-free radius."""
    level = F.coalesce(F.col("emphasis"), F.lit(1))
    own = stops.where("effective_ride").select("train_id", "station_id", marker_style(F.col("stop_type"), level).alias("style"))
    more = passed.select("train_id", "station_id", marker_style(F.lit("pass_through"), F.lit(1)).alias("style"))
    return own.unionByName(more).select("train_id", "station_id", "style.*")


def route_signature(routes: DataFrame) -> DataFrame:
    """(train_id, signature) that changes when a train's drawn route does."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "signature"))), lambda x: x["signature"].cast("string")), "|")
    told = routes.withColumn("signature", F.xxhash64(*[c for c in routes.columns if c != "train_id"]))
    return told.groupBy("train_id").agg(F.xxhash64(parts).alias("signature"))


def draw_order(trains: DataFrame, emphasis: Column) -> DataFrame:
    """`trains` with `place`: from bottom to top by emphasis, then by their own order (ord); places count up over the whole table.

    Rows are sorted by ranges over the cluster; only row counts of the ranges are summed, one row a range.
    """
    from ..checkpoints import stored

    told = stored(trains.withColumn("_tier", emphasis).orderBy("_tier", "ord").withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = told.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = told.join(F.broadcast(before.drop("_n")), "_part").withColumn("place", F.col("_before") + F.col("_id") - F.col("_least"))
    return numbered.drop("_tier", "_part", "_id", "_least", "_before")


def densified(stops: DataFrame, step_m: float = 3000.0) -> DataFrame:
    """(lon, lat): the stops of trains (train_id, idx, lon, lat) and points between neighbours, a hop cut in as many parts as whole steps fit in it."""
    w = Window.partitionBy("train_id").orderBy("idx")
    hops = stops.select("lon", "lat", F.lead("lon").over(w).alias("b_lon"), F.lead("lat").over(w).alias("b_lat"))
    n = F.greatest(F.lit(1), F.floor(F.coalesce(haversine_m(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat")) / step_m, F.lit(1.0))).cast("int"))
    steps = hops.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c: F.col(c) + (F.coalesce(f"b_{c}", c) - F.col(c)) * F.col("k") / F.col("n")
    return steps.select(at("lon").alias("lon"), at("lat").alias("lat"))


#: Zooms of the tiles that are kept, each with the tiles around a point.
TILE_BUFFER = {5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 2, 12: 2}


def corridor_tiles(points: DataFrame, buffer: dict[int, int] | None = None) -> DataFrame:
    """(z, x, y): map tiles at the points and so many tiles around them at each zoom, each once; the points are read once."""
    at = [F.struct(F.lit(z).alias("z"), F.lit(b).cast("bigint").alias("b"), tile_x(F.col("lon"), z).alias("x0"), tile_y(F.col("lat"), z).alias("y0")) for z, b in (buffer or TILE_BUFFER).items()]
    centres = points.select(F.explode(F.array(*at)).alias("t")).select("t.*").distinct()
    span = lambda c: F.explode(F.sequence(F.col(c) - F.col("b"), F.col(c) + F.col("b")))
    around = centres.withColumn("x", span("x0")).withColumn("y", span("y0")).withColumn("n", F.pow(F.lit(2), F.col("z")))
    return around.where((F.col("x") >= 0) & (F.col("x") < F.col("n")) & (F.col("y") >= 0) & (F.col("y") < F.col("n"))).select("z", "x", "y").distinct()


#: Tiles a line may span on a side to be drawn whole; pixels of lanes and of what can be clicked.
WHOLE_TILES, LANE_PX, LEAST_PICK_PX, PICK_MORE_PX, PICK_PX = 4, 6.0, 6.0, 8.0, 14.0


def tile_pieces(lines: DataFrame, zoom: int) -> DataFrame:
    """(line_id, x, y, piece): the tiles a line (line_id, points) is drawn on.

    A line that spans few tiles is drawn whole (piece NULL) on each tile of its box, another
    by pieces, numbered from 0, on the tiles of their boxes. A line of one point is a box; one
    without points is on none.
    """
    tiles = lambda points: F.transform(points, lambda p: F.struct(tile_x(p["lon"], zoom).alias("x"), tile_y(p["lat"], zoom).alias("y")))
    least, most = (lambda c: F.array_min(F.col(f"_t.{c}"))), (lambda c: F.array_max(F.col(f"_t.{c}")))
    boxed = lines.where(F.size("points") > 0).select("line_id", tiles(F.col("points")).alias("_t")).select("line_id", "_t", *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, least), (1, most))))
    whole = (F.col("x1") - F.col("x0") <= WHOLE_TILES) & (F.col("y1") - F.col("y0") <= WHOLE_TILES)
    box = lambda x0, x1, y0, y1, piece: F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), piece.cast("int").alias("piece"))
    one = F.array(box(*(F.col(c) for c in ("x0", "x1", "y0", "y1")), F.lit(None)))
    hop = lambda a, k: (lambda b: box(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]), k))(F.col("_t")[k + 1])
    many = F.transform(F.slice("_t", 1, F.size("_t") - 1), hop)
    boxes = boxed.select("line_id", F.explode(F.when(whole, one).otherwise(many)).alias("b"))
    across = boxes.select("line_id", "b.*").withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return across.select("line_id", "x", "y", "piece")


def route_records(segments: DataFrame, trains: DataFrame, zoom: float) -> DataFrame:
    """(train_id, run, path, pick_path, r, g, b, alpha, width, pick_width, trains, slot): what is drawn, a row for each run of equal sharing.

    segments: (train_id, seq, from_lon, from_lat, to_lon, to_lat, shown, trains, slot), in order
    of seq; trains: (train_id, color, style struct<width, opacity>). Segments that are not
    shown are not drawn and end a run, and so does a gap in seq. The path stays on its track;
    where trains share it, `pick_path` is moved aside into the lane of the slot.
    """
    w = Window.partitionBy("train_id").orderBy("seq")
    drawn = segments.where(F.coalesce(F.col("shown"), F.lit(False)))
    same = (F.lag("trains").over(w) == F.col("trains")) & (F.lag("slot").over(w) == F.col("slot")) & (F.lag("seq").over(w) == F.col("seq") - 1)
    numbered = drawn.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w) - 1)
    point = lambda end: F.struct(F.col(f"{end}_lon").alias("lon"), F.col(f"{end}_lat").alias("lat"))
    runs = numbered.groupBy("train_id", "run").agg(F.array_sort(F.collect_list(F.struct("seq", point("from").alias("a")))).alias("_s"), F.max_by(point("to"), "seq").alias("_end"), F.first("trains").alias("trains"), F.first("slot").alias("slot"))
    path = F.concat(F.transform("_s", lambda x: x["a"]), F.array("_end"))
    told = runs.withColumn("path", path).join(trains.select("train_id", "color", "style"), "train_id").where("style.opacity > 0")
    lane = (F.col("slot") - (F.col("trains") - 1) / 2) * offset_degrees(F.lit(LANE_PX), F.col("path")[0]["lat"], zoom)
    shared, width = F.col("trains") > 1, F.col("style.width")
    alpha = F.round(F.least(F.col("style.opacity"), F.lit(1.0)) * 255).cast("int")
    pick = F.when(shared, F.greatest(F.lit(LANE_PX), F.lit(LEAST_PICK_PX))).otherwise(F.greatest(width + PICK_MORE_PX, F.lit(PICK_PX)))
    return told.select("train_id", "run", "path", F.when(shared & (lane != 0), offset_path(F.col("path"), lane)).otherwise(F.col("path")).alias("pick_path"), hex_to_rgb(F.col("color")).alias("_c"), alpha.alias("alpha"), width.alias("width"), pick.alias("pick_width"), "trains", "slot").select("train_id", "run", "path", "pick_path", "_c.*", "alpha", "width", "pick_width", "trains", "slot")


def split_markers(markers: DataFrame, hidden: list[str], selected: Column) -> DataFrame:
    """Markers of the categories that are not hidden, with `layer`: those of the selected train lie on top of the base."""
    shown = markers.where(~F.coalesce(F.col("category").isin(*hidden), F.lit(False))) if hidden else markers
    return shown.withColumn("layer", F.when(F.coalesce(selected, F.lit(False)), "selected").otherwise("base"))


def fit_bounds(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(train_id, source, west, south, east, north): the box of a train's routes (train_id, points), or of its stops (train_id, lon, lat) where it has none."""
    sides = lambda lon, lat: [F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north")]
    points = routes.select("train_id", F.explode("points").alias("p"), F.lit("routes").alias("source")).select("train_id", "source", "p.lon", "p.lat")
    both = points.unionByName(stops.select("train_id", F.lit("stops").alias("source"), "lon", "lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    boxes = both.groupBy("train_id", "source").agg(*sides("lon", "lat"))
    # `routes` sorts before `stops`.
    best = boxes.groupBy("train_id").agg(F.min(F.struct("source", "west", "south", "east", "north")).alias("b"))
    return best.select("train_id", "b.*")
