"""Auditing connectors: what rail alone joins, how long the way by rail is, and what routes are without connectors."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import regions, solve

#: The longest way by rail that is looked for, and how many times the chord it may be long to count as parallel.
RAIL_LIMIT_M, PARALLEL = 30_000.0, 1.5
#: Edges of whole components that one task holds, about.
PACK_EDGES = 20_000


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component): for each node with an edge the least node id that edges (src, dst) lead to, in either direction.

    Every node has a parent, at first itself or a lesser neighbour. In a round each node
    looks at the parents' parents of its neighbours; it and its own parent move to the least
    of these, and to its parent's parent: trees are hung on each other and halved in depth
    at once, so rounds grow with the logarithm of the longest way. Parents only fall, so a
    round that leaves their sum alone is the last. `store` cuts the lineage, and gives the
    joins plain exchanges on both sides, so Spark can split a parent or node with very many
    rows. Loops, repeats and null ends do not matter; without edges the result is empty.
    """
    pairs = edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")).where("a <> b")
    links = store(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    loops = edges.select(F.explode(F.array(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))).alias("node")).where("node IS NOT NULL").select("node", F.col("node").alias("parent"))
    parents = store(links.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")).unionByName(loops).groupBy("node").agg(F.min("parent").alias("parent")))
    total = lambda frame: frame.agg(F.sum(F.col("parent").cast("decimal(38,0)"))).first()[0]
    before, now = None, total(parents)
    while now is not None and now != before:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        told = store(parents.join(up, "parent"))
        near = store(links.join(told.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near")))
        seen = told.join(near, "node", "left").withColumn("least", F.least("parent", "grand", "near"))
        offers = seen.select("node", F.col("least").alias("parent")).unionByName(seen.select(F.col("parent").alias("node"), F.col("least").alias("parent")))
        parents = store(offers.groupBy("node").agg(F.min("parent").alias("parent")))
        before, now = now, total(parents)
    return parents.select("node", F.col("parent").alias("component"))


def _plain(rows: DataFrame) -> DataFrame:
    """`rows` (section_id, src, dst) as sections that follow no hints."""
    none, end = F.array().cast("array<string>"), lambda c: F.array(F.struct(F.col(c).alias("node"), F.lit(0.0).alias("snap_m")))
    return rows.withColumns({c: none for c in ("req_lines", "req_operators", "pref_lines", "pref_operators", "allowed")} | {"hard": F.lit(False), "sources": end("src"), "targets": end("dst")})


def rail_ways(chords: DataFrame, rails: DataFrame, limit_m: float = RAIL_LIMIT_M, parts: DataFrame | None = None, pack_edges: int = PACK_EDGES) -> DataFrame:
    """(chord_id, rail_m): the shortest way by rail between the ends of each chord, where it is no longer than `limit_m`.

    chords: (chord_id, src, dst); rails: (src, dst, length_m and other edge columns, src_lon,
    src_lat, dst_lon, dst_lat), without connectors; parts: as of `components`, if known. No
    way leaves its component, so those of up to `pack_edges` edges are packed, each once, in
    regions of about so many. Larger ones are cut: no way within the limit leaves the box
    that has so many metres around the ends, so one wave over these boxes is exact.
    """
    places = rails.select(F.col("src").alias("node"), F.col("src_lon").alias("lon"), F.col("src_lat").alias("lat")).dropDuplicates(["node"])
    parts = places.select("node", F.lit(0).alias("component")) if parts is None else parts
    at = lambda end, to: places.select(F.col("node").alias(end), F.col("lon").alias(f"{to}_lon"), F.col("lat").alias(f"{to}_lat"))
    of = parts.select(F.col("node").alias("src"), "component")
    asked = _plain(chords.select(F.col("chord_id").alias("section_id"), "src", "dst").join(at("src", "from"), "src").join(at("dst", "to"), "dst").join(of, "src"))
    held = rails.join(of, "src").join(asked.select("component").distinct(), "component", "left_semi")
    large = held.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > pack_edges).select("component")
    packs = -(-rails.count() // pack_edges) or 1
    packed = lambda frame: frame.join(large, "component", "left_anti").withColumn("region", F.concat(F.lit("pack "), F.pmod(F.xxhash64("component"), F.lit(packs)).cast("string")))
    boxed = regions.with_region(asked.join(large, "component", "left_semi"), limit_m, 0.0).withColumn("region", F.concat_ws(";", F.col("component").cast("string"), "region"))
    own = held.join(large, "component", "left_semi")
    boxed = regions.spread(boxed, edges=own)
    rows = packed(asked).unionByName(boxed.drop("x0", "x1", "y0", "y1"))
    inside = packed(held).unionByName(regions.edges_in(boxed, own, "component"))
    # Without the places of nodes no way counts as a detour.
    found = solve.solve_wave(rows.drop("component"), inside.drop("component", "src_lon", "src_lat", "dst_lon", "dst_lat"))
    return found.where(F.col("metres") <= limit_m).select(F.col("section_id").alias("chord_id"), F.col("metres").alias("rail_m"))


def ratio(rail_m: Column, chord_m: Column) -> Column:
    """How many times a chord the way by rail is long, at one decimal; null without a way."""
    return F.when(chord_m > 0, F.round(rail_m / chord_m, 1))


def verdict(connected: Column, rail_m: Column, times: Column) -> Column:
    """apart: rail does not join the ends; none in limit; parallel; shortcut."""
    return F.when(~connected, "apart").when(rail_m.isNull(), "none in limit").when(times <= PARALLEL, "parallel").otherwise("shortcut")


def chord_audit(chords: DataFrame, rails: DataFrame, store: Callable[[DataFrame], DataFrame], limit_m: float = RAIL_LIMIT_M) -> DataFrame:
    """(src, dst, chord_m, connected, rail_m, ratio, verdict) for each chord (src, dst, chord_m).

    A chord is a hop over a connector: repeats, and the two directions of one, are one
    chord, with the least chord_m. Ends that no rail touches are apart. rails: see `rail_ways`.
    """
    once = chords.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "chord_m").groupBy("src", "dst").agg(F.min("chord_m").alias("chord_m"))
    parts = store(components(rails, store))
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    told = store(once.join(of("src"), "src", "left").join(of("dst"), "dst", "left").withColumn("connected", F.coalesce(F.col("src_part") == F.col("dst_part"), F.lit(False))).drop("src_part", "dst_part"))
    told = store(told.withColumn("chord_id", F.monotonically_increasing_id()))
    ways = rail_ways(told.where("connected AND src <> dst"), rails, limit_m, parts)
    judged = told.join(ways, "chord_id", "left").withColumn("ratio", ratio(F.col("rail_m"), F.col("chord_m")))
    return judged.select("src", "dst", "chord_m", "connected", "rail_m", "ratio", verdict(F.col("connected"), F.col("rail_m"), F.col("ratio")).alias("verdict"))


def without_connectors(sections: DataFrame, edges: DataFrame, store: Callable[[DataFrame], DataFrame], **more) -> DataFrame:
    """(section_id, with_m, without_m, change, outcome): each section solved over all edges and over rail alone.

    sections, edges and `more`: see `regions.solve_sections`. change: the share by which the
    way is longer without connectors. outcome: same (no connector was used, or the way is as
    long), other, lost (no way without), unsolved (none with them either).
    """
    solved = lambda over, name: regions.solve_sections(sections, over, store, **more).where("path IS NOT NULL").select("section_id", F.col("metres").alias(name))
    both = sections.select("section_id").distinct().join(solved(edges, "with_m"), "section_id", "left").join(solved(edges.where("NOT is_connector"), "without_m"), "section_id", "left")
    change = F.when(F.col("with_m") > 0, F.col("without_m") / F.col("with_m") - 1)
    outcome = F.when(F.col("with_m").isNull(), "unsolved").when(F.col("without_m").isNull(), "lost").when(F.abs(change) < 1e-9, "same").otherwise("other")
    return both.select("section_id", "with_m", "without_m", change.alias("change"), outcome.alias("outcome"))


def compared_totals(compared: DataFrame, *by: str) -> DataFrame:
    """For each group of `by`: sections, lost, other, with_m and without_m of sections solved both ways, and the share by which the sum changes."""
    both = F.col("with_m").isNotNull() & F.col("without_m").isNotNull()
    sums = compared.groupBy(*by).agg(F.count("*").alias("sections"), F.count_if(F.col("outcome") == "lost").alias("lost"), F.count_if(F.col("outcome") == "other").alias("other"), F.sum(F.when(both, F.col("with_m"))).alias("with_m"), F.sum(F.when(both, F.col("without_m"))).alias("without_m"))
    return sums.withColumn("change", F.when(F.col("with_m") > 0, F.col("without_m") / F.col("with_m") - 1))
