"""The routable network: edges, nodes, transfers, costs.

edges: (src, dst, length_m, line, operator, institution, class_code, is_connector,
connector_codes), each undirected edge in both directions.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_m

#: Metres that decide about transfers, and what wrong lines, operators and institutions cost.
GROUP_M, GROUP_NODES, TRANSFER_M, TRANSFER_COST_M = 520.0, 24, 900.0, 180.0
OFF_LINE, OFF_OPERATOR, OFF_INSTITUTION, OFF_INSTITUTION_M = 8.0, 6.0, 180.0, 5000.0


def section_edges(sections: DataFrame) -> DataFrame:
    """Edges between consecutive vertices of sections (section_id, points with id, lon, lat; attributes), both ways.

    A hop to the same point is dropped; a length is 0.01 m at least.
    """
    hops = sections.withColumn("hop", F.explode(F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))))
    a, b = F.col("hop.a"), F.col("hop.b")
    length = F.greatest(haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]), F.lit(0.01))
    rest = [c for c in sections.columns if c != "points"]
    told = hops.where(a["id"] != b["id"]).select(*rest, a["id"].alias("src"), b["id"].alias("dst"), length.alias("length_m"))
    return both_ways(told)


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def node_meta(edges: DataFrame) -> DataFrame:
    """(node, lines, operators, institutions): sorted distinct values of the edges at each node."""
    sets = {f"{c}s": F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))) for c in ("line", "operator", "institution")}
    return edges.groupBy(F.col("src").alias("node")).agg(*(v.alias(k) for k, v in sets.items()))


def transfer_edges(members: DataFrame) -> DataFrame:
    """(group_key, src, dst, gap_m, length_m): connectors between the nodes of a transfer group.

    members: (group_key, node_id, lon, lat, metres to the group's station), and institution
    where connectors are to tell what they join: connector_codes. Of the nodes within
    GROUP_M the GROUP_NODES nearest take part, so a group has a bounded number of pairs; a
    pair up to TRANSFER_M apart is joined once, in the group that sorts first.
    """
    told = "institution" in members.columns
    members = members if told else members.withColumn("institution", F.lit(""))
    near = members.where(F.col("metres") <= GROUP_M).groupBy("group_key", "node_id").agg(F.min("metres").alias("metres"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.min_by("institution", F.struct("metres", "institution")).alias("institution"))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("group_key").orderBy("metres", "node_id"))).where(F.col("_k") <= GROUP_NODES)
    other = ranked.select("group_key", F.col("node_id").alias("o_id"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.col("institution").alias("o_institution"))
    pairs = ranked.join(other, "group_key").where("node_id < o_id").withColumn("gap_m", haversine_m(F.col("lon"), F.col("lat"), F.col("o_lon"), F.col("o_lat"))).where(F.col("gap_m") <= TRANSFER_M)
    first = pairs.groupBy(F.col("node_id").alias("src"), F.col("o_id").alias("dst")).agg(F.min("group_key").alias("group_key"), F.min_by("gap_m", "group_key").alias("gap_m"), F.min_by(F.array_sort(F.array_distinct(F.filter(F.array("institution", "o_institution"), lambda c: c != ""))), "group_key").alias("connector_codes"))
    return (first if told else first.drop("connector_codes")).withColumn("length_m", F.col("gap_m") + TRANSFER_COST_M)


def edge_allowed(institution: Column, connector_codes: Column, is_connector: Column, allowed: Column) -> Column:
    """A connector passes if every institution it joins is allowed, another edge if its own is; blanks pass."""
    one = lambda c: (c == "") | F.array_contains(allowed, c)
    return F.when(is_connector, F.forall(F.coalesce(connector_codes, F.array().cast("array<string>")), one)).otherwise(one(F.coalesce(institution, F.lit(""))))


def node_allowed(institutions: Column, allowed: Column) -> Column:
    """Whether a node lies on track of any allowed institution; no list of allowed ones allows all, a node without institutions is on none."""
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(institutions, allowed), F.lit(False))


def edge_required(line: Column, operator: Column, is_connector: Column, lines: Column, operators: Column) -> Column:
    """Connectors pass; others need a required line and a required operator, where such are given."""
    return is_connector | (((F.size(lines) == 0) | F.array_contains(lines, line)) & ((F.size(operators) == 0) | F.array_contains(operators, operator)))


def edge_cost(length: Column, is_connector: Column, off_line: Column, off_operator: Column, off_institution: Column, hard: Column) -> Column:
    """Length and what is charged for a wrong line, operator and (unless institutions are a hard rule) institution."""
    more = F.when(off_institution & ~hard, length * OFF_INSTITUTION + OFF_INSTITUTION_M).otherwise(0.0) + F.when(off_line, length * OFF_LINE).otherwise(0.0) + F.when(off_operator, length * OFF_OPERATOR).otherwise(0.0)
    return length + F.when(is_connector, 0.0).otherwise(more)


def path_penalty(hops: DataFrame) -> DataFrame:
    """(path_id, penalty, institutions): line and operator charges and the institutions along a path.

    hops: (path_id, length_m, is_connector, off_line, off_operator, institution).
    """
    charge = F.when(F.col("is_connector"), 0.0).otherwise(F.when(F.col("off_line"), F.col("length_m") * OFF_LINE).otherwise(0.0) + F.when(F.col("off_operator"), F.col("length_m") * OFF_OPERATOR).otherwise(0.0))
    return hops.groupBy("path_id").agg(F.sum(charge).alias("penalty"), F.array_sort(F.collect_set(F.when(F.col("institution") != "", F.col("institution")))).alias("institutions"))


def profile(frame: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of the columns: (property, value, n), in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns)))
    return frame.select(pairs.alias("p")).groupBy("p.property", "p.value").agg(F.count("*").alias("n"))


def content_hash(edges: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, hash) that changes when the network does, whatever the order of its rows.

    hash: the sum of 60 bits of the MD5 of each row, so repeated rows count each time. The
    columns are those that matter to paths, if none are named; doubles count to the millimetre.
    """
    columns = columns or tuple(c for c in ("src", "dst", "length_m", "line", "operator", "institution", "is_connector") if c in edges.columns)
    kinds = dict(edges.dtypes)
    told = F.concat_ws("|", *(F.coalesce(F.round(F.col(c) * 1000).cast("bigint").cast("string") if kinds[c] == "double" else F.col(c).cast("string"), F.lit("")) for c in columns))
    bits = F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return edges.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("hash"))


def jump_classes(hops: DataFrame, far_m: float = 120.0) -> DataFrame:
    """(kind, n, longest_m) of hops (metres, is_connector, is_end) longer than `far_m`."""
    kind = F.when(F.col("is_connector"), "connector chord").when(F.col("is_end"), "endpoint snap").otherwise("rail edge")
    return hops.where(F.col("metres") > far_m).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("metres").alias("longest_m"))
