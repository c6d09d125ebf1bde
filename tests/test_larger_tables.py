"""What crowded cells, hot names and long lines must not change."""

from pyspark.sql import functions as F

from railweave.functions.geo import haversine_m
from railweave.operators import documents, pairs, regions, resolve, route, solve


def test_near_nodes_reads_no_crowd(spark):
    """A crowded cell: the nearest nodes of each point equal brute force, without meeting every node around."""
    nodes = spark.range(6000).selectExpr("id AS node_id", "13000000 + (id * 37) % 2000 AS lon_e5", "3500000 + (id * 101) % 1500 AS lat_e5").unionByName(spark.range(6000, 6040).selectExpr("id AS node_id", "13000900L AS lon_e5", "3500900L AS lat_e5")).localCheckpoint()
    points = spark.range(40).selectExpr("id AS point_id", "13000900 + (id * 31) % 1300 AS lon_e5", "3500900 + (id * 53) % 900 AS lat_e5").localCheckpoint()
    pairs = points.selectExpr("point_id", "lon_e5 AS a", "lat_e5 AS b").crossJoin(nodes).where("abs(floor(a / 1000) - floor(lon_e5 / 1000)) <= 1 AND abs(floor(b / 1000) - floor(lat_e5 / 1000)) <= 1")
    far = pairs.select("point_id", "node_id", haversine_m(F.col("a") / 100000, F.col("b") / 100000, F.col("lon_e5") / 100000, F.col("lat_e5") / 100000).alias("metres")).collect()
    for limit, within in ((3, None), (30, 400.0), (None, 250.0)):
        want = set()
        for p in range(40):
            some = sorted((r["metres"], r["node_id"]) for r in far if r["point_id"] == p and (within is None or r["metres"] <= within))
            want |= {(p, node, k + 1) for k, (_, node) in enumerate(some[:limit])}
        found = resolve.near_nodes(points, nodes, limit, within_m=within)
        assert {(r["point_id"], r["node_id"], r["place"]) for r in found.collect()} == want and want


def test_all_nodes_near_a_station_count(spark):
    """More nodes than an endpoint looks at: none is left out where all are asked for."""
    nodes = spark.range(400).selectExpr("id AS node_id", "13000000 + id % 20 AS lon_e5", "3500000 + id div 20 AS lat_e5")
    station = spark.range(1).selectExpr("id AS station_id", "array(named_struct('lon_e5', 13000010L, 'lat_e5', 3500010L)) AS vertices")
    assert route.station_nodes(station, nodes, most=None).count() == 400
    assert route.station_nodes(station, nodes).count() == route.SNAP_NODES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_attempts_are_told_within_a_row(spark):
    none = "CAST(array() AS array<string>)"
    hints = spark.range(2).selectExpr("id AS section_id", f"{none} AS explicit_lines", f"{none} AS explicit_operators", f"IF(id = 0, array('b', 'a'), {none}) AS common_lines", f"{none} AS common_operators")
    ladder = solve.attempt_ladder(hints)
    assert "Exchange" not in plan(ladder)
    got = sorted((r["section_id"], r["attempt"], r["mode"], tuple(r["req_lines"])) for r in ladder.collect())
    assert got == [(0, 1, solve.COMMON_LINE_HOME, ("a", "b")), (0, 3, solve.HOME, ()), (0, 4, solve.COMMON_LINE_SOFT, ("a", "b")), (0, 5, solve.SOFT, ()), (0, 7, solve.UNBIASED, ()), (1, 3, solve.HOME, ()), (1, 6, solve.SOFT_WITHOUT_COMMON, ()), (1, 7, solve.UNBIASED, ())]


def test_documents_are_read_once(spark):
    raws = [(1, '{"id":"a"}'), (2, '{"id":"a"}'), (3, '{"name":"x"}'), (4, '{"name":"x"}'), (5, '{"id":""}'), (6, '{"id":""}'), (7, "[1]"), (8, "{"), (9, " \n{}")]
    sent = spark.createDataFrame([("s", ord, raw) for ord, raw in raws], "source string, ord bigint, raw string")
    found = documents.violations(sent)
    assert plan(found).count("Scan ExistingRDD") == 1
    rules = {(r["ord"], r["rule"]) for r in found.collect()}
    assert {o for o, rule in rules if rule == "id_repeated"} == {2} and {o for o, rule in rules if rule == "not_an_object"} == {7, 8}


def test_pairs_of_a_hot_key_are_dealt(spark):
    left, right = spark.range(50).selectExpr("id AS a", "IF(id < 45, 'hot', 'cold') AS k"), spark.range(70).selectExpr("id AS b", "IF(id < 60, 'hot', 'cold') AS k")
    found = pairs.met(left, right, "k", "a", "b", pairs_a_task=100)
    assert found.count() == found.distinct().count() == 45 * 60 + 5 * 10
    assert found.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 45 * 60 / 2


def test_endpoints_across_the_date_line_are_near(spark):
    s = spark.createDataFrame([(1, 1, "a", "2", 179.999, 10.0), (2, 2, "a", "1", -179.999, 10.0), (3, 3, "a", "1", 0.0, 10.0)], "station_id bigint, ord bigint, norm_name string, institution string, lon double, lat double")
    c = spark.createDataFrame([(7, "a", 1, 1)], "stop_id bigint, norm_name string, station_id bigint, ord bigint")
    found = resolve.expand_endpoint(c, s, ["1"])
    assert sorted((r["place"], r["station_id"]) for r in found.collect()) == [(1, 2), (2, 1)]


def test_nodes_near_stations_go_through_no_driver(spark):
    """Small tables too: neither points nor nodes, nor stations of a snap, are sent to every task; the result is that of brute force."""
    nodes = spark.range(900).selectExpr("id AS node_id", "13000000 + (id * 37) % 2000 AS lon_e5", "3500000 + (id * 101) % 1500 AS lat_e5").localCheckpoint()
    stations = spark.range(30).selectExpr("id AS station_id", "array(named_struct('lon_e5', 13000000 + id * 61, 'lat_e5', 3500000 + id * 47), named_struct('lon_e5', 13000000 + id * 60, 'lat_e5', 3500100 + id * 47)) AS vertices").localCheckpoint()
    near = route.station_nodes(stations, nodes, most=None)
    points = stations.selectExpr("station_id", "inline(vertices)").selectExpr("station_id", "lon_e5 AS a", "lat_e5 AS b")
    far = points.crossJoin(nodes).select("station_id", "node_id", haversine_m(F.col("a") / 100000, F.col("b") / 100000, F.col("lon_e5") / 100000, F.col("lat_e5") / 100000).alias("m")).where(F.col("m") <= route.SNAP_M)
    rows = lambda found: sorted((r["station_id"], r["node_id"], round(r["m"], 6)) for r in found.collect())
    assert rows(near.withColumnRenamed("metres", "m")) == rows(far.groupBy("station_id", "node_id").agg(F.min("m").alias("m"))) != []
    none = "CAST(array() AS array<string>)"
    asked = spark.range(20).selectExpr("id AS ask_id", "array(named_struct('station_id', id, 'place', 1), named_struct('station_id', id + 1, 'place', 2)) AS stations", f"{none} AS req_lines", f"{none} AS req_operators", "array('a') AS pref_lines", f"{none} AS pref_operators", "array('1') AS allowed", "false AS home")
    meta = nodes.selectExpr("node_id AS node", "array(IF(node_id % 2 = 0, 'a', 'b')) AS lines", "array('x') AS operators", "array('1') AS institutions")
    told = route.snapped(asked, near, stations.selectExpr("station_id", "'a' AS line", "'x' AS operator"), meta, per_station=None, per_endpoint=None)
    assert "Broadcast" not in plan(near) and "Broadcast" not in plan(told)
    ends = {r["ask_id"]: r["ends"] for r in told.collect()}
    want = {}
    for r in near.collect():
        for ask, place in ((r["station_id"], 1), (r["station_id"] - 1, 2)):
            if 0 <= ask < 20:
                want[ask, r["node_id"]] = min(want.get((ask, r["node_id"]), (9,)), (place, r["metres"]))
    assert {(a, e["node"], e["snap_m"]) for a, found in ends.items() for e in found} == {(a, n, m) for (a, n), (_, m) in want.items()}
    assert all([e["node"] % 2 for e in found] == sorted(e["node"] % 2 for e in found) for found in ends.values())


def test_edges_of_a_line_are_hardly_copied(spark):
    """Two lines in one box: each stretch has the hops that its sections need, and few more."""
    at = spark.range(2000).selectExpr("IF(id < 1500, 'a', 'b') AS chain", "IF(id < 1500, id, id - 1500) + 1 AS place", "id")
    sections, edges = regions.along(at.withColumnRenamed("id", "section_id"), at.selectExpr("chain", "place", "id AS src", "id + 1 AS dst"), 9, 100)
    copies = edges.collect()
    held = {(r["region"], r["src"]) for r in copies}
    assert len(held) == len(copies) and len(copies) < 2000 * 1.15
    last = {r["id"]: 1500 if r["chain"] == "a" else 2000 for r in at.collect()}
    for r in sections.collect():
        assert all((r["region"], k) in held for k in range(r["section_id"], min(r["section_id"] + 9, last[r["section_id"]])))


def test_line_paths_share_out_a_crowded_box(spark):
    from railweave.plans import queries

    copies, solved = [], solve.solve_wave
    solve.solve_wave = lambda rows, edges, **more: copies.append(edges.count()) or solved(rows, edges, **more)
    try:
        got = queries.line_path_cost(spark, "/root/testdata/sf0.01").count()
    finally:
        solve.solve_wave = solved
    assert got == 1475 and copies == [2950]
