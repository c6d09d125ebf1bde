"""Queries that do the whole job: every row of the tables takes part."""

from railweave.operators import regions, solve
from railweave.plans import queries
from railweave.plans.model import line_hops, stops

SF = "/root/testdata/sf0.001"


def test_all_trains_share_segments(spark):
    trains = {r[0] for r in stops(spark, SF).where("idx > 0").select("train_id").distinct().collect()}
    for name in ("shared_segments", "overlap_runs"):
        assert {r["train_id"] for r in queries.QUERIES[name](spark, SF).collect()} == trains


def test_all_stations_are_in_line_paths(spark):
    hops = {r[0] for r in line_hops(spark, SF).select("section_id").collect()}
    got = queries.line_path_cost(spark, SF).collect()
    assert {r["source"] for r in got} == hops and len(got) == len(hops)


def test_all_stop_pairs_are_solved(spark):
    pairs = {(r["train_id"], r["idx"] - 1) for r in stops(spark, SF).where("idx > 0").select("train_id", "idx").collect()}
    got = queries.solve_sections(spark, SF).collect()
    assert {(r["train_id"], r["segment"]) for r in got} == pairs and len(got) == len(pairs)
    assert {r["outcome"] for r in got} >= {"solved"} and all((r["attempt"] is None) == (r["outcome"] != "solved") for r in got)


def test_parallel_edges_stay(spark):
    edge = (1, 2, 5.0, "a", "x", "1", False, 0.1, 0.1, 0.1, 0.1)
    names = ["src", "dst", "length_m", "line", "operator", "institution", "is_connector", "src_lon", "src_lat", "dst_lon", "dst_lat"]
    edges = spark.createDataFrame([edge, (1, 2, 9.0, "a", "y", "1", *edge[6:])], names)
    box = spark.createDataFrame([("r", 0, 0, 0, 0)], "region string, x0 int, x1 int, y0 int, y1 int")
    assert sorted(r["operator"] for r in regions.edges_in(box, edges).collect()) == ["x", "y"]
    none = "array()"
    s = spark.range(1).selectExpr("'r' AS region", "7L AS section_id", f"CAST({none} AS array<string>) AS req_lines", "array('y') AS req_operators", f"CAST({none} AS array<string>) AS pref_lines", f"CAST({none} AS array<string>) AS pref_operators", "array('1') AS allowed", "false AS hard", "array(named_struct('node', 1L, 'snap_m', 0.0D)) AS sources", "array(named_struct('node', 2L, 'snap_m', 0.0D)) AS targets")
    assert solve.solve_wave(s, regions.edges_in(box, edges).drop("src_lon", "src_lat")).first()["metres"] == 9.0


def test_all_events_are_in_store_or_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    last = events.agg({"event_id": "max"}).first()[0]
    got = queries.upsert_counters(spark, SF).first()
    assert got["trains_total"] == events.where(f"2 * event_id > {last}").count()
    assert got["trains_after"] == events.select("user_id").distinct().count()


def test_sections_of_all_pairs_match_unless_changed(spark):
    got = queries.section_match(spark, SF).collect()
    assert all(r["section"] == r["segment"] for r in got if r["segment"] % 6 != 1)
    assert any(r["section"] == 4 for r in got) and any(r["section"] is None for r in got)
