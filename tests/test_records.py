"""Rules of sent documents, stop edits, drawn pieces and runs: odd rows that the tables do not have."""

import json

import pytest
from pyspark.sql import functions as F

from railweave.operators import documents, graph, itinerary, render, resolve, store
from railweave.sources import network

GOOD = {"id": "a", "name": "n", "number": "1", "origin": "x", "destination": "y", "stops": [{"name": "x", "stop_type": "origin", "ride_segment": True}, {"station": "y", "stop_type": "destination", "ride_segment": False, "arrival": None}]}


def sent(spark, *trains):
    rows = [("s", k, t if t is None or isinstance(t, str) else json.dumps(t)) for k, t in enumerate(trains)]
    return spark.createDataFrame(rows, "source string, ord bigint, raw string")


def broken(spark, *trains):
    return sorted((r["ord"], r["rule"]) for r in documents.violations(sent(spark, *trains)).collect())


def test_documents_that_are_no_objects(spark):
    assert broken(spark, None, "", "{", "[]", '"a"', GOOD) == [(k, "not_an_object") for k in range(5)]
    assert broken(spark) == []
    assert {r for _, r in broken(spark, {})} == {"id_missing", "name_missing", "number_missing", "origin_missing", "destination_missing", "too_few_stops"}


def test_values_that_count_as_missing(spark):
    fine = [dict(GOOD, id="b", route_sections=None, route_policy=None, style=None), dict(GOOD, id="c", route_sections=0, style={"color": ""}), dict(GOOD, id="d", route_sections=[{"from_n02_station_code": "1", "to": "2", "line_names": None}])]
    assert broken(spark, GOOD, *fine) == []
    policy = {"mode": "single_primary_route", "jr_only": False, "allow_alternatives": False, "allow_browser_straight_line_fallback": False}
    assert broken(spark, dict(GOOD, route_policy=policy)) == []
    assert broken(spark, dict(GOOD, route_policy={})) == [(0, r) for r in ("policy_allows_alternatives", "policy_allows_straight_lines", "policy_jr_only_not_boolean", "policy_mode")]
    assert broken(spark, dict(GOOD, date=None), dict(GOOD, id="b", stops={}), dict(GOOD, id="c", stops=[1, None])) == [(0, "date_invalid"), (1, "too_few_stops"), (2, "ride_segment_not_boolean"), (2, "stop_name_missing"), (2, "stop_type_missing")]


def test_repeated_ids_and_strict_reading(spark):
    assert broken(spark, GOOD, GOOD, GOOD) == [(1, "id_repeated"), (2, "id_repeated")]
    assert documents.valid_only(sent(spark, GOOD, dict(GOOD, id="b"))).count() == 2
    with pytest.raises(Exception, match="train 1 of s: color_invalid, id_repeated"):
        documents.valid_only(sent(spark, GOOD, dict(GOOD, style={"color": "red"}))).collect()


def test_stop_edits(spark):
    stops = spark.createDataFrame([(t, k, f"{t}{k}") for t in range(6) for k in range(3)], "train_id bigint, idx bigint, name string")
    edits = spark.createDataFrame([(0, 1, "up"), (0, 2, "up"), (1, 1, "down"), (2, 0, "up"), (3, 2, "down"), (4, 0, "delete"), (5, 7, "delete"), (9, 0, "up"), (5, None, "up")], "train_id bigint, idx bigint, action string")
    got = {}
    for r in store.stops_edited(stops, edits).orderBy("train_id", "idx").collect():
        got.setdefault(r["train_id"], []).append((r["idx"], r["name"]))
    assert {t: [n for _, n in v] for t, v in got.items()} == {0: ["01", "00", "02"], 1: ["10", "12", "11"], 2: ["20", "21", "22"], 3: ["30", "31", "32"], 4: ["41", "42"], 5: ["50", "51", "52"]}
    assert all([k for k, _ in v] == list(range(len(v))) for v in got.values())
    assert store.stops_edited(stops, edits.limit(0)).count() == 18 and store.stops_edited(stops.limit(0), edits).count() == 0


def test_pieces_of_lines(spark):
    lines = spark.createDataFrame([(1, [(0.01, 0.01)]), (2, []), (3, None), (4, [(0.01, 0.01), (0.01, -0.01)]), (5, [(-90.0, 1.0), (0.01, 0.01), (0.02, 0.01)])], "line_id bigint, points array<struct<lon:double,lat:double>>")
    got = sorted((r["line_id"], r["x"], r["y"], r["piece"]) for r in render.tile_pieces(lines, 4).collect())
    assert got == [(1, 8, 7, None), (4, 8, 7, None), (4, 8, 8, None), *((5, x, 7, None) for x in range(4, 9))]
    far = sorted((r["x"], r["piece"]) for r in render.tile_pieces(lines.where("line_id = 5"), 5).collect())
    assert far == [*((x, 0) for x in range(8, 16)), (16, 0), (16, 1)]


def test_runs_end_where_nothing_is_drawn(spark):
    seg = spark.createDataFrame([(1, k, float(k), 0.0, k + 1.0, 0.0, k != 2, 1 if k < 4 else 2, 0) for k in range(6)] + [(2, 0, 0.0, 0.0, 1.0, 0.0, None, 1, 0), (3, 0, 5.0, 0.0, 4.0, 0.0, True, 2, 1)], "train_id bigint, seq bigint, from_lon double, from_lat double, to_lon double, to_lat double, shown boolean, trains bigint, slot int")
    trains = spark.createDataFrame([(k, None, (True, 6.0, 1.0 if k < 9 else 0.0)) for k in (1, 2, 3, 9)], "train_id bigint, color string, style struct<shown:boolean,width:double,opacity:double>")
    got = {(r["train_id"], r["run"]): r for r in render.route_records(seg, trains, 0).collect()}
    assert {k: [p["lon"] for p in r["path"]] for k, r in got.items()} == {(1, 0): [0, 1, 2], (1, 1): [3, 4], (1, 2): [4, 5, 6], (3, 0): [5, 4]}
    assert got[1, 0]["pick_path"] == got[1, 0]["path"] and got[1, 0]["pick_width"] == 14
    # Two trains in opposite directions on one track lie on different sides of it.
    assert got[1, 2]["pick_path"][0]["lat"] < 0 < got[3, 0]["pick_path"][0]["lat"]


def test_places_of_stops(spark):
    stops = spark.createDataFrame([(1, 0, "a", "1", ""), (1, 1, "", None, None), (1, 2, "c", "", "g")], "train_id bigint, idx bigint, name string, code string, group_code string")
    matched = spark.createDataFrame([(1, 5, "a", None, "7", "m", "l", "o", 2.0, 2.0), (1, 3, "", "", "1", "k", "l", "o", 1.0, 1.0), (2, 0, "c", "c", "9", "k", "l", "o", 9.0, 9.0)], "train_id bigint, place bigint, station string, name string, code string, group_code string, line string, operator string, lon double, lat double")
    resolved = spark.createDataFrame([(1, 2, "3", "h", "l", "o", 3.0, 3.0), (1, 0, "4", "h", "l", "o", 4.0, 4.0)], "train_id bigint, idx bigint, code string, group_code string, line string, operator string, lon double, lat double")
    got = {r["idx"]: (r["code"], r["group_code"], r["lon"], r["source"]) for r in resolve.stop_features(stops, matched, resolved).collect()}
    assert got == {0: ("1", "k", 1.0, "matched"), 1: (None, None, None, None), 2: ("3", "g", 3.0, "resolved")}


def test_labels_layers_and_findings(spark):
    rows = spark.createDataFrame([("", None, "7", "n"), ("2", "s", "7", "n"), (None, "", "n", "n"), (None, None, None, None)], "sno string, sname string, number string, name string")
    assert [r[0] for r in rows.coalesce(1).select(itinerary.segment_label(*(F.col(c) for c in rows.columns))).collect()] == ["n　7", "s　2", "n", ""]
    marks = spark.createDataFrame([(1, "stop"), (2, "passed"), (None, None)], "train_id bigint, category string")
    assert sorted(r["layer"] for r in render.split_markers(marks, [], F.col("train_id") == 1).collect()) == ["base", "base", "selected"]
    assert render.split_markers(marks, ["passed"], F.lit(None).cast("boolean")).count() == 2
    sets = spark.createDataFrame([(["1"], ["1"]), (["1"], ["2"]), (None, ["2"]), ([], []), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in sets.coalesce(1).select(graph.node_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]
    features = spark.createDataFrame([(0, '{"x":"1"}', '{"type":"LineString","coordinates":[[1,2],[3,4]]}'), (1, '{"x":""}', None), (2, None, '{"type":"LineString","coordinates":[[1,2]]}')], "ord int, properties string, geometry string")
    got = sorted(tuple(r) for r in network.feature_findings(features, ("x",)).collect())
    assert got == [(1, "error", "x is missing"), (1, "warning", "geometry is skipped: none"), (2, "error", "x is missing"), (2, "warning", "geometry is skipped: LineString")]


def test_segments_are_made_in_one_pass(spark):
    """One exchange of the stops by train gives keys, rides and places; a stop without a place is passed by what is drawn."""
    from railweave.plans import records

    stops = spark.createDataFrame([(1, 0, 5, "origin", True), (1, 1, 9, "passenger_stop", True), (1, 2, 6, "passenger_stop", True), (1, 3, 5, "passenger_stop", False), (2, 0, 6, "origin", True)], "train_id bigint, idx bigint, station_id bigint, stop_type string, ride boolean")
    stations = spark.createDataFrame([(5, 1.0, 2.0), (6, 3.0, 4.0)], "station_id bigint, lon double, lat double")
    found = records._ridden_segments(stops, stations)
    got = sorted((r["train_id"], r["seq"], r["seg_key"], r["shown"], r["from_lon"], r["to_lon"]) for r in found.collect())
    assert got == [(1, 0, "5-9", True, 1.0, 3.0), (1, 1, "6-9", True, None, 3.0), (1, 2, "5-6", False, 3.0, 1.0)]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Window") <= 3
