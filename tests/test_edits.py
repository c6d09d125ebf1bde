"""Small edits of stores, filled fields and drawn signatures on rows that the tables do not have."""

import json

from pyspark.sql import functions as F

from railweave.operators import render, store
from railweave.sources import network, stores


def canonical(spark, *trains):
    told, errors = stores.parse_stores(spark.createDataFrame([("s", json.dumps(list(trains)))], "source string, document string"))
    assert errors.count() == 0
    return stores.canonical_trains(told).orderBy("ord").collect()


def test_other_names_of_fields_and_colours(spark):
    base = {"id": "t", "number": "1", "name": "n"}
    got = canonical(spark, base | {"stops": [{"station": "x", "N02_005c": "7"}, {"name": "y", "station": "z", "n02_station_code": "8", "N02_005c": "9"}, {}], "style": {"color": "#12aBcD"}}, base | {"stops": [{"name": "", "station": "z"}], "style": {"color": "red"}}, base | {"stops": []})
    assert [(s["name"], s["n02_station_code"]) for s in got[0]["stops"]] == [("x", "7"), ("y", "8"), ("", None)] and got[1]["stops"][0]["name"] == "z"
    assert [r["style"]["color"] for r in got] == ["#12aBcD", "#d9364f", "#d9364f"]


def test_blank_train(spark):
    t = stores.blank_train(spark).first()
    assert (t["id"], t["number"], len(t["route_sections"]), len(t["stops"]), t["style"]["color"], t["style"]["weight"]) == ("LE", "", 4, 2, "#1d7f8c", 6.0)
    assert [s["from_n02_station_code"] for s in t["route_sections"]] == ["003770", "004095", "004634", "005218"] and t["stops"][0]["stop_type"] == "origin"
    assert t["route_policy"]["allowed_institution_type_codes"] == ["1", "2", "3", "4", "5"] and not t["route_policy"]["jr_only"]


def test_copies_replacements_and_deletions(spark):
    t = spark.createDataFrame([("a", 0, "n"), ("a-copy", 1, None), ("b", 2, "")], "id string, ord bigint, name string")
    copied = store.duplicated(t, t.where("id <> 'a-copy'").select("id"))
    assert sorted(map(tuple, copied.select("ord", "id", "name").collect()))[3:] == [(3, "a-copy-2", "n Copy"), (5, "b-copy", "Train Copy")]
    assert [tuple(r) for r in store.placed(copied).orderBy("place").select("place", "id").collect()] == [(1, "a"), (2, "a-copy"), (3, "b"), (4, "a-copy-2"), (5, "b-copy")]
    full = spark.createDataFrame([("a", 9, None), ("zz", 9, "x")], t.schema)
    assert sorted(map(tuple, store.replaced(t, full).collect())) == [("a", 0, None), ("a-copy", 1, None), ("b", 2, "")]
    assert store.emptied(t).count() == 0 and store.emptied(t).columns == t.columns


def test_display_points(spark):
    """A station is shown at its own point, else where its geometry says; without either it has no place."""
    shown = {"display_point": [139.5, 35.5], "name": "a"}
    line = '{"type":"LineString","coordinates":[[1,2],[3,4],[5,6]]}'
    rows = [(0, json.dumps(shown), line), (1, '{"name":"b"}', line), (2, '{"name":"c"}', None), (3, json.dumps(shown | {"display_point": "x"}), line)]
    features = spark.createDataFrame(rows, "ord int, properties string, geometry string")
    at = lambda how: [(r["lon"], r["lat"]) for r in network.stations(features, how).orderBy("ord").collect()]
    assert at("first_vertex") == [(139.5, 35.5), (1.0, 2.0), (None, None), (1.0, 2.0)]
    assert at("midpoint") == [(139.5, 35.5), (3.0, 4.0), (None, None), (3.0, 4.0)]


def test_route_signatures(spark):
    """A train's signature follows its drawn rows, whatever their order, and nothing else."""
    rows = [("t", 0, "red", 1.0), ("t", 1, "red", 2.0), ("u", 0, "red", 1.0)]
    schema = "train_id string, segment int, color string, weight double"
    told = lambda some: {r["train_id"]: r["signature"] for r in render.route_signature(spark.createDataFrame(some, schema)).collect()}
    first = told(rows)
    assert first == told(rows[::-1]) and first["t"] != first["u"]
    changed = told([("t", 0, "blue", 1.0), *rows[1:]])
    assert changed["t"] != first["t"] and changed["u"] == first["u"]
    assert told(rows[:1])["t"] != first["t"]


def test_bounds_without_anything(spark):
    routes = spark.createDataFrame([("t", [(1.0, 2.0), (3.0, 1.0)]), ("u", [])], "train_id string, points array<struct<lon:double,lat:double>>")
    stops = spark.createDataFrame([("t", 9.0, 9.0), ("u", 5.0, 6.0), ("v", None, None)], "train_id string, lon double, lat double")
    got = {r["train_id"]: tuple(r)[1:] for r in render.fit_bounds(routes, stops).collect()}
    assert got == {"t": ("routes", 1.0, 1.0, 3.0, 2.0), "u": ("stops", 5.0, 6.0, 5.0, 6.0)}
    assert render.fit_bounds(routes.where(F.lit(False)), stops.where(F.lit(False))).count() == 0
