"""Golden rows for the column functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.functions import dates, geo, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_names(spark):
    got = values(spark, [("柳ヶ浦",), ("茅ヶ崎",), (" ＪＲ 東京 ",), (None,), ("",)], "n string", text.normalize_name(F.col("n")))
    assert [r[0] for r in got] == ["柳ケ浦", "茅ケ崎", "JR東京", "", ""]


@pytest.mark.parametrize(("told", "date"), [("2026/07/03", "2026-07-03"), ("2026/7/3", None), ("2026-02-31", "2026-02-31"), ("2026-13-01", None), (None, None), ("", None)])
def test_dates(spark, told, date):
    assert values(spark, [(told,)], "d string", dates.normalize_date(F.col("d"))) == [(date,)]


def test_inferred_dates(spark):
    got = values(spark, [("20260703_01_haruka",), ("x20260703",), ("120260703_a",), ("odr_001",), (None,)], "d string", text.infer_date(F.col("d")))
    assert [r[0] for r in got] == ["2026-07-03", "2026-07-03", None, None, None]


def test_times(spark):
    told = ["12:09", "24:10", "10:00+1", "9:05 + 2", "12:99", "10:00abc", "noon", None]
    got = values(spark, [(t,) for t in told], "t string", dates.parse_minutes(F.col("t")))
    assert [r[0] for r in got] == [729, 1450, 2040, 3425, 819, 600, None, None]
    assert values(spark, [(1450,), (2040,)], "m int", dates.format_minutes(F.col("m"))) == [("00:10",), ("10:00",)]


def test_small_text_functions(spark):
    assert values(spark, [("#0a10FF",), ("red",), (None,)], "c string", text.hex_to_rgb(F.col("c"))) == [((10, 16, 255),), ((217, 54, 79),), ((217, 54, 79),)]
    assert values(spark, [("<a href='x'>\"&",)], "c string", text.escape_html(F.col("c"))) == [("&lt;a href=&#39;x&#39;&gt;&quot;&amp;",)]
    assert values(spark, [('{"b":1,"a":2,"id":3}',), ("no",)], "c string", text.unknown_keys(F.col("c"), ["id"])) == [(["a", "b"],), (None,)]
    assert values(spark, [("", "x"), (None, ""), ("a", "b")], "a string, b string", text.first_truthy(F.col("a"), F.col("b"))) == [("x",), (None,), ("a",)]


def test_distance_and_detours(spark):
    rows = [(133.0, 34.0, 133.0, 35.0)]
    assert values(spark, rows, "a double, b double, c double, d double", geo.haversine_m(*(F.col(c) for c in "abcd")))[0][0] == pytest.approx(6371000 * math.radians(1))
    got = values(spark, [(2000.0, 13700.0), (1400.0, 50000.0), (2000.0, 13600.0)], "s double, p double", geo.detour_ok(F.col("s"), F.col("p")))
    assert got == [(False,), (True,), (True,)]


def test_simplified_paths_stay_near(spark):
    random.seed(3)
    line = [(130 + k * 0.001, 35 + 0.0004 * math.sin(k / 5) + random.uniform(0, 2e-5)) for k in range(400)]
    keep = geo._simplified(np.array(line), 8.0)
    assert keep[0] and keep[-1] and keep.sum() < 200
    kept = [p for p, k in zip(line, keep) if k]
    kx, ky = geo.LON_M * math.cos(math.radians(35)), geo.LAT_M
    for x, y in line:
        best = 1e9
        for (ax, ay), (bx, by) in zip(kept, kept[1:]):
            dx, dy, px, py = (bx - ax) * kx, (by - ay) * ky, (x - ax) * kx, (y - ay) * ky
            t = min(1, max(0, (px * dx + py * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px - t * dx, py - t * dy))
        assert best <= 8.01
    got = spark.createDataFrame([([(1.0, 2.0), (1.0, 2.1)],), (None,), ([],)], f"p {geo.POINTS}").select(geo.simplify_path(F.col("p"))).collect()
    assert [r[0] and len(r[0]) for r in got] == [2, None, []]


def test_path_ends():
    path = [(130.0, 35.0), (130.01, 35.0), (130.02, 35.0)]
    assert geo.fit_end(path, (130.0, 35.000005)) == path  # under 1.5 m
    assert geo.fit_end(path, (130.015, 35.0001)) == [(130.015, 35.0001), (130.02, 35.0)]  # on the second segment
    assert geo.fit_end(path, (129.997, 35.0)) == [(129.997, 35.0), *path]  # before the start, under 500 m
    assert geo.fit_end(path, (129.9, 35.0)) == path
    assert geo.fit_end([], (1.0, 2.0)) == []


def test_localized_names(spark):
    names = spark.createDataFrame([("東京", "Tōkyō")], "name string, reading string")
    got = text.localized_names(spark.createDataFrame([("東京",), ("大阪",)], "n string"), names, "n", "shown").collect()
    assert {r["shown"] for r in got} == {"東京 (Tōkyō)", "大阪"}


def test_offset_is_on_one_side_for_both_directions(spark):
    rows = [([(0.0, 0.0), (1.0, 0.0)],), ([(1.0, 0.0), (0.0, 0.0)],)]
    a, b = [r[0] for r in spark.createDataFrame(rows, f"p {geo.POINTS}").select(geo.offset_path(F.col("p"), F.lit(0.5))).collect()]
    assert [p["lat"] for p in a] == [0.5, 0.5] and [p["lat"] for p in b] == [0.5, 0.5]
