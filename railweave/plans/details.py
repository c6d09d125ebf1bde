"""More operators as queries beside their twins in SQL: sources, keys, predicates, hints, snapping, markers, edits."""

from pyspark.sql import SparkSession, functions as F

from ..checkpoints import stored
from ..functions import dates, geo, text
from ..operators import graph, itinerary, render, resolve, route, store, validate
from ..sources import network
from .model import haversine_sql as hav, line_hops, placed_stops, stations, stops, table, trains
from .queries import query

_SHAPES = ", fe AS (SELECT station_id, station_id % 4 AS kind, lon_e5, lat_e5 FROM st)"


def _features(spark: SparkSession, d: str):
    """A GeoJSON feature of each station, of four kinds of geometry; names under other properties from kind to kind."""
    s, t = stations(spark, d), lambda c: c.cast("string")
    degrees = lambda c: F.format_string("%d.%05d", F.floor(c / 100000), c % 100000)
    at = lambda more: F.concat(F.lit("["), degrees(F.col("lon_e5") + more), F.lit(","), degrees(F.col("lat_e5")), F.lit("]"))
    line = lambda *points: F.concat(F.lit("["), F.concat_ws(",", *(at(p) for p in points)), F.lit("]"))
    shapes = [("LineString", line(0, 100)), ("MultiLineString", F.concat(F.lit("["), line(0, 100), F.lit(","), line(200, 300, 400), F.lit("]"))), ("Point", at(0)), ("Polygon", F.concat(F.lit("["), line(0, 100, 0), F.lit("]")))]
    kind = F.col("station_id") % 4
    shape = F.coalesce(*(F.when(kind == k, F.concat(F.lit(f'{{"type":"{name}","coordinates":'), coords, F.lit("}"))) for k, (name, coords) in enumerate(shapes)))
    names = ["station_name", "name", "N02_005", "station"]
    properties = F.coalesce(*(F.when(kind == k, F.concat(F.lit(f'{{"{name}":"'), F.col("name"), F.lit('","N02_005c":"'), F.col("code"), F.lit('","n02_station_code":"'), F.when(kind == 2, F.concat(F.lit("x"), t(F.col("station_id")))).otherwise(""), F.lit('"}'))) for k, name in enumerate(names)))
    return s.select(F.col("station_id").alias("ord"), properties.alias("properties"), shape.alias("geometry"))


@query(_SHAPES + " SELECT station_id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS lines, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 0 END AS points, CASE kind WHEN 0 THEN lon_e5 + 100 WHEN 1 THEN lon_e5 + 400 WHEN 2 THEN lon_e5 END AS east FROM fe")
def geometry_lines(spark, d):
    told = _features(spark, d).select(F.col("ord").alias("station_id"), network.geometry_lines(F.col("geometry")).alias("l"))
    return told.select("station_id", F.size("l").alias("lines"), F.size(F.flatten("l")).alias("points"), F.round(F.array_max(F.transform(F.flatten("l"), lambda p: p["lon"])) * 100000).cast("bigint").alias("east"))


@query(_SHAPES + " SELECT fe.station_id, name, CASE WHEN kind = 2 THEN 'x' || CAST(fe.station_id AS VARCHAR) ELSE code END AS code, CASE kind WHEN 0 THEN fe.lon_e5 + 100 WHEN 1 THEN fe.lon_e5 + 300 WHEN 2 THEN fe.lon_e5 END AS lon_e5 FROM fe JOIN st ON fe.station_id = st.station_id")
def station_points(spark, d):
    """Names and codes by their aliases, and the middle vertex of the longest line."""
    return network.stations(_features(spark, d), "midpoint").select("station_id", "name", "code", F.round(F.col("lon") * 100000).cast("bigint").alias("lon_e5"))


@query(" SELECT event_id, CASE event_id % 4 WHEN 3 THEN ' 10:0' || CAST(event_id % 10 AS VARCHAR) END AS told FROM events")
def nullable_times(spark, d):
    k = F.col("event_id") % 4
    given = F.when(k == 1, "").when(k == 2, "  ").when(k == 3, F.concat(F.lit(" 10:0"), (F.col("event_id") % 10).cast("string")))
    return table(spark, d, "events").select("event_id", text.blank_to_null(given).alias("told"))


@query(" SELECT station_id, (station_id % 6 = 0 OR institution IN ('1', '3')) AS ok FROM st")
def station_institutions(spark, d):
    code = F.when(F.col("station_id") % 6 == 0, "").otherwise(F.col("institution"))
    return stations(spark, d).select("station_id", resolve.institution_allowed(code, F.array(F.lit("1"), F.lit("3"))).alias("ok"))


@query(" SELECT src AS section_id, (src % 7 = 0 OR ((src % 2 = 0 OR line IN ('L3', 'L4')) AND (src % 3 = 0 OR operator = 'O3'))) AS ok FROM hop")
def required_hints(spark, d):
    k = F.col("section_id")
    none = F.array().cast("array<string>")
    lines, operators = F.when(k % 2 == 0, none).otherwise(F.array(F.lit("L3"), F.lit("L4"))), F.when(k % 3 == 0, none).otherwise(F.array(F.lit("O3")))
    return line_hops(spark, d).select("section_id", graph.edge_required(F.col("line"), F.col("operator"), k % 7 == 0, lines, operators).alias("ok"))


@query(" SELECT src AS section_id, (least(a_lon, b_lon) <= 130.1::DOUBLE + 0.02 OR greatest(a_lon, b_lon) >= 130.4::DOUBLE - 0.02 OR least(a_lat, b_lat) <= 35.1::DOUBLE + 0.02 OR greatest(a_lat, b_lat) >= 35.4::DOUBLE - 0.02) AS near FROM hop")
def region_rim(spark, d):
    box = F.struct(F.lit(130.1).alias("west"), F.lit(35.1).alias("south"), F.lit(130.4).alias("east"), F.lit(35.4).alias("north"))
    return line_hops(spark, d).select("section_id", geo.touches_edge(F.col("points"), box).alias("near"))


@query(f""", q AS (SELECT *, {hav('a_lon', 'a_lat', 'b_lon', 'b_lat')} AS m FROM hop)
SELECT line AS path_id, round(sum(CASE WHEN src % 5 = 0 THEN 0 ELSE CASE WHEN src % 2 = 0 THEN m * 8 ELSE 0 END + CASE WHEN src % 3 = 0 THEN m * 6 ELSE 0 END END), 1) AS penalty, string_agg(DISTINCT institution, ',' ORDER BY institution) AS institutions FROM q GROUP BY line""")
def path_penalties(spark, d):
    e = graph.section_edges(line_hops(spark, d)).where("src = section_id")
    k = F.col("src")
    told = graph.path_penalty(e.select(F.col("line").alias("path_id"), "length_m", (k % 5 == 0).alias("is_connector"), (k % 2 == 0).alias("off_line"), (k % 3 == 0).alias("off_operator"), "institution"))
    return told.select("path_id", F.round("penalty", 1).alias("penalty"), F.array_join("institutions", ",").alias("institutions"))


@query(" SELECT station_id, least(institution, '3') || ',' || greatest(institution, '3') || '|institution_filter:soft,line:' || line || '|t' || CAST(station_id AS VARCHAR) AS key FROM st")
def cache_keys(spark, d):
    key = text.cache_key(F.array(F.lit("3"), F.col("institution")), F.array(F.concat(F.lit("line:"), F.col("line")), F.lit("institution_filter:soft")), F.concat(F.lit("t"), F.col("station_id").cast("string")))
    return stations(spark, d).select("station_id", key.alias("key"))


@query(""", k AS (SELECT src, (a_x + 18000000) * 100000000 + a_y + 9000000 AS a, (b_x + 18000000) * 100000000 + b_y + 9000000 AS b, CAST(floor(a_x / 1000.0) AS BIGINT) AS cx, CAST(floor(a_y / 1000.0) AS BIGINT) AS cy FROM hop)
SELECT src AS section_id, CAST(least(a, b) AS VARCHAR) || '|' || CAST(greatest(a, b) AS VARCHAR) AS segment, cx, cy FROM k""")
def coordinate_keys(spark, d):
    p = F.col("points")
    x, y = (lambda k: text.degrees_e5(p[k]["lon"])), (lambda k: text.degrees_e5(p[k]["lat"]))
    key = lambda k: text.coord_key(x(k), y(k))
    return line_hops(spark, d).select("section_id", text.segment_key(key(0), key(1)).alias("segment"), text.grid_cell(x(0)).alias("cx"), text.grid_cell(y(0)).alias("cy"))


@query(" SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 217 ELSE CAST(p_size % 16 * 17 AS INTEGER) END AS r, CASE WHEN p_partkey % 5 = 0 THEN 54 ELSE CAST(p_partkey % 16 * 17 AS INTEGER) END AS g, CASE WHEN p_partkey % 5 = 0 THEN 79 ELSE 15 END AS b FROM part")
def colors(spark, d):
    two = lambda c: F.repeat(F.conv((c % 16).cast("string"), 10, 16), 2)
    told = F.when(F.col("p_partkey") % 5 == 0, "red").otherwise(F.concat(F.lit("#"), two(F.col("p_size")), two(F.col("p_partkey")), F.lit("0f")))
    return table(spark, d, "part").select("p_partkey", text.hex_to_rgb(told).alias("c")).select("p_partkey", "c.*")


@query(""", v AS (SELECT src, b_lon - a_lon AS dx, b_lat - a_lat AS dy, a_lon, a_lat FROM hop), u AS (SELECT *, sqrt(dx * dx + dy * dy) AS n, CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -1.0 ELSE 1.0 END AS f FROM v)
SELECT src AS section_id, round(CASE WHEN n > 0 THEN a_lon - f * dy / n * 0.001::DOUBLE ELSE a_lon END, 7) AS lon, round(CASE WHEN n > 0 THEN a_lat + f * dx / n * 0.001::DOUBLE ELSE a_lat END, 7) AS lat FROM u""")
def offset_starts(spark, d):
    moved = geo.offset_path(F.transform("points", lambda p: F.struct(p["lon"], p["lat"])), F.lit(0.001))[0]
    return line_hops(spark, d).select("section_id", F.round(moved["lon"], 7).alias("lon"), F.round(moved["lat"], 7).alias("lat"))


@query(""" , p AS (SELECT src, least(a_lat, b_lat) AS s, greatest(a_lat, b_lat) AS n, least(a_lon, b_lon) AS w, greatest(a_lon, b_lon) AS e FROM hop)
SELECT src AS section_id, round(w - 3000 / (111320.0::DOUBLE * greatest(cos(radians((s + n) / 2)), 0.2)), 7) AS west, round(n + 3000 / 111320.0::DOUBLE, 7) AS north FROM p""")
def padded_boxes(spark, d):
    p = F.col("points")
    low, high = (lambda c: F.least(p[0][c], p[1][c])), (lambda c: F.greatest(p[0][c], p[1][c]))
    box = geo.pad_bbox(low("lon"), low("lat"), high("lon"), high("lat"), F.lit(3000.0))
    return line_hops(spark, d).select("section_id", F.round(box["west"], 7).alias("west"), F.round(box["north"], 7).alias("north"))


_EFFECTIVE = """, eff0 AS (
  SELECT *, last_value(CASE WHEN stop_type <> 'pass_through' THEN ride END IGNORE NULLS) OVER (PARTITION BY train_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(CASE WHEN stop_type <> 'pass_through' THEN ride END IGNORE NULLS) OVER (PARTITION BY train_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM sp),
eff AS (SELECT *, CASE WHEN stop_type = 'pass_through' AND p IS NOT NULL AND n IS NOT NULL THEN p AND n ELSE ride END AS now FROM eff0)
"""


@query(_EFFECTIVE + "SELECT train_id, idx, now AS ride FROM eff")
def propagated_rides(spark, d):
    return itinerary.propagate_ride(stops(spark, d)).select("train_id", "idx", "ride")


@query(_EFFECTIVE + """, m AS (SELECT train_id, station_id, CASE WHEN stop_type IN ('origin', 'destination') THEN 'terminal' WHEN stop_type = 'pass_through' THEN 'passed' ELSE 'stop' END AS category FROM eff WHERE now
  UNION ALL SELECT train_id, station_id + 1, 'passed' FROM sp WHERE stop_type = 'origin')
SELECT train_id, station_id, category, CASE category WHEN 'terminal' THEN 7.5::DOUBLE WHEN 'passed' THEN 3.0::DOUBLE ELSE 6.0::DOUBLE END AS radius, 1.0::DOUBLE AS opacity FROM m""")
def marker_table(spark, d):
    s = stops(spark, d)
    passed = s.where("stop_type = 'origin'").select("train_id", (F.col("station_id") + 1).alias("station_id"))
    return render.markers(itinerary.effective_ride(s).withColumn("emphasis", F.lit(None).cast("int")), passed)


@query(""", g AS (SELECT date, arg_min(train_id, ord) AS a, arg_max(train_id, ord) AS b FROM tr GROUP BY date)
SELECT sp.train_id, sp.idx FROM sp JOIN g ON sp.train_id = g.a WHERE idx = 0 UNION ALL SELECT sp.train_id, sp.idx FROM sp JOIN g ON sp.train_id = g.b WHERE idx = (SELECT max(idx) FROM sp s WHERE s.train_id = sp.train_id)""")
def endpoint_markers(spark, d):
    return itinerary.only_endpoints(stops(spark, d), itinerary.endpoints(trains(spark, d), "date")).select("train_id", "idx")


@query(" SELECT CASE WHEN (SELECT count(*) FROM tr WHERE date = '1995-03-15') > 0 THEN '1995-03-15' ELSE coalesce((SELECT min(date) FROM tr WHERE date <> 'undated'), 'undated') END AS date")
def reconciled_date(spark, d):
    return itinerary.reconciled_date(itinerary.date_buckets(trains(spark, d)), "1995-03-15")


@query(" SELECT train_id, CASE WHEN date = 'undated' THEN 'Undated' ELSE date END AS label FROM tr")
def date_labels(spark, d):
    return trains(spark, d).select("train_id", dates.date_label(F.col("date")).alias("label"))


@query(" SELECT o_orderkey AS train_id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN '2020-02-31' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'undated' END AS date FROM orders")
def train_dates(spark, d):
    """The train's own date, else the import's, else that of its id, else undated."""
    k = F.col("train_id") % 3
    own = F.when(k == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, "2026-13-01")
    given = F.when(k == 1, "2020-02-31")
    told = table(spark, d, "orders").withColumn("train_id", F.col("o_orderkey"))
    name = F.when(F.col("train_id") % 2 == 0, F.concat(F.lit("tr_"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise("odr_001")
    return told.select("train_id", dates.train_date(own, given, text.infer_date(name)).alias("date"))


@query(""", many AS (SELECT norm_name AS station_id FROM st GROUP BY norm_name HAVING count(DISTINCT line) > 1)
SELECT DISTINCT train_id, idx AS segment, norm_name AS station_id FROM ps WHERE idx % 3 <> 0 AND norm_name IN (SELECT station_id FROM many)""")
def branch_leaks(spark, d):
    """Section ends of a name that several lines have, where the section names no line."""
    p = placed_stops(spark, d)
    lines = F.when(F.col("idx") % 3 == 0, F.array("line")).otherwise(F.array().cast("array<string>"))
    ends = p.select("train_id", F.col("idx").alias("segment"), lines.alias("line_names"), F.col("norm_name").alias("station_id"))
    return validate.branch_leaks(ends, stations(spark, d).select(F.col("norm_name").alias("station_id"), "line"))


@query(""", n AS (SELECT train_id, idx, stop_type, line, lag(line) OVER (PARTITION BY train_id ORDER BY idx) AS a, lead(line) OVER (PARTITION BY train_id ORDER BY idx) AS b FROM ps)
SELECT train_id, idx FROM n WHERE stop_type = 'pass_through' AND coalesce(line <> a, true) AND coalesce(line <> b, true)""")
def off_line_passes(spark, d):
    return validate.off_line_passes(placed_stops(spark, d).select("train_id", "idx", "stop_type", F.array("line").alias("lines")))


@query(""", o AS (SELECT o_orderkey AS ord, 'c' || CAST(o_custkey AS VARCHAR) AS id FROM orders), r AS (SELECT ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM o WHERE ord % 4 <> 0), e AS (SELECT DISTINCT id FROM o WHERE ord % 4 = 0)
SELECT r.ord, r.id, CASE WHEN k = 1 AND e.id IS NULL THEN r.id ELSE r.id || '-' || CAST(k + CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS VARCHAR) END AS unique_id FROM r LEFT JOIN e ON r.id = e.id""")
def renamed_imports(spark, d):
    """Orders with a number that 4 divides are the store, the others the import; trains of a customer share an id."""
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("ord"))
    return store.unique_ids(o.where("ord % 4 = 0").select("id"), o.where("ord % 4 <> 0"))


@query(""", e AS (SELECT src, dst, line, operator, institution, CAST(round(greatest(""" + hav("a_lon", "a_lat", "b_lon", "b_lat") + """, 0.01) * 1000) AS BIGINT) AS mm FROM hop),
b AS (SELECT * FROM e UNION ALL SELECT dst, src, line, operator, institution, mm FROM e)
SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(src || '|' || dst || '|' || mm || '|' || line || '|' || operator || '|' || institution), 1, 15)) AS HUGEINT)) AS VARCHAR) AS hash FROM b""")
def network_digest(spark, d):
    return graph.content_hash(graph.section_edges(line_hops(spark, d)))


_SNAPS = f""", n AS (SELECT count(*) AS n FROM customer),
ak AS (SELECT s_suppkey AS ask_id, unnest([1, 2]) AS place FROM supplier),
asked AS (SELECT ask_id, place, 1 + (ask_id * CASE place WHEN 1 THEN 13 ELSE 29 END) % n AS station_id FROM ak, n),
near AS (SELECT a.station_id, b.station_id AS node_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS metres FROM st a JOIN st b ON abs(a.lon_e5 - b.lon_e5) < 700 AND abs(a.lat_e5 - b.lat_e5) < 500),
sc AS (SELECT q.ask_id, q.place, q.station_id, r.node_id, metres, metres - CASE WHEN o.line = m.line THEN 40 ELSE 0 END - CASE WHEN o.operator = m.operator THEN 15 ELSE 0 END
    + CASE WHEN m.line = 'L' || CAST(q.ask_id % 25 AS VARCHAR) THEN -25 ELSE 15000 END + CASE WHEN m.institution IN ('1', '2', '3') THEN 0 ELSE 20000 END AS score
  FROM asked q JOIN st o ON q.station_id = o.station_id JOIN near r ON q.station_id = r.station_id JOIN st m ON r.node_id = m.station_id WHERE metres <= 500),
f AS (SELECT *, row_number() OVER (PARTITION BY ask_id, node_id ORDER BY place) AS first FROM sc)
"""


@query(_SNAPS + "SELECT ask_id, CAST(row_number() OVER (PARTITION BY ask_id ORDER BY score, metres, place, node_id) AS INTEGER) AS k, node_id, round(metres, 2) AS snap_m, station_id FROM f WHERE first = 1")
def station_snaps(spark, d):
    """All nodes near two stations for each supplier, by what they are on and off."""
    s = stations(spark, d)
    e5 = F.array(F.struct("lon_e5", "lat_e5"))
    meta = s.select(F.col("station_id").alias("node"), F.array("line").alias("lines"), F.array("operator").alias("operators"), F.array("institution").alias("institutions"))
    k, none = F.col("s_suppkey"), F.array().cast("array<string>")
    asks = table(spark, d, "supplier").crossJoin(F.broadcast(s.agg(F.count("*").alias("n"))))
    pick = lambda times, place: F.struct((1 + k * times % F.col("n")).alias("station_id"), F.lit(place).alias("place"))
    asks = asks.select(k.alias("ask_id"), F.array(pick(13, 1), pick(29, 2)).alias("stations"), none.alias("req_lines"), none.alias("req_operators"), F.array(F.concat(F.lit("L"), (k % 25).cast("string"))).alias("pref_lines"), none.alias("pref_operators"), F.array(*map(F.lit, "123")).alias("allowed"), F.lit(False).alias("home"))
    nodes = s.select(F.col("station_id").alias("node_id"), "lon_e5", "lat_e5")
    told = route.every_snap(asks, s.select("station_id", e5.alias("vertices"), "line", "operator"), nodes, meta)
    return told.select("ask_id", "k", "node_id", F.round("snap_m", 2).alias("snap_m"), "station_id")


@query(""" , h AS (SELECT src, a.line AS la, b.line AS lb, a.operator AS oa, b.operator AS ob, b.institution AS ib FROM hop h JOIN st a ON h.src = a.station_id JOIN (SELECT station_id + 1 AS dst1, * FROM st) b ON b.dst1 = h.src)
SELECT src AS section_id, CASE WHEN src % 3 = 0 THEN 'X' ELSE '' END AS explicit_lines, CASE WHEN la = lb THEN la ELSE '' END AS common_lines, CASE WHEN oa = ob THEN oa ELSE '' END AS common_operators,
  array_to_string(list_sort(list_distinct([CASE WHEN src % 2 = 0 THEN 'P' END, CASE WHEN src % 3 = 0 THEN 'X' END, CASE WHEN la = lb THEN la WHEN src % 2 <> 0 AND src % 3 <> 0 THEN la END])), ',') AS pref_lines FROM h""")
def hints_of_sections(spark, d):
    """Hints between each station and the one before it by number: policy, explicit, common, and the only line of an end."""
    s = stations(spark, d)
    one = F.array(F.struct("line", "operator", "institution"))
    told = line_hops(spark, d).select("section_id").join(s.select(F.col("station_id").alias("section_id"), one.alias("from_stations")), "section_id").join(s.select((F.col("station_id") + 1).alias("section_id"), one.alias("to_stations")), "section_id")
    none, k = F.array().cast("array<string>"), F.col("section_id")
    told = told.withColumns({"line_names": F.when(k % 3 == 0, F.array(F.lit("X"), F.lit(""))).otherwise(none), "operator_names": none, "policy_lines": F.when(k % 2 == 0, F.array(F.lit("P"))).otherwise(none), "policy_operators": none, "allowed": F.array(F.lit("1"), F.lit("2")), "inferred": F.struct(none.alias("lines"), none.alias("operators"))})
    return route.segment_hints(told).select("section_id", *(F.array_join(c, ",").alias(c) for c in ("explicit_lines", "common_lines", "common_operators", "pref_lines")))


@query(f""", c AS (SELECT station_id AS stop_id, station_id, norm_name, institution IN ('1', '2') AS ok, lon, lat, ord FROM st),
s AS (SELECT c.stop_id, o.station_id, o.ord, max(CASE WHEN {hav('c.lon', 'c.lat', 'o.lon', 'o.lat')} <= 1800 THEN 1 ELSE 0 END) AS near FROM c JOIN st o ON c.norm_name = o.norm_name AND o.institution IN ('1', '2') GROUP BY 1, 2, 3),
m AS (SELECT s.stop_id, s.station_id, 0 AS part, s.ord FROM s JOIN (SELECT stop_id, max(near) AS nearby FROM s GROUP BY 1) t ON s.stop_id = t.stop_id JOIN c ON c.stop_id = s.stop_id WHERE s.near = 1 OR (nearby = 0 AND NOT ok)
  UNION ALL SELECT stop_id, station_id, 1, ord FROM c)
SELECT stop_id, station_id, CAST(row_number() OVER (PARTITION BY stop_id ORDER BY part, ord) AS INTEGER) AS place FROM (SELECT stop_id, station_id, min(part) AS part, min(ord) AS ord FROM m GROUP BY 1, 2)""")
def expanded_endpoints(spark, d):
    """Each station as the end of a section, with allowed stations of its name put first."""
    s = stations(spark, d)
    return resolve.expand_endpoint(s.select(F.col("station_id").alias("stop_id"), "norm_name", "station_id", "ord"), s, ["1", "2"])


@query(""", k AS (SELECT train_id, 'k' || CAST(train_id % 50 AS VARCHAR) AS template_key FROM tr),
r AS (SELECT train_id, 'r' || CAST(idx % 2 AS VARCHAR) AS route_id, idx AS segment FROM sp),
p AS (SELECT * FROM r WHERE train_id % 3 = 1 AND segment > 0),
u AS (SELECT r.*, 0 AS origin FROM r JOIN k ON r.train_id = k.train_id WHERE r.train_id % 3 = 0 UNION ALL SELECT p.*, 1 FROM p JOIN k ON p.train_id = k.train_id
  UNION ALL SELECT a.train_id, route_id, segment, 2 FROM (SELECT k.template_key, p.route_id, p.segment FROM p JOIN k ON p.train_id = k.train_id WHERE p.train_id % 750 = 1) t JOIN k a ON a.template_key = t.template_key),
f AS (SELECT train_id, min(origin) AS origin FROM u GROUP BY train_id),
g AS (SELECT u.train_id, arg_min(route_id, segment * 10 + CASE route_id WHEN 'r0' THEN 0 ELSE 1 END) AS route_id, any_value(u.origin) AS origin FROM u JOIN f ON u.train_id = f.train_id AND u.origin = f.origin GROUP BY u.train_id)
SELECT k.train_id, u.route_id, u.segment, u.origin FROM k LEFT JOIN (SELECT u.* FROM u JOIN g ON u.train_id = g.train_id AND u.origin = g.origin AND u.route_id = g.route_id WHERE u.segment % 5 <> 4) u ON k.train_id = u.train_id""")
def stored_routes(spark, d):
    """Every train: by its number modulo 3 it has generated routes, stored ones, or at best those of its template, which one stored train of 250 has; each fifth row is several lines not declared one path."""
    key = F.concat(F.lit("k"), (F.col("train_id") % 50).cast("string"))
    t = trains(spark, d).select("train_id", key.alias("template_key"))
    made = stops(spark, d).join(t.select("train_id"), "train_id", "left_semi").select("train_id", key.alias("template_key"), F.concat(F.lit("r"), (F.col("idx") % 2).cast("string")).alias("route_id"), F.col("idx").alias("segment"), F.when(F.col("idx") % 5 == 4, "MultiLineString").otherwise("LineString").alias("geometry_type"), F.lit(None).cast("string").alias("geometry_role"), F.lit(True).alias("is_primary"))
    stored_ = made.where("train_id % 3 = 1 AND segment > 0").withColumn("template_key", F.when(F.col("train_id") % 750 == 1, F.col("template_key")).otherwise(""))
    return route.matched_routes(t, made.where("train_id % 3 = 0"), stored_, every=True).select("train_id", "route_id", "segment", "origin")


@query(" SELECT train_id, CAST(row_number() OVER (ORDER BY CASE WHEN train_id % 7 = 2 THEN 2 WHEN train_id % 7 <> 0 THEN 1 ELSE 0 END, ord) - 1 AS BIGINT) AS place FROM tr WHERE visible")
def draw_order(spark, d):
    level = itinerary.emphasis(F.col("train_id") % 7 == 2, F.col("train_id") % 7 != 0)
    return render.draw_order(itinerary.visible_in_scope(trains(spark, d)), level).select("train_id", "place")


@query(f""", w AS (SELECT train_id, idx, lon, lat, lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat FROM ps WINDOW w AS (PARTITION BY train_id ORDER BY idx)),
h AS (SELECT *, {hav('lon', 'lat', 'b_lon', 'b_lat')} / 3000 AS steps FROM w),
p AS (SELECT lon + (b_lon - lon) * k / n AS lon, lat + (b_lat - lat) * k / n AS lat FROM (SELECT *, greatest(1, CAST(floor(coalesce(steps, 1)) AS BIGINT)) AS n, unnest(generate_series(0, greatest(1, CAST(floor(coalesce(steps, 1)) AS BIGINT)) - 1)) AS k FROM (SELECT lon, lat, coalesce(b_lon, lon) AS b_lon, coalesce(b_lat, lat) AS b_lat, steps FROM h))),
c AS (SELECT DISTINCT z, CASE WHEN z > 10 THEN 2 ELSE 1 END AS b, CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x0, CAST(floor((1 - ln(tan(radians(lat)) + sqrt(pow(tan(radians(lat)), 2) + 1)) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y0 FROM p, (SELECT unnest(range(5, 13)) AS z))
SELECT DISTINCT CAST(z AS INTEGER) AS z, x0 + i AS x, y0 + j AS y FROM c, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE abs(i) <= b AND abs(j) <= b""")
def corridor_cover(spark, d):
    """Tiles along all trains, with points at most about 3 km apart between stops."""
    return render.corridor_tiles(render.densified(placed_stops(spark, d)))
