"""Edits of a store, filled stops, boxes and points as queries, each beside its twin in SQL."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import render, resolve, store
from .model import haversine_sql as hav, line_hops, placed_stops, stations, trains
from .queries import query


@query(""", a AS (SELECT id, ord, name, false AS copied FROM tr WHERE train_id % 7 <> 3 UNION ALL SELECT id || '-copy', ord, CASE WHEN name = '' THEN 'Train' ELSE name END || ' Copy', true FROM tr WHERE train_id % 10 = 0 AND train_id % 7 <> 3),
b AS (SELECT a.id, CASE WHEN tr.train_id % 4 = 1 AND NOT copied THEN 'new' ELSE a.name END AS name, copied, a.ord FROM a LEFT JOIN tr ON tr.id = a.id)
SELECT id, name, CAST(row_number() OVER (ORDER BY copied, ord) AS BIGINT) AS place FROM b""")
def edited_store(spark, d):
    """A seventh of the trains deleted, a tenth of the others copied to the end, a fourth replaced as a whole."""
    t = trains(spark, d).select("id", "ord", "name", "train_id")
    left = store.removed(t, t.where("train_id % 7 = 3"))
    both = store.duplicated(left, left.where("train_id % 10 = 0").select("id"))
    told = store.replaced(both, t.where("train_id % 4 = 1").select("id", "ord", F.lit("new").alias("name"), "train_id"))
    return store.placed(told).select("id", "name", "place")


@query(""", s AS (SELECT train_id, idx, station_id, CASE WHEN idx % 2 = 0 THEN 'old name' ELSE name END AS name, CASE WHEN idx % 3 = 0 THEN '' ELSE code END AS code FROM ps)
SELECT s.train_id, s.idx, CASE WHEN s.station_id % 4 <> 0 THEN st.name ELSE s.name END AS name, CASE WHEN s.station_id % 4 <> 0 THEN st.code ELSE s.code END AS code, CASE WHEN s.station_id % 4 <> 0 THEN 'g' || st.code END AS group_code
FROM s JOIN st ON s.station_id = st.station_id""")
def filled_stops(spark, d):
    """Name, code and group of the station of each stop; one station of four cannot be resolved."""
    p = placed_stops(spark, d)
    asked = p.select("train_id", "idx", F.when(F.col("idx") % 2 == 0, "old name").otherwise(F.col("name")).alias("name"), F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("code")).alias("code"))
    found = p.where("station_id % 4 <> 0").select("train_id", "idx", "name", "code", F.concat(F.lit("g"), F.col("code")).alias("group_code"))
    return resolve.filled(asked, found)


@query(""", r AS (SELECT train_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ps WHERE train_id % 3 = 0 AND idx < 3 GROUP BY train_id),
s AS (SELECT train_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ps GROUP BY train_id)
SELECT s.train_id, CASE WHEN r.train_id IS NULL THEN 'stops' ELSE 'routes' END AS source, coalesce(r.west, s.west) AS west, coalesce(r.south, s.south) AS south, coalesce(r.east, s.east) AS east, coalesce(r.north, s.north) AS north FROM s LEFT JOIN r ON s.train_id = r.train_id""")
def fit_bounds(spark, d):
    """Boxes of the routes of a third of the trains, and of the stops of the others."""
    p = placed_stops(spark, d)
    drawn = p.where("train_id % 3 = 0 AND idx < 3").select("train_id", F.array(F.struct("lon", "lat")).alias("points"))
    return render.fit_bounds(drawn, p.select("train_id", "lon", "lat"))


@query(f" SELECT src AS section_id, round({hav('least(a_lon, b_lon)', 'least(a_lat, b_lat)', 'greatest(a_lon, b_lon)', 'greatest(a_lat, b_lat)')}, 2) AS diagonal_m FROM hop")
def box_diagonals(spark, d):
    p = F.col("points")
    box = (F.least(p[0]["lon"], p[1]["lon"]), F.least(p[0]["lat"], p[1]["lat"]), F.greatest(p[0]["lon"], p[1]["lon"]), F.greatest(p[0]["lat"], p[1]["lat"]))
    return line_hops(spark, d).select("section_id", F.round(geo.diagonal_m(*box), 2).alias("diagonal_m"))


@query(f""", q AS (SELECT station_id, lon, lat, lon + CAST(station_id % 5 AS DOUBLE) * 0.000006 AS o_lon FROM st)
SELECT station_id, lon = o_lon AS same, {hav('lon', 'lat', 'o_lon', 'lat')} <= 1.5 AS near FROM q""")
def point_equality(spark, d):
    """Each station against a point up to some two metres to its east."""
    s = stations(spark, d).select("station_id", "lon", "lat", (F.col("lon") + (F.col("station_id") % 5).cast("double") * 0.000006).alias("o_lon"))
    at = lambda c: F.struct(F.col(c).alias("lon"), F.col("lat").alias("lat"))
    return s.select("station_id", geo.same_point(at("lon"), at("o_lon")).alias("same"), geo.near_point(at("lon"), at("o_lon")).alias("near"))
