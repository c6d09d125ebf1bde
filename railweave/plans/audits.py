"""Audits of the network as queries, each beside its twin in SQL."""

from pyspark.sql import Window, functions as F

from ..checkpoints import stored
from ..functions import geo
from ..operators import audit, graph
from . import queries
from .model import haversine_sql as hav, line_hops, stations
from .queries import query

#: Hops of a line over this length count as gaps, so that lines fall into parts; chords to the third next station, and ways by rail, up to these.
GAP_M, CHORD_M, WAY_M = 40_000, 9_000, 60_000

_RAIL = f""", rl AS (SELECT *, {hav('a_lon', 'a_lat', 'b_lon', 'b_lat')} AS m FROM hop),
ok AS (SELECT src, dst FROM rl WHERE m <= {GAP_M}),
ways AS (SELECT src, dst FROM ok UNION ALL SELECT dst, src FROM ok),
reach AS (SELECT DISTINCT src AS node, src AS root FROM ways UNION SELECT w.dst, r.root FROM reach r JOIN ways w ON w.src = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


def _rails(spark, d):
    """Edges of line hops that are no gaps, with the places of both ends."""
    at = lambda end: stations(spark, d).select(F.col("station_id").alias(end), F.col("lon").alias(f"{end}_lon"), F.col("lat").alias(f"{end}_lat"))
    rails = graph.section_edges(line_hops(spark, d)).where(F.col("length_m") <= GAP_M).withColumn("is_connector", F.lit(False))
    return rails.drop("section_id").join(at("src"), "src").join(at("dst"), "dst")


@query(_RAIL + " SELECT node, component FROM comp", recursive=True)
def rail_components(spark, d):
    """What rail alone joins: the least station that each one reaches over hops of its line."""
    return audit.components(_rails(spark, d), stored)


@query(_RAIL + f""", pts AS (SELECT station_id, line, lon, lat, row_number() OVER w AS k, sum(m) OVER w AS far FROM (
  SELECT station_id, line, lon, lat, coalesce({hav('lag(lon) OVER v', 'lag(lat) OVER v', 'lon', 'lat')}, 0) AS m FROM st WINDOW v AS (PARTITION BY line ORDER BY station_id)) WINDOW w AS (PARTITION BY line ORDER BY station_id)),
cell AS (SELECT station_id, lon, lat, CAST(floor(lon_e5 / 1000.0) AS BIGINT) * 100000 + CAST(floor(lat_e5 / 1000.0) AS BIGINT) AS g, {hav('(floor(lon_e5 / 1000.0) * 1000 + 500) / 100000.0::DOUBLE', '(floor(lat_e5 / 1000.0) * 1000 + 500) / 100000.0::DOUBLE', 'lon', 'lat')} AS metres FROM st),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY metres, station_id) AS k FROM cell WHERE metres <= 520) WHERE k <= 24),
ch AS (
  SELECT a.station_id AS src, b.station_id AS dst, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS chord_m FROM near a JOIN near b ON a.g = b.g AND a.station_id < b.station_id WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900
  UNION ALL SELECT a.station_id, b.station_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} FROM pts a JOIN pts b ON a.line = b.line AND b.k = a.k + 3 WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {CHORD_M}),
one AS (SELECT src, dst, min(chord_m) AS chord_m FROM ch GROUP BY src, dst),
jg AS (
  SELECT o.*, coalesce(x.component = y.component, false) AS connected, CASE WHEN x.component = y.component AND abs(p.far - q.far) <= {WAY_M} THEN abs(p.far - q.far) END AS rail_m
  FROM one o LEFT JOIN comp x ON o.src = x.node LEFT JOIN comp y ON o.dst = y.node JOIN pts p ON o.src = p.station_id JOIN pts q ON o.dst = q.station_id)
SELECT src, dst, round(chord_m, 2) AS chord_m, connected, round(rail_m, 2) AS rail_m, round(rail_m / chord_m, 1) AS ratio,
  CASE WHEN NOT connected THEN 'apart' WHEN rail_m IS NULL THEN 'none in limit' WHEN round(rail_m / chord_m, 1) <= 1.5 THEN 'parallel' ELSE 'shortcut' END AS verdict FROM jg""", recursive=True)
def chord_audit(spark, d):
    """Transfers between stations near each other, and chords to the third next station of a line, against the way by rail."""
    near = queries.transfer_chords(spark, d).select("src", "dst", F.col("gap_m").alias("chord_m"))
    w = Window.partitionBy("line").orderBy("station_id")
    third = lambda c: F.lead(c, 3).over(w)
    along = stations(spark, d).select(F.col("station_id").alias("src"), third("station_id").alias("dst"), geo.haversine_m(F.col("lon"), F.col("lat"), third("lon"), third("lat")).alias("chord_m")).where(F.col("chord_m") <= CHORD_M)
    told = audit.chord_audit(near.unionByName(along), stored(_rails(spark, d)), stored, WAY_M)
    return told.select("src", "dst", F.round("chord_m", 2).alias("chord_m"), "connected", F.round("rail_m", 2).alias("rail_m"), "ratio", "verdict")
