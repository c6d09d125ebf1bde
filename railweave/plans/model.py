"""The rail model projected from the star-schema tables.

There is no rail network among the tables, so customers stand for stations, their nations
for lines, orders for trains and order lines for stops. `SQL` has the same projections as
common table expressions for the twins in SQL.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    lon, lat = 13000000 + (key * 7919) % 50000, 3500000 + (key * 104729) % 45000
    return table(spark, sf_dir, "customer").select(
        key.alias("station_id"), key.alias("ord"), F.lpad(text(key), 6, "0").alias("code"),
        F.concat(F.lit("st "), text(key % 331)).alias("name"), F.concat(F.lit("st"), text(key % 331)).alias("norm_name"),
        F.concat(F.lit("L"), text(F.col("c_nationkey"))).alias("line"), F.concat(F.lit("O"), text(F.col("c_nationkey") % 7)).alias("operator"),
        text(1 + F.col("c_nationkey") % 5).alias("institution"), lon.alias("lon_e5"), lat.alias("lat_e5"), (lon / 100000).alias("lon"), (lat / 100000).alias("lat"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by order first: the grouping and the windows by train above it need no other shuffle.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"), F.min("l_quantity").alias("q"))
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_stations"))
    idx = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).cast("bigint")
    kind = F.when(F.col("idx") == 0, "origin").when(F.col("rf") == "N", "pass_through").otherwise("passenger_stop")
    leaves = F.when(F.col("q") % 5 != 0, (F.col("q") * 37).cast("bigint") % 1440)
    told = lines.crossJoin(F.broadcast(n)).withColumn("idx", idx)
    return told.select(F.col("l_orderkey").alias("train_id"), "idx", (F.col("p") % F.col("n_stations")).alias("station_id"), kind.alias("stop_type"), (F.col("ls") == "O").alias("ride"), leaves.alias("departure"))


def placed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).join(stations(spark, sf_dir), "station_id")


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    dated = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        key.alias("train_id"), key.alias("ord"), F.concat(F.lit("tr_"), day, F.lit("_"), key.cast("string")).alias("id"),
        F.when(key % 11 == 0, "undated").otherwise(dated).alias("date"), F.col("o_orderpriority").alias("number"), F.col("o_orderstatus").alias("name"),
        (key % 5 != 0).alias("visible"), F.col("o_custkey").alias("home"),
    )


def line_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring stations of each line as two-point sections."""
    w = Window.partitionBy("line").orderBy("station_id")
    s = stations(spark, sf_dir)
    point = F.struct(F.col("station_id").alias("id"), "lon", "lat")
    told = s.withColumn("_b", F.lead(point).over(w)).withColumn("points", F.array(point, F.col("_b"))).where("_b IS NOT NULL")
    return told.select(F.col("station_id").alias("section_id"), "line", "operator", "institution", "points")


SQL = r"""
st AS (
  SELECT c_custkey AS station_id, c_custkey AS ord, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, 'st ' || CAST(c_custkey % 331 AS VARCHAR) AS name,
    'st' || CAST(c_custkey % 331 AS VARCHAR) AS norm_name, 'L' || CAST(c_nationkey AS VARCHAR) AS line, 'O' || CAST(c_nationkey % 7 AS VARCHAR) AS operator,
    CAST(1 + c_nationkey % 5 AS VARCHAR) AS institution, 13000000 + (c_custkey * 7919) % 50000 AS lon_e5, 3500000 + (c_custkey * 104729) % 45000 AS lat_e5,
    CAST(13000000 + (c_custkey * 7919) % 50000 AS DOUBLE) / 100000 AS lon, CAST(3500000 + (c_custkey * 104729) % 45000 AS DOUBLE) / 100000 AS lat
  FROM customer),
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_returnflag) AS rf, min(l_linestatus) AS ls, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
sp0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS idx FROM lines),
sp AS (
  SELECT l_orderkey AS train_id, idx, p % (SELECT count(*) FROM customer) AS station_id,
    CASE WHEN idx = 0 THEN 'origin' WHEN rf = 'N' THEN 'pass_through' ELSE 'passenger_stop' END AS stop_type, ls = 'O' AS ride,
    CASE WHEN q % 5 <> 0 THEN CAST(q * 37 AS BIGINT) % 1440 END AS departure FROM sp0),
ps AS (SELECT sp.*, st.* EXCLUDE (station_id) FROM sp JOIN st ON sp.station_id = st.station_id),
tr AS (
  SELECT o_orderkey AS train_id, o_orderkey AS ord, 'tr_' || strftime(o_orderdate, '%Y%m%d') || '_' || CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderpriority AS number, o_orderstatus AS name,
    o_orderkey % 5 <> 0 AS visible, o_custkey AS home FROM orders),
hop AS (
  SELECT * FROM (SELECT station_id AS src, lead(station_id) OVER w AS dst, line, operator, institution, lon AS a_lon, lat AS a_lat, lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat,
    lon_e5 AS a_x, lat_e5 AS a_y, lead(lon_e5) OVER w AS b_x, lead(lat_e5) OVER w AS b_y
  FROM st WINDOW w AS (PARTITION BY line ORDER BY station_id)) WHERE dst IS NOT NULL)
"""


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))) * 12742000.0)"
