"""Rail sections and stations from GeoJSON feature collections."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import first_truthy, normalize_name


def _points(coordinates: Column) -> Column:
    """[lon, lat] pairs as rounded points."""
    return F.transform(coordinates, lambda c: F.struct(F.round(c[0], 5).alias("lon"), F.round(c[1], 5).alias("lat")))


def geometry_lines(geometry: Column) -> Column:
    """Lines of a GeoJSON geometry text, each an array of points at 5 decimals; a point is a line of one, anything else is none.

    The depth of the coordinates depends on the type, so the text is parsed for each type.
    """
    kind = F.get_json_object(geometry, "$.type")
    at = F.get_json_object(geometry, "$.coordinates")
    line, lines, point = F.from_json(at, "array<array<double>>"), F.from_json(at, "array<array<array<double>>>"), F.from_json(at, "array<double>")
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return F.when(kind == "LineString", F.array(_points(line))).when(kind == "MultiLineString", F.transform(lines, _points)).when(kind == "Point", F.array(_points(F.array(point)))).otherwise(none)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(ord, properties, geometry): the features of GeoJSON files, both as JSON text; order is that in the file."""
    files = spark.read.text(path, wholetext=True)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    return files.select(F.posexplode(features).alias("ord", "feature")).select("ord", F.get_json_object("feature", "$.properties").alias("properties"), F.get_json_object("feature", "$.geometry").alias("geometry"))


def _property(*names: str) -> Column:
    return first_truthy(*(F.get_json_object("properties", f"$.{n}") for n in names))


def rail_sections(features: DataFrame) -> DataFrame:
    """(section_id, class_code, institution, line, operator, lines) of rail features."""
    return features.select(F.col("ord").cast("bigint").alias("section_id"), F.coalesce(_property("N02_001"), F.lit("")).alias("class_code"), F.coalesce(_property("N02_002", "institution_type_code"), F.lit("")).alias("institution"), F.coalesce(_property("N02_003", "line_name"), F.lit("-")).alias("line"), F.coalesce(_property("N02_004", "operator"), F.lit("-")).alias("operator"), geometry_lines(F.col("geometry")).alias("lines"))


def stations(features: DataFrame, shown: str = "first_vertex") -> DataFrame:
    """(station_id, ord, name, norm_name, code, group_code, line, operator, institution, lon, lat, lines) of station features.

    shown: the point that stands for a station: its `display_point`, else the first vertex
    of its line, or with `midpoint` the middle vertex of its longest line.
    """
    made = features.select(F.col("ord").cast("bigint").alias("ord"), F.coalesce(_property("station_name", "name", "N02_005", "station", "id"), F.lit("")).alias("name"), F.coalesce(_property("n02_station_code", "N02_005c", "station_id"), F.lit("")).alias("code"), F.coalesce(_property("n02_group_code", "N02_005g"), F.lit("")).alias("group_code"), F.coalesce(_property("line_name", "N02_003"), F.lit("-")).alias("line"), F.coalesce(_property("operator", "N02_004"), F.lit("-")).alias("operator"), F.coalesce(_property("institution_type_code", "N02_002"), F.lit("")).alias("institution"), F.from_json(F.get_json_object("properties", "$.display_point"), "array<double>").alias("display"), geometry_lines(F.col("geometry")).alias("lines"))
    longest = F.try_element_at(F.array_sort("lines", lambda a, b: F.size(b) - F.size(a)), F.lit(1))
    point = F.try_element_at(longest, (F.floor(F.size(longest) / 2) + 1).cast("int")) if shown == "midpoint" else F.try_element_at(F.try_element_at("lines", F.lit(1)), F.lit(1))
    return made.select(F.col("ord").alias("station_id"), "ord", "name", normalize_name(F.col("name")).alias("norm_name"), "code", "group_code", "line", "operator", "institution", F.coalesce(F.col("display")[0], point["lon"]).alias("lon"), F.coalesce(F.col("display")[1], point["lat"]).alias("lat"), "lines")


#: The properties that rail sections and stations must have.
SECTION_FIELDS = ("N02_001", "N02_002", "N02_003", "N02_004")
STATION_FIELDS = SECTION_FIELDS + ("N02_005", "N02_005c", "N02_005g")


def feature_findings(features: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(ord, level, finding): an error for each required property a feature (ord, properties, geometry) lacks, a warning where its geometry is no line and is skipped.

    A blank or null property is lacking; one line of two points or more makes a geometry.
    """
    lacking = F.array_compact(F.array(*(F.when(_property(n).isNull(), F.struct(F.lit("error").alias("level"), F.lit(f"{n} is missing").alias("finding"))) for n in required)))
    drawn = F.coalesce(F.exists(geometry_lines(F.col("geometry")), lambda line: F.size(line) >= 2), F.lit(False))
    kind = F.coalesce(F.get_json_object("geometry", "$.type"), F.lit("none"))
    skipped = F.when(drawn, F.array().cast("array<struct<level:string,finding:string>>")).otherwise(F.array(F.struct(F.lit("warning").alias("level"), F.concat(F.lit("geometry is skipped: "), kind).alias("finding"))))
    return features.select("ord", F.explode(F.concat(lacking, skipped)).alias("f")).select("ord", "f.*")
