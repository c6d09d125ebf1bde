"""Names, keys and other text columns of itineraries and stations."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .dates import normalize_date

#: Small kana that station names use for large ones.
KANA = ("ヶヵゖゕ", "ケカけか")


def blank_to_null(col: Column) -> Column:
    """NULL for a text that is null or only white space; otherwise the text as it is."""
    return F.when(F.trim(col) != "", col)


def first_truthy(*cols: Column) -> Column:
    """The first column that is neither null nor the empty text, else NULL."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


@F.arrow_udf(T.StringType())
def _nfkc(names: pa.Array) -> pa.Array:
    known: dict[str, str] = {}
    return pa.array([x if x is None else known.get(x) or known.setdefault(x, unicodedata.normalize("NFKC", x)) for x in names.to_pylist()], pa.string())


def normalize_name(col: Column) -> Column:
    """Comparable station name: compatibility form, no white space, large kana. NULL gives the empty text."""
    return F.translate(F.regexp_replace(_nfkc(F.coalesce(col, F.lit(""))), r"[\s　]+", ""), *KANA)


def normalized_names(frame: DataFrame, col: str, into: str) -> DataFrame:
    """`frame` with a normalised copy of a name column, worked out once for each distinct name."""
    names = frame.select(F.col(col).alias("_raw")).distinct().withColumn(into, normalize_name(F.col("_raw")))
    return frame.join(names, F.col(col).eqNullSafe(F.col("_raw")), "left").drop("_raw")


def infer_date(train_id: Column) -> Column:
    """Date from the first run of eight digits in an id that no digit adjoins; NULL if it is none."""
    digits = F.regexp_extract(F.coalesce(train_id, F.lit("")), r"(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)", 1)
    return normalize_date(F.when(digits != "", F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))))


def _sorted_list(items: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x != "")), ",")


def template_key(from_code: Column, from_name: Column, to_code: Column, to_name: Column, lines: Column, operators: Column) -> Column:
    """Key of a section's route: its ends by code or else name, and its sorted line and operator lists."""
    empty = F.lit("")
    return F.concat(F.coalesce(first_truthy(from_code, from_name), empty), F.lit("->"), F.coalesce(first_truthy(to_code, to_name), empty), F.lit("|lines:"), _sorted_list(lines), F.lit("|operators:"), _sorted_list(operators))


def cache_key(codes: Column, policy: Column, template: Column) -> Column:
    """Key of a solved route: allowed institutions, sorted policy parts and the template key."""
    return F.concat_ws("|", _sorted_list(codes), F.array_join(F.array_sort(policy), ","), template)


def degrees_e5(value: Column) -> Column:
    """A coordinate in whole hundred-thousandths of a degree."""
    return F.round(value * 100000).cast("bigint")


def coord_key(lon_e5: Column, lat_e5: Column) -> Column:
    """One number for a point on the 5-decimal grid."""
    return (lon_e5 + 18000000) * 100000000 + (lat_e5 + 9000000)


def segment_key(a: Column, b: Column) -> Column:
    """Key of the undirected segment between two points."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def grid_cell(e5: Column, cell: int = 1000) -> Column:
    """Index of the grid cell (0.01 degrees wide, by default) of a coordinate."""
    return F.floor(e5 / cell).cast("bigint")


def escape_html(col: Column) -> Column:
    out = col
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def normalize_color(col: Column, default: str = "#d9364f") -> Column:
    return F.when(col.rlike("^#[0-9a-fA-F]{6}$"), col).otherwise(F.lit(default))


def hex_to_rgb(col: Column) -> Column:
    """struct<r, g, b> of #RRGGBB; another text gives the default colour."""
    good = normalize_color(col)
    return F.struct(*(F.conv(F.substring(good, at, 2), 16, 10).cast("int").alias(name) for name, at in (("r", 2), ("g", 4), ("b", 6))))


def unknown_keys(document: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object text that are not allowed, sorted; NULL where it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, allowed))))


def localized_names(frame: DataFrame, names: DataFrame, col: str, into: str, style: str = "en") -> DataFrame:
    """`frame` with each name followed by its reading; names without one stay as they are.

    names: (name, reading), a table with one row a name; Spark broadcasts it if it is small.
    """
    left, right = ("（", "）") if style == "ja" else (" (", ")")
    readings = names.select(F.col("name").alias("_name"), F.col("reading").alias("_reading"))
    told = F.when(F.col("_reading").isNotNull(), F.concat(F.col(col), F.lit(left), F.col("_reading"), F.lit(right))).otherwise(F.col(col))
    return frame.join(readings, F.col(col) == F.col("_name"), "left").withColumn(into, told).drop("_name", "_reading")
