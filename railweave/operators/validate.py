"""Rules that trains must keep, as columns; violations are rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import valid_date


def _blank(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)), F.lit("")) == ""


def train_rules() -> dict[str, Column]:
    """Rule name -> condition under which a train (id, number, name, date, color, stops, route_sections) breaks it."""
    stop = lambda k: F.try_element_at("stops", F.lit(k))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return {
        "id_missing": _blank("id"),
        "number_missing": _blank("number"),
        "name_missing": _blank("name"),
        "date_invalid": F.col("date").isNotNull() & ~valid_date(F.col("date")),
        "color_invalid": F.col("color").isNotNull() & ~F.col("color").rlike("^#[0-9a-fA-F]{6}$"),
        "too_few_stops": F.coalesce(F.size("stops"), F.lit(0)) < 2,
        "first_stop_arrives_and_departs": stop(1)["arrival"].isNotNull() & stop(1)["departure"].isNotNull(),
        "last_stop_arrives_and_departs": stop(-1)["arrival"].isNotNull() & stop(-1)["departure"].isNotNull(),
        "stop_name_missing": F.exists("stops", lambda s: blank(s["name"])),
        "stop_type_missing": F.exists("stops", lambda s: blank(s["stop_type"])),
        "section_end_missing": F.exists("route_sections", lambda s: blank(s["from"]) | blank(s["to"])),
    }


def violations(trains: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(id, rule): one row for each rule a train breaks, and id_repeated for ids of several trains."""
    rules = rules or train_rules()
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    one = trains.select("id", F.explode(broken).alias("rule"))
    repeated = trains.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id_repeated").alias("rule"))
    return one.unionByName(repeated)


def branch_leaks(sections: DataFrame, station_lines: DataFrame) -> DataFrame:
    """(train_id, segment, station_id): section ends on several lines where the section names none.

    sections: (train_id, segment, line_names, station_id), one row an end; station_lines: (station_id, line).
    """
    many = station_lines.groupBy("station_id").agg(F.count_distinct("line").alias("_n")).where("_n > 1")
    free = sections.where(F.coalesce(F.size("line_names"), F.lit(0)) <= 0)
    return free.join(many, "station_id", "left_semi").select("train_id", "segment", "station_id").distinct()


def off_line_passes(stops: DataFrame) -> DataFrame:
    """(train_id, idx): passed stops on none of the lines of their neighbours. stops: (train_id, idx, stop_type, lines)."""
    w = Window.partitionBy("train_id").orderBy("idx")
    near = stops.withColumns({"_a": F.lag("lines").over(w), "_b": F.lead("lines").over(w)})
    apart = lambda c: ~F.coalesce(F.arrays_overlap("lines", c), F.lit(False))
    return near.where((F.col("stop_type") == "pass_through") & apart("_a") & apart("_b")).select("train_id", "idx")


#: What each kind of finding weighs.
SEVERITY = {"id_missing": "error", "id_repeated": "error", "too_few_stops": "error", "date_invalid": "error", "unresolved_stop": "warning", "unsolved_section": "warning", "branch_leak": "info"}


def diagnostics(found: DataFrame, kind: str, message: str) -> DataFrame:
    """(level, type, train_id, station_name, message) rows for findings (train_id, station_name)."""
    return found.select(F.lit(SEVERITY.get(kind, "warning")).alias("level"), F.lit(kind).alias("type"), "train_id", "station_name", F.format_string(message, F.coalesce("station_name", F.lit(""))).alias("message"))
