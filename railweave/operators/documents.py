"""Rules of itinerary documents as they were sent, before their fields are given types."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import UNDATED, valid_date
from ..sources.schemas import INSTITUTIONS

#: What a route policy must say, and its kinds of filter.
POLICY_MODE, FILTER_MODES = "single_primary_route", ("soft", "hard")
REQUIRED = ("id", "name", "number", "origin", "destination")


def _json(v: Column) -> Column:
    """A variant as JSON text, a missing one as null: the first letter tells its kind."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def _part(of: Column, name: str) -> Column:
    return _json(F.try_variant_get(of, f"$.{name}", "variant"))


def _items(of: Column, name: str) -> Column:
    """The members of an array as JSON texts; NULL where it is none."""
    return F.transform(F.try_variant_get(of, f"$.{name}", "array<variant>"), _json)


def _given(json: Column) -> Column:
    """Whether a value counts as given: not missing, null, false, zero or the empty text."""
    return ~json.isin("null", '""', "false", "0", "0.0", "-0")


def _no_strings(json: Column, items: Column) -> Column:
    """Whether a given value is anything but an array of strings."""
    return _given(json) & F.coalesce(F.exists(items, lambda x: ~x.startswith('"')), F.lit(True))


POLICY_FIELDS = ("mode", "jr_only", "allow_alternatives", "allow_browser_straight_line_fallback", "allowed_institution_type_codes", "preferred_line_names", "preferred_operator_names", "institution_filter_mode")
STOP_FIELDS = ("name", "station", "stop_type", "ride_segment", "arrival", "departure")
SECTION_FIELDS = ("from", "from_n02_station_code", "to", "to_n02_station_code", "line_names", "operator_names")
LISTS = ("allowed_institution_type_codes", "preferred_line_names", "preferred_operator_names")


def _told(of: Column, names: tuple[str, ...]) -> list[Column]:
    return [_part(of, n).alias(n) for n in names]


def train_parts(v: Column) -> Column:
    """The parts of a train, a variant, that rules look at, each read once, as JSON text."""
    each = lambda name, fields, lists: F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.struct(*_told(x, fields), *(_items(x, n).alias(f"{n}_items") for n in lists)))
    policy = F.try_variant_get(v, "$.route_policy", "variant")
    return F.struct(
        *_told(v, REQUIRED), F.to_json(F.try_variant_get(v, "$.date", "variant")).alias("date"), _part(v, "style.color").alias("color"), _part(v, "route_sections").alias("route_sections"),
        each("stops", STOP_FIELDS, ()).alias("stops"), each("route_sections", SECTION_FIELDS, ("line_names", "operator_names")).alias("sections"),
        _json(policy).alias("route_policy"), F.struct(*_told(policy, POLICY_FIELDS), *(_items(policy, n).alias(f"{n}_items") for n in LISTS)).alias("policy"),
    )


def document_rules(t: Column) -> dict[str, Column]:
    """Rule name -> condition under which the parts of a train break it."""
    stops, sections, policy, quoted = t["stops"], t["sections"], t["policy"], lambda text: F.lit(f'"{text}"')
    timed = lambda s: _given(s["arrival"]) & _given(s["departure"])
    time = lambda json: (json == "null") | json.startswith('"')
    ruled = lambda wrong: _given(t["route_policy"]) & wrong
    codes = [f'"{c}"' for c in INSTITUTIONS] + list(INSTITUTIONS)
    rules = {f"{c}_missing": ~t[c].startswith('"') | (t[c] == '""') for c in REQUIRED}
    return rules | {
        "date_invalid": t["date"].isNotNull() & (t["date"] != quoted(UNDATED)) & ~(t["date"].startswith('"') & valid_date(F.trim(t["date"], F.lit('"')))),
        "too_few_stops": F.coalesce(F.size(stops), F.lit(0)) < 2,
        "first_stop_arrives_and_departs": timed(F.try_element_at(stops, F.lit(1))),
        "last_stop_arrives_and_departs": timed(F.try_element_at(stops, F.lit(-1))),
        "stop_name_missing": F.exists(stops, lambda s: ~_given(s["name"]) & ~_given(s["station"])),
        "stop_type_missing": F.exists(stops, lambda s: ~_given(s["stop_type"])),
        "ride_segment_not_boolean": F.exists(stops, lambda s: ~s["ride_segment"].isin("true", "false")),
        "stop_time_not_text": F.exists(stops, lambda s: ~time(s["arrival"]) | ~time(s["departure"])),
        "route_sections_no_array": _given(t["route_sections"]) & sections.isNull(),
        "section_end_missing": F.exists(sections, lambda s: (~_given(s["from"]) & ~_given(s["from_n02_station_code"])) | (~_given(s["to"]) & ~_given(s["to_n02_station_code"]))),
        "section_lines_no_texts": F.exists(sections, lambda s: _no_strings(s["line_names"], s["line_names_items"])),
        "section_operators_no_texts": F.exists(sections, lambda s: _no_strings(s["operator_names"], s["operator_names_items"])),
        "policy_mode": ruled(policy["mode"] != quoted(POLICY_MODE)),
        "policy_jr_only_not_boolean": ruled(~policy["jr_only"].isin("true", "false")),
        "policy_allows_alternatives": ruled(policy["allow_alternatives"] != "false"),
        "policy_allows_straight_lines": ruled(policy["allow_browser_straight_line_fallback"] != "false"),
        "policy_institutions": ruled(_given(policy["allowed_institution_type_codes"]) & F.coalesce(F.exists(policy["allowed_institution_type_codes_items"], lambda c: ~c.isin(*codes)), F.lit(True))),
        "policy_lines_no_texts": ruled(_no_strings(policy["preferred_line_names"], policy["preferred_line_names_items"])),
        "policy_operators_no_texts": ruled(_no_strings(policy["preferred_operator_names"], policy["preferred_operator_names_items"])),
        "policy_filter_mode": ruled(_given(policy["institution_filter_mode"]) & ~policy["institution_filter_mode"].isin(*(f'"{m}"' for m in FILTER_MODES))),
        "color_invalid": _given(t["color"]) & ~t["color"].rlike('^"#[0-9a-fA-F]{6}"$'),
    }


def violations(documents: DataFrame, rules: Callable[[Column], dict[str, Column]] = document_rules) -> DataFrame:
    """(source, ord, id, rule): each rule that a train document (source, ord, raw) breaks.

    A text that is no JSON object breaks `not_an_object` alone; of trains of one id in a
    source, all but the first break `id_repeated`.
    """
    # A text that parses is an object if it begins as one.
    parsed = documents.select("source", "ord", F.try_parse_json("raw").alias("_v"), F.col("raw").rlike(r"^[ \t\r\n]*\{").alias("_begins"))
    named = F.when(F.col("_t.id").startswith('"'), F.try_variant_get(F.col("_v"), "$.id", "string"))
    read = parsed.withColumn("_t", train_parts(F.col("_v"))).select("source", "ord", "_t", named.alias("id"), (F.col("_v").isNotNull() & F.col("_begins")).alias("_object"))
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules(F.col("_t")).items())))
    no_object = ~F.coalesce("_object", F.lit(False))
    judged = read.select("source", "ord", "id", F.when(no_object, F.array(F.lit("not_an_object"))).otherwise(broken).alias("_rules"))
    # Only ids and rules are dealt out, so each document is read once; those without an id are dealt one by one.
    alone = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.col("ord"))
    again = F.row_number().over(Window.partitionBy("source", "id", alone).orderBy("ord")) > 1
    more = F.when(F.col("_again") & (F.col("id") != ""), F.array_append("_rules", F.lit("id_repeated"))).otherwise(F.col("_rules"))
    return judged.withColumn("_again", again).select("source", "ord", "id", F.explode(more).alias("rule"))


def valid_only(documents: DataFrame, rules: Callable[[Column], dict[str, Column]] = document_rules) -> DataFrame:
    """`documents` (source, ord, raw, ...) as they are; the job fails, naming the rules, where one breaks any."""
    found = violations(documents, rules).groupBy("source", "ord").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("_rules"))
    said = F.concat(F.lit("train "), F.col("ord").cast("string"), F.lit(" of "), F.col("source"), F.lit(": "), F.col("_rules"))
    judged = documents.join(found, ["source", "ord"], "left")
    return judged.where(F.when(F.col("_rules").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("_rules")
