"""Dates and times of day as itineraries write them."""

from pyspark.sql import Column, functions as F

UNDATED, ALL_DATES = "undated", "__all__"


def valid_date(col: Column) -> Column:
    """Whether a text is YYYY-MM-DD with month 1-12 and day 1-31; the calendar is not asked."""
    month, day = F.substring(col, 6, 2).try_cast("int"), F.substring(col, 9, 2).try_cast("int")
    return F.coalesce(col.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & month.between(1, 12) & day.between(1, 31), F.lit(False))


def normalize_date(col: Column) -> Column:
    """The trimmed text with dashes for slashes if that is a valid date, else NULL; digits are not padded."""
    told = F.replace(F.trim(col), F.lit("/"), F.lit("-"))
    return F.when(valid_date(told), told)


def train_date(explicit: Column, fallback: Column, inferred: Column) -> Column:
    """The first date there is, else `undated`."""
    return F.coalesce(normalize_date(explicit), normalize_date(fallback), inferred, F.lit(UNDATED))


def parse_minutes(col: Column) -> Column:
    """Minutes since midnight of H:MM or HH:MM with an optional +days; what follows is not looked at; else NULL."""
    text, form = F.trim(col), r"^([0-9]{1,2}):([0-9]{2})(?:\s*\+\s*([0-9]+))?"
    part = lambda k: F.regexp_extract(text, form, k).try_cast("int")
    return part(1) * 60 + part(2) + F.coalesce(part(3), F.lit(0)) * 1440


def format_minutes(minutes: Column) -> Column:
    """HH:MM of minutes since midnight, of any day."""
    day = F.pmod(minutes, F.lit(1440))
    return F.concat(F.lpad(F.floor(day / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((day % 60).cast("string"), 2, "0"))


def date_label(date: Column, undated: str = "Undated", everything: str = "All") -> Column:
    return F.when(date == UNDATED, undated).when(date == ALL_DATES, everything).otherwise(date)
