"""Dates, game clocks and unit parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD, OVERTIME = 1200, 300
#: Pounds in a kilogram.
KG = 2.2046226218


def unix_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def parse_timestamp(c: Column) -> Column:
    """UTC time of a text; null if it is none."""
    return F.try_to_timestamp(c)


def clock_seconds(c: Column, bad: float | None = 0.0) -> Column:
    """`MM:SS(.s)`, an ISO 8601 time span of minutes and seconds, or plain seconds; anything else is `bad`."""
    t = F.trim(c)
    halves = F.split(t, ":")
    colon = F.when(F.size(halves) == 2, F.get(halves, F.lit(0)).try_cast("int") * 60 + F.get(halves, F.lit(1)).try_cast("double"))
    # a span: minutes and seconds are found by their unit, and together with the marks must make up the text
    minutes, seconds = (F.regexp_extract(t, rf"([0-9.]+){unit}", 1) for unit in "MS")
    written = F.concat(F.lit("PT"), *(F.when(x == "", "").otherwise(F.concat(x, F.lit(unit))) for x, unit in ((minutes, "M"), (seconds, "S"))))
    worth = lambda x: F.when(x == "", 0.0).otherwise(x.try_cast("double"))
    span = F.when((t == written) & (F.length(t) > 2), worth(minutes) * 60 + worth(seconds))
    return F.coalesce(colon, span, t.try_cast("double"), F.lit(bad).cast("double"))


def game_seconds(period: Column, remaining: Column) -> Column:
    """Seconds since tip-off: two halves, then overtimes."""
    return F.when(period <= 2, (period - 1) * PERIOD + (PERIOD - remaining)).otherwise(2 * PERIOD + (period - 3) * OVERTIME + (OVERTIME - remaining))


def interval_seconds(remaining: Column, following: Column) -> Column:
    """Seconds to the next event on a falling clock; a rising clock is a new period, so the rest of the old one counts.

    0 without a next event or a clock, and where more than a period would pass.
    """
    gap = F.when(following > remaining, remaining).otherwise(remaining - following)
    return F.when(gap.between(0, PERIOD), gap).otherwise(F.lit(0))


def year_in_name(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")


def height_inches(c: Column) -> Column:
    """`6-5`, `6'5"`, cm (by its mark, or a bare number of 120 to 260), feet (up to 9.5) or inches; outside 60..96 is null."""
    t = F.lower(F.trim(c))
    ft = r"^(\d)\s*[-'’]\s*(\d{1,2})\D*$"
    plain = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    inches = t.rlike('in|"')
    v = F.when(t.rlike(ft), F.regexp_extract(t, ft, 1).try_cast("double") * 12 + F.regexp_extract(t, ft, 2).try_cast("double"))
    v = v.when(t.contains("cm") | (~inches & plain.between(120, 260)), plain / 2.54).when(plain <= 9.5, plain * 12).otherwise(plain)
    return F.when(v.between(60, 96), v)


def weight_pounds(c: Column) -> Column:
    """kg if the text says so or a bare number is below 95; outside 110..400 is null."""
    plain = F.regexp_extract(F.trim(c), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    v = F.when(F.lower(c).contains("kg") | (~F.lower(c).contains("lb") & (plain < 95)), plain * KG).otherwise(plain)
    return F.when(v.between(110, 400), v)


def mixed_weight_pounds(c: Column) -> Column:
    """Numbers of which some are kg: 50 up to 130 are kg, 130 to 380 pounds; outside 110..380 pounds is null."""
    x = c.try_cast("double")
    v = F.when((x >= 50) & (x < 130), x * KG).otherwise(x)
    return F.when(v.between(110, 380), v)


def bmi(pounds: Column, inches: Column) -> Column:
    return F.when(inches > 0, 703.0 * pounds / (inches * inches))
