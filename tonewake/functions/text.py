"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(x: Column) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.regexp_replace(x, P.EDGES, "")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def date_string(parts: Column) -> Column:
    """The first date in an array of strings, joined with blanks; null without one."""
    return F.nullif(F.regexp_extract(F.array_join(parts, " "), P.DATE, 0), F.lit(""))


def parsed_date(text: Column) -> Column:
    """The day of a date string such as `Aug 5, 2020` or `January 31 2019`; null where there is no such day."""

    def canonical(bits: Column) -> Column:
        return F.when(bits.isNotNull(), F.concat_ws(" ", F.initcap(F.substring(F.get(bits, F.lit(0)), 1, 3)), F.get(bits, F.lit(1)), F.get(bits, F.lit(2))))

    return F.to_date(F.try_to_timestamp(bound(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)), canonical), F.lit("MMM d yyyy")))


def call_minutes(parts: Column) -> Column:
    """Minutes since midnight of the first `H:MM a.m.` or `p.m.`; null where there is none or it is no time.

    The pattern runs once; hour, minute and half are cut from what it found."""

    def minutes(found: Column) -> Column:
        hour, minute = (F.try_to_number(c, F.lit("99")).cast("int") for c in (F.substring_index(found, ":", 1), F.substring(F.substring_index(found, ":", -1), 1, 2)))
        return bound(F.struct(hour.alias("hour"), minute.alias("minute"), F.lower(F.right(found, F.lit(4))).alias("half")), turned)

    def turned(t: Column) -> Column:
        hour = F.when((t["half"] == "p.m.") & (t["hour"] != 12), t["hour"] + 12).when((t["half"] == "a.m.") & (t["hour"] == 12), 0).otherwise(t["hour"])
        return F.when((hour <= 23) & (t["minute"] <= 59), hour * 60 + t["minute"])

    return bound(F.nullif(F.regexp_extract(F.array_join(parts, " "), P.CALL_TIME, 0), F.lit("")), minutes)


def exchange_name(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, P.EXCHANGE, 1), F.lit(""))


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.length(x) / F.lit(P.CHARS_PER_TOKEN)).cast("int"))


def word_count(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0))


def sentences(x: Column) -> Column:
    return F.split(strip(x), P.SENTENCE_END)


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
