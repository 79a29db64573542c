"""Dates in two calendars as native column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import SPACE, fa_digits_to_latin, let


def jalali_to_gregorian(y: Column, m: Column, d: Column) -> Column:
    """Date of a Solar Hijri year, month and day; null when there is no such day.

    Leap years follow the 33-year cycle. The day number counts the days of whole cycles and years, then of the
    months: six of 31 days, then of 30.
    """
    y, m, d = (c.cast("int") for c in (y, m, d))
    a = y + F.lit(1595)
    cycle_year = F.pmod(a, F.lit(33))
    cycles = F.floor(a / F.lit(33)).cast("int")
    leap = (F.pmod(cycle_year, F.lit(4)) == 0) & (cycle_year != 32)
    last = F.when(m < 7, 31).when(m < 12, 30).when(leap, 30).otherwise(29)
    valid = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)
    before_month = F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186)
    leap_days = cycles * 8 + F.floor((cycle_year + 3) / F.lit(4)).cast("int")
    days = F.lit(-355668 - 719528) + a * 365 + leap_days + d + before_month
    return F.when(valid, F.date_from_unix_date(days))


def _numbers(parts: Column, y: Column, m: Column, d: Column) -> Column:
    pick = [F.get(parts, i).try_cast("int").alias(n) for n, i in (("y", y), ("m", m), ("d", d))]
    return let(F.struct(*pick), lambda t: jalali_to_gregorian(t["y"], t["m"], t["d"]))


def _is_jalali_year(part: Column) -> Column:
    return F.rlike(part, F.lit("^(1[34][0-9]{2}|1500)$"))


def parse_general(text: Column) -> Column:
    """ISO dates and timestamps, slash forms year first or month first, and month names; null when unreadable.

    Slash forms are rewritten to the ISO form: a cast that fails gives null without the cost of a parser error.
    """
    iso = F.when(F.contains(text, F.lit("/")), F.translate(text, "/", "-")).otherwise(text)
    month_first = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})\b.*$", "$3-$1-$2")
    return (
        F.when(F.rlike(text, F.lit(r"^\d{1,2}/")), month_first.try_cast("date"))
        .when(F.rlike(text, F.lit("(?i)[a-z]{3}")), _named_month(text))
        .otherwise(iso.try_cast("date"))
    )


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _named_month(text: Column) -> Column:
    """``Apr 5, 2026``, ``5 April 2026`` and the like: a month name, a day of one or two digits and a year of four."""
    name = F.lower(F.regexp_extract(text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", 1))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    day = F.regexp_extract(text, r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1)
    year = F.regexp_extract(text, r"\b(\d{4})\b", 1)
    iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((month > 0) & (day != "") & (year != ""), iso.try_cast("date"))


def unify_date(text: Column) -> Column:
    """One date column from mixed calendars: a year 1300..1500, first or last, marks Solar Hijri."""
    return let(fa_digits_to_latin(text.cast("string")), _unify_plain)


def _unify_plain(plain: Column) -> Column:
    token = F.translate(F.substring_index(plain, " ", 1), "/", "-")
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    return let(
        F.split(token, "-"),
        lambda parts: F.when(_is_jalali_year(F.get(parts, zero)), _numbers(parts, zero, one, two))
        .when(_is_jalali_year(F.get(parts, F.size(parts) - 1)), _numbers(parts, F.size(parts) - 1, one, zero))
        .otherwise(parse_general(plain)),
    )


def parse_native_date(text: Column) -> Column:
    """Strict ``year/month/day`` Solar Hijri with Persian or Latin digits, first token only."""
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    token = F.regexp_extract(fa_digits_to_latin(text), rf"^[{SPACE}]*([0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}})(?:[{SPACE}]|$)", 1)
    # A text of another form gives the token '', whose parts are no numbers.
    return let(F.split(token, "/"), lambda parts: _numbers(parts, zero, one, two))


def parse_date(text: Column, native: Column) -> Column:
    return F.when(native, parse_native_date(text)).otherwise(parse_general(text))


def month_key(date: Column) -> Column:
    """``yyyy-MM`` of a date, or the first seven characters of a text date."""
    return F.substring(date.cast("string"), 1, 7)


def month_end(date: Column) -> Column:
    return F.last_day(date)


def in_range(date: Column, lo: str, hi: str) -> Column:
    return date.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
