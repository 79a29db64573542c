"""Calendars and release numbers."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from revlens.functions import dates as dt
from revlens.functions import versions as vr


def day(text):
    return d.date.fromisoformat(text)


@pytest.mark.parametrize(
    ("ymd", "expected"),
    [
        ((1399, 12, 30), "2021-03-20"), ((1403, 12, 30), "2025-03-20"), ((1404, 1, 1), "2025-03-21"),
        ((1405, 1, 1), "2026-03-21"), ((1378, 10, 11), "2000-01-01"), ((1404, 12, 30), None), ((1404, 13, 1), None),
        ((1404, 7, 31), None), ((1404, 6, 31), "2025-09-22"), ((1404, 0, 1), None), ((0, 1, 1), None),
    ],
)
def test_jalali(one, ymd, expected):
    out = one([ymd], lambda f: dt.jalali_to_gregorian(F.col("y"), F.col("m"), F.col("d")), "y int, m int, d int")
    assert out == [expected and day(expected)]


def test_jalali_days_follow_each_other(spark):
    months = F.sequence(F.lit(1), F.lit(12))
    days = F.sequence(F.lit(1), F.lit(31))
    rows = spark.range(1300, 1501).select(F.col("id").alias("y"), F.explode(months).alias("m")).select(
        "y", "m", F.explode(days).alias("d")
    )
    out = rows.select(dt.jalali_to_gregorian(F.col("y"), F.col("m"), F.col("d")).alias("g")).dropna()
    span = out.agg(F.count("*").alias("n"), F.countDistinct("g").alias("k"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    r = span.first()
    assert r.lo == day("1921-03-21") and r.n == r.k == (r.hi - r.lo).days + 1


def test_unify_date(one):
    values = [
        "1404/07/09", "۱۴۰۴/۰۷/۰۹ ۱۲:۳۰", "09-07-1404", "2025-10-01", "2025-10-01 10:11:12", "2025/10/1", "10/1/2025",
        "Unknown", "1404/13/01", "", None, "1404", "2025-10-01T10:11:12",
    ]
    first = day("2025-10-01")
    assert one(values, lambda f: dt.unify_date(F.col("x"))) == [first] * 7 + [None] * 5 + [first]


def test_parse_native(one):
    values = ["۱۴۰۴/۰۷/۰۹", "1404/7/9", "  1404/07/09 10:00", "1404-07-09", "09/07/1404", "Unknown", "", None, "1404/12/30"]
    first = day("2025-10-01")
    assert one(values, lambda f: dt.parse_native_date(F.col("x"))) == [first] * 3 + [None] * 6


def test_parse_date_by_flag(one):
    values = [("1404/07/09", True), ("2025-10-01", False), ("2025-10-01", True)]
    out = one(values, lambda f: dt.parse_date(F.col("x"), F.col("n")), "x string, n boolean")
    # A native Gregorian-looking text is read as year 2025 of the Solar Hijri calendar only with slashes.
    assert out == [day("2025-10-01"), day("2025-10-01"), None]


def test_months(one):
    assert one(["2025-10-31"], lambda f: dt.month_key(F.col("x"))) == ["2025-10"]
    assert one(["2024-02-03"], lambda f: dt.month_end(F.col("x").cast("date"))) == [day("2024-02-29")]


def test_versions(one):
    values = ["1.5.7", "1.10", "Unknown", "null", "101.0", "v1.2", " 30.0 (beta)", None, "7", "1.05", "2.1000"]
    assert one(values, lambda f: vr.version_major_minor(F.col("x"))) == [
        1.5, 1.1, None, None, 101.0, None, 30.0, None, None, 1.05, 2.1,
    ]
    assert one(values, lambda f: vr.version_bounded(F.col("x"))) == [
        1.5, 1.1, None, None, None, None, 30.0, None, None, 1.5, None,
    ]


def test_version_parts_order(spark):
    df = spark.createDataFrame([("1.10",), ("1.9",)], "x string")
    assert [r.x for r in df.orderBy(vr.version_parts(F.col("x"))).collect()] == ["1.9", "1.10"]


def test_month_names(one):
    texts = ["Apr 5, 2026", "5 April 2026", "December 31st, 2025", "2 sept 2025", "nothing 2025", "31 Feb 2025", "Mon, 6 Oct 2025 10:11:12"]
    got = [None if x is None else x.isoformat() for x in one(texts, lambda d: dt.unify_date(F.col("x")))]
    assert got == ["2026-04-05", "2026-04-05", "2025-12-31", "2025-09-02", None, None, "2025-10-06"]
