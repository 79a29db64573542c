"""Release numbers from free-text versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import fa_digits_to_latin, squeeze


def _leading(version: Column) -> Column:
    return F.regexp_extract(squeeze(fa_digits_to_latin(version)), r"^(\d+\.\d+)", 1)


def _mentions(version: Column, *words: str) -> Column:
    return F.rlike(F.lower(version), F.lit("|".join(words)))


def version_major_minor(version: Column) -> Column:
    """Leading ``major.minor`` as a number; null for unknown versions. ``1.10`` equals ``1.1``."""
    return F.when(~_mentions(version, "unknown", "null"), F.nullif(_leading(version), F.lit("")).try_cast("double"))


def version_parts(version: Column) -> Column:
    """Leading major and minor as integers, for ordering ``1.10`` above ``1.9``."""
    parts = F.split(_leading(version), r"\.")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("major"), F.get(parts, F.lit(1)).try_cast("int").alias("minor")
    )


def version_bounded(version: Column, max_major: int = 100, max_minor: int = 999) -> Column:
    """As ``version_major_minor`` from whole-number parts; null when a part is beyond its bound."""
    parts = F.split(_leading(version), r"\.")
    major, minor = (F.get(parts, F.lit(i)).try_cast("bigint") for i in range(2))
    good = ~_mentions(version, "unknown") & (major <= max_major) & (minor <= max_minor)
    return F.when(good, F.concat_ws(".", major.cast("string"), minor.cast("string")).cast("double"))
