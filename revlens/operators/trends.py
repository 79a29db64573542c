"""Monthly and per-release trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import dates as dt
from revlens.operators.ranking import top_n_per_key
from revlens.session import materialised


def monthly_trust(df: DataFrame, date: str = "Unified_Date", trust: str = "Composite_Trust") -> DataFrame:
    """Mean trust in percent per month end; months without reviews are absent."""
    rows = df.dropna(subset=[date, trust])
    return rows.groupBy(dt.month_end(F.col(date)).alias("Month")).agg((F.avg(trust) * 100).alias("Trust_Level_Pct"))


def union_ecosystems(series: dict[str, DataFrame], tag: str = "Ecosystem") -> DataFrame:
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in series.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def monthly_trust_by(
    df: DataFrame, keys: list[str], date: str = "Unified_Date", trust: str = "Composite_Trust"
) -> DataFrame:
    """Several series in one scan and one shuffle: the grouped form of ``monthly_trust``."""
    rows = df.dropna(subset=[date, trust, *keys])
    return rows.groupBy(*keys, dt.month_end(F.col(date)).alias("Month")).agg(
        (F.avg(trust) * 100).alias("Trust_Level_Pct")
    )


def monthly_trust_by_aspect(df: DataFrame, aspect: str = "Aspect_EN", **kw) -> DataFrame:
    return monthly_trust_by(df, [aspect], **kw)


def rolling_mean_2(df: DataFrame, keys: list[str], month: str = "Month", value: str = "Trust_Level_Pct") -> DataFrame:
    """Mean of this and the previous observed month of the series."""
    window = Window.partitionBy(*keys).orderBy(month).rowsBetween(-1, 0)
    return df.withColumn("Smoothed", F.avg(value).over(window))


def _version_stats(df: DataFrame, version: str, keys: list[str], trust: str) -> DataFrame:
    return df.dropna(subset=[version, trust, *keys]).groupBy(*keys, version).agg(
        (F.avg(trust) * 100).alias("Trust_Level_Pct"), F.count("*").alias("reviews")
    )


def trust_by_version(
    df: DataFrame, version: str = "Major_Minor_Version", keys: list[str] | None = None, trust: str = "Composite_Trust"
) -> DataFrame:
    return _version_stats(df, version, keys or [], trust).orderBy(*(keys or []), version)


def top_versions(by_version: DataFrame, n: int = lx.TOP_VERSIONS, version: str = "Major_Minor_Version") -> DataFrame:
    """The ``n`` versions with most reviews in version order; fewer versions all stay."""
    return by_version.orderBy(F.col("reviews").desc(), F.col(version)).limit(n).orderBy(version)


def low_trust_events(by_version: DataFrame, limit: float = lx.LOW_TRUST_LIMIT) -> DataFrame:
    return by_version.filter(F.col("Trust_Level_Pct") < limit)


def min_support(df: DataFrame, keys: list[str], n: int = lx.MIN_SUPPORT) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    supported = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n)
    return df.join(supported.drop("_n"), keys, "left_semi")


def top_apps(df: DataFrame, n: int = lx.TOP_APPS, app: str = "app_label") -> DataFrame:
    """Rows of the ``n`` apps with most rows."""
    best = (
        df.dropna(subset=[app]).groupBy(app).agg(F.count("*").alias("_n"))
        .orderBy(F.col("_n").desc(), F.col(app)).limit(n).drop("_n")
    )
    return df.join(F.broadcast(best), app, "left_semi")


def last_n_per_group(df: DataFrame, key: str, order: str, n: int = lx.LAST_VERSIONS) -> DataFrame:
    return top_n_per_key(df, [key], [F.col(order).desc()], n)


def stage_dense_rank(df: DataFrame, key: str = "app_label", version: str = "Clean_Version") -> DataFrame:
    """Number the versions of each app in order. Distinct versions are ranked, so an app's rows never share a task."""
    stage = F.row_number().over(Window.partitionBy("_k").orderBy("_v")).cast("bigint")
    stages = df.select(F.col(key).alias("_k"), F.col(version).alias("_v")).distinct().withColumn("Stage_Num", stage)
    joined = df.join(stages, F.col(key).eqNullSafe(F.col("_k")) & F.col(version).eqNullSafe(F.col("_v")))
    return joined.drop("_k", "_v").withColumn("Display_Version", F.concat(F.lit("Stage "), F.col("Stage_Num")))


def release_stages(
    df: DataFrame, app: str = "app_label", version: str = "Clean_Version", support: int = lx.MIN_SUPPORT,
    apps: int = lx.TOP_APPS, last: int = lx.LAST_VERSIONS,
) -> DataFrame:
    """Trust per app and release stage.

    Support, app choice and version choice all need group sizes only, so the reviews are read and shuffled once;
    the rest works on the stored table of one row per app and version.
    """
    by_version = _version_stats(df, version, [app], "Composite_Trust").filter(F.col("reviews") >= support)
    by_version = materialised(by_version, "release-stages")
    best = by_version.groupBy(app).agg(F.sum("reviews").alias("_n")).orderBy(F.col("_n").desc(), F.col(app)).limit(apps)
    chosen = by_version.join(F.broadcast(best.select(app)), app, "left_semi")
    return stage_dense_rank(last_n_per_group(chosen, app, version, last), app, version)
