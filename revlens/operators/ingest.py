"""Batch ingest rules: month spine, quotas, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import month_key
from revlens.operators.ranking import first_per_key, top_n_per_key

GROUP = ["app_label", "lang"]

# A quota: one number for all groups, or a table of the group columns and ``target``. Groups it does not list admit nothing.
Target = int | DataFrame


def month_spine(anchor: DataFrame, start: str = "start", months: int = 6) -> DataFrame:
    """The last ``months`` month keys up to each distinct start date, newest first by ``position``."""
    first = F.trunc(F.col(start).cast("date"), "month")
    steps = F.sequence(first, F.add_months(first, 1 - months), F.expr("interval -1 month"))
    return (
        anchor.select(start).distinct()
        .select(F.posexplode(steps).alias("position", "_month"))
        .select(F.col("position").cast("bigint").alias("position"), month_key(F.col("_month")).alias("month"))
    )


def spine_keys(start: str, months: int = 6) -> list[str]:
    """The same keys for a fixed start month ``yyyy-MM``, as plain values for filters and partition pruning."""
    year, month = (int(x) for x in start.split("-")[:2])
    keys = []
    for back in range(months):
        total = year * 12 + month - 1 - back
        keys.append(f"{total // 12}-{total % 12 + 1:02d}")
    return keys


def cut_older_than(df: DataFrame, oldest: str, date: str = "date") -> DataFrame:
    return df.filter(month_key(F.col(date)) >= oldest)


def _in_spine(df: DataFrame, spine: list[str], date: str) -> DataFrame:
    return df.withColumn("month", month_key(F.col(date))).filter(F.col("month").isin(spine))


def newest_first(ts: str = "full_date", key: str = "review_id") -> list[Column]:
    return [F.col(ts).desc(), F.col(key)]


def with_target(df: DataFrame, target: Target, group: list[str], out: str = "_target") -> DataFrame:
    """Each row's quota; the table of targets has a row per group."""
    if isinstance(target, int):
        return df.withColumn(out, F.lit(target))
    listed = target.select(*group, F.col("target").alias(out))
    return df.join(listed, group, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def _largest(target: Target) -> int:
    return target if isinstance(target, int) else target.agg(F.max("target")).first()[0] or 0


def quota_admit(
    df: DataFrame, spine: list[str], target: Target, group: list[str] | None = None, date: str = "date",
    order: list[Column] | None = None, salts: tuple[int, ...] = (),
) -> DataFrame:
    """Per group and month keep the first ``target`` reviews, newest first.

    Rows are first cut to the largest target, then to their own group's.
    """
    group, rows = group or GROUP, _in_spine(df, spine, date)
    ranked = top_n_per_key(rows, [*group, "month"], order or newest_first(), _largest(target), salts, "_rank")
    return with_target(ranked, target, group).filter(F.col("_rank") <= F.col("_target")).drop("_rank", "_target")


def month_counts(df: DataFrame, spine: list[str], group: list[str] | None = None, date: str = "date") -> DataFrame:
    return _in_spine(df, spine, date).groupBy(*(group or GROUP), "month").agg(F.count("*").alias("stored"))


def quota_resume(
    existing: DataFrame, new: DataFrame, spine: list[str], target: Target, group: list[str] | None = None,
    date: str = "date", order: list[Column] | None = None, salts: tuple[int, ...] = (),
) -> DataFrame:
    """Admit new reviews after counting what each group and month already holds."""
    keys = [*(group or GROUP), "month"]
    rows = top_n_per_key(_in_spine(new, spine, date), keys, order or newest_first(), _largest(target), salts, "_rank")
    rows = with_target(rows, target, group or GROUP)
    counted = rows.join(month_counts(existing, spine, group, date), keys, "left")
    admitted = counted.filter(F.col("_rank") + F.coalesce("stored", F.lit(0)) <= F.col("_target"))
    return admitted.drop("_rank", "stored", "_target")


def quota_full(
    df: DataFrame, spine: list[str], target: Target, group: list[str] | None = None, date: str = "date"
) -> DataFrame:
    """Per group, whether every month of the spine has reached the target."""
    group = group or GROUP
    counts = df.groupBy(*group, month_key(F.col(date)).alias("month")).agg(F.count("*").alias("stored"))
    counts = with_target(counts, target, group)
    listed = F.col("month").isin(spine)
    full = F.count_if(listed & (F.col("stored") >= F.col("_target"))) == len(spine)
    return counts.groupBy(*group).agg(full.alias("is_full"), F.count_if(listed).alias("months_seen"))


def quota_overflow(
    df: DataFrame, spine: list[str], target: Target, group: list[str] | None = None, date: str = "date"
) -> DataFrame:
    """Reviews beyond the quota per group and month; counts suffice, no ranking is needed."""
    counts = with_target(month_counts(df, spine, group, date), target, group or GROUP)
    over = F.col("stored") - F.col("_target")
    return counts.select(*(group or GROUP), "month", over.alias("skipped")).filter(F.col("skipped") > 0)


def append_dedup(
    old: DataFrame, new: DataFrame, key: str = "review_id", order: list[Column] | None = None
) -> DataFrame:
    """Union that keeps one row per key; a stored row wins over a new one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], [F.col("_batch"), *(order or newest_first())]).drop("_batch")


def dedup_user_text(df: DataFrame, order: list[Column], user: str = "user_name", content: str = "content") -> DataFrame:
    """First row per user and text; the SHA-256 digest of the whole text stands for it, to keep the keys short."""
    keyed = df.withColumn("_digest", F.sha2(F.col(content), 256))
    return first_per_key(keyed, [user, "_digest"], order).drop("_digest")


def limit_per_app(df: DataFrame, n: int, order: list[Column], app: str = "app_label") -> DataFrame:
    return top_n_per_key(df, [app], order, n)
