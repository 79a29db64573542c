"""Descriptive reports: one grouped aggregate each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import labels as lb
from revlens.functions import text as tx
from revlens.operators.staging import evaluate_once


def app_basic_stats(df: DataFrame, platform: str = "platform_type", app: str = "app_label") -> DataFrame:
    return (
        df.dropna(subset=[platform, app]).groupBy(platform, app)
        .agg(F.count("content").alias("total_comments"), F.round(F.avg("score"), 2).alias("avg_score"))
    )


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percentage per column from one pass."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot("_rows", columns, "column_name", "null_count")
    return long.select(
        "column_name", "null_count", F.round(F.col("null_count") / F.col("_rows") * 100, 2).alias("null_percentage")
    )


def reply_rate(df: DataFrame, platform: str = "platform_type") -> DataFrame:
    counts = df.dropna(subset=[platform]).groupBy(platform).agg(
        F.count("content").alias("total_reviews"), F.count("developer_reply").alias("replied_reviews")
    )
    rate = F.round(F.col("replied_reviews") / F.nullif("total_reviews", F.lit(0)) * 100, 2)
    return counts.withColumn("reply_rate_percentage", rate)


def volume_by_platform(df: DataFrame, platform: str = "platform_type") -> DataFrame:
    return df.groupBy(platform).agg(F.count("*").alias("reviews"))


def avg_score_ranked(df: DataFrame, app: str = "app_label", score: str = "score") -> DataFrame:
    means = df.dropna(subset=[app]).groupBy(app).agg(F.avg(score).alias("mean_score"))
    return sort_single(means, "mean_score", app)


def _describe(df: DataFrame, keys: list[str], text: str, total: Column, date: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        total.alias("Total_Reviews"),
        F.round(F.avg(tx.word_count(F.col(text))), 1).alias("Avg_Words_per_Comment"),
        F.round(F.avg("score"), 2).alias("Mean_Score"),
        F.round(F.stddev_samp("score"), 2).alias("Score_Std_Dev"),
        F.coalesce(F.date_format(F.min(date), "yyyy-MM-dd"), F.lit("N/A")).alias("Start_Date"),
        F.coalesce(F.date_format(F.max(date), "yyyy-MM-dd"), F.lit("N/A")).alias("End_Date"),
    )


def macro_stats(
    df: DataFrame, keys: list[str] | None = None, text: str = "content", date: str = "parsed_date",
    ecosystem: str = "Ecosystem",
) -> DataFrame:
    """Rows, words, stars and period per source; strongest mean first within each ecosystem."""
    keys = keys or [ecosystem, "app_label", "lang"]
    stats = _describe(df, keys, text, F.count("*"), F.col(date))
    return sort_multi(stats, [(ecosystem, True), ("Mean_Score", False), *[(k, True) for k in keys if k != ecosystem]])


def table_stats(
    df: DataFrame, ecosystem: str = "Ecosystem", app: str = "app_label", text: str = "final_clean_content",
    date: str = "date",
) -> DataFrame:
    stats = _describe(df.dropna(subset=[ecosystem, app]), [ecosystem, app], text, F.count("review_id"), F.col(date))
    return sort_multi(stats, [(ecosystem, True), ("Total_Reviews", False), (app, True)])


def hallucination_impact(
    df: DataFrame, keys: list[str] | None = None, lang: str = "lang", keywords=None, content: str = "content"
) -> DataFrame:
    """Share of reviews that report an error, and mean stars with and without such a report."""
    flagged = df.withColumn("_flag", tx.flag_keywords(F.col(content), F.col(lang), keywords))
    flag = F.col("_flag")
    rate = F.count_if(flag) / F.count("*") * 100
    return flagged.groupBy(*(keys or ["app_label", lang])).agg(
        F.round(rate, 2).alias("hallucination_rate"),
        F.round(F.coalesce(F.avg(F.when(~flag, F.col("score"))), F.lit(0.0)), 2).alias("avg_score_normal"),
        F.round(F.coalesce(F.avg(F.when(flag, F.col("score"))), F.lit(0.0)), 2).alias("avg_score_hallucinated"),
    )


def score_dist_by_flag(df: DataFrame, flag: Column, score: str = "score") -> DataFrame:
    return df.groupBy(score, flag.alias("flag")).agg(F.count("*").alias("reviews"))


def mention_pct(
    df: DataFrame, lang: str = "lang", categories=None, english: str = "en_us", content: str = "content"
) -> DataFrame:
    """Percentage of non-neutral reviews per trust level that mention each category, in long form."""
    categories = categories or lx.EXPERT_CATEGORIES
    names = list(categories)
    level = lb.trust_level_exact(F.col("score"))
    rows = df.withColumn("Trust_Level", level).filter(F.col("Trust_Level") != lx.LEVEL_NEUTRAL)
    flagged = evaluate_once(rows, _flags=tx.category_flags(F.col(content), F.col(lang), categories, english))
    wide = flagged.groupBy("Trust_Level").agg(
        *[(F.avg(F.col("_flags")[n].cast("int")) * 100).alias(n) for n in names]
    )
    long = wide.unpivot("Trust_Level", names, "Category", "Mention_Percentage")
    return long.withColumn("Category", F.translate("Category", "_", " "))


def aspect_freq_pct(df: DataFrame, app: str, app_col: str = "app_label", aspect: str = "Final_Aspect") -> DataFrame:
    """One app's non-neutral reviews by aspect and trust level, with the percentage of all of them."""
    rows = df.filter(F.col(app_col) == app).withColumn("Trust_Level", lb.trust_level(F.col("score")))
    counts = (
        rows.filter(F.col("Trust_Level") != lx.LEVEL_NEUTRAL)
        .groupBy(tx.recode_label(F.col(aspect)).alias("English_Aspect"), "Trust_Level")
        .agg(F.count("*").alias("Count"))
    )
    # The window runs over the counts, one row per aspect and level.
    return counts.withColumn("Percentage", F.col("Count") / F.sum("Count").over(Window.partitionBy()) * 100)


def ecosystem_totals(df: DataFrame, ecosystem: str = "ecosystem") -> DataFrame:
    totals = df.rollup(ecosystem).agg(F.count("*").alias("reviews"), F.grouping(ecosystem).alias("_all"))
    return totals.select(F.when(F.col("_all") == 1, "Total").otherwise(F.col(ecosystem)).alias(ecosystem), "reviews")


def attrition(df: DataFrame, removed: Column) -> DataFrame:
    """Rows before, removed and kept, with the removed percentage."""
    out = F.count_if(removed)
    return df.agg(
        F.count("*").alias("before_filter"),
        out.alias("removed"),
        F.round(out / F.count("*") * 100, 1).alias("removed_pct"),
        (F.count("*") - out).alias("kept"),
    )


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows that pass each step and all steps before it, from one pass."""
    passed, aggs = F.lit(True), []
    for name, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return df.agg(F.count("*").alias("all_rows"), *aggs)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
    return sort_single(counts, "n", column)


def confusion_matrix(df: DataFrame, label: str, prediction: str, order: list[str]) -> DataFrame:
    """Counts and row percentages in a fixed label order; pairs that never occur are present with 0."""
    cells = [
        F.struct(
            F.lit(t).alias("label"),
            F.lit(p).alias("prediction"),
            F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias("n"),
            F.nullif(F.count_if((F.col(label) == t) & F.col(prediction).isin(order)), F.lit(0)).alias("in_row"),
        )
        for t in order
        for p in order
    ]
    long = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return long.select("label", "prediction", "n", (F.col("n") / F.coalesce("in_row", F.lit(1)) * 100).alias("row_pct"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def cronbach_alpha(df: DataFrame, blocks: dict[str, list[str]], good: float = 0.7) -> DataFrame:
    """Reliability per block of items from complete answers, all blocks in one pass."""
    results = []
    for name, items in blocks.items():
        complete = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in items])
        total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in items])
        item_vars = reduce(lambda a, b: a + b, [F.var_samp(F.when(complete, F.col(f"`{c}`"))) for c in items])
        k = len(items)
        factor = F.lit(k / (k - 1) if k > 1 else None).cast("double")  # one item has no reliability
        alpha = factor * (1 - item_vars / F.nullif(F.var_samp(F.when(complete, total)), F.lit(0.0)))
        results.append(
            F.struct(
                F.lit(name).alias("block"), F.lit(k).cast("bigint").alias("items"),
                F.count_if(complete).alias("answers"), F.round(alpha, 3).alias("alpha"),
            )
        )
    rows = df.agg(F.array(*results).alias("blocks")).select(F.inline("blocks"))
    status = F.when(F.col("alpha").isNull(), "no data").when(F.col("alpha") >= good, "good").otherwise("check")
    return rows.withColumn("status", status)


def sort_multi(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs; end with a key column to fix the order of ties."""
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys])


def sort_single(df: DataFrame, column: str, tie: str, ascending: bool = False) -> DataFrame:
    return sort_multi(df, [(column, ascending), (tie, True)])


def head(df: DataFrame, order: list[tuple[str, bool]], n: int = 10) -> DataFrame:
    return sort_multi(df, order).limit(n)


def nlargest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` commonest values."""
    return value_counts(df, column).limit(n)
