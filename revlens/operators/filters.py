"""Row filters and small projections over a reviews table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import dates as dt
from revlens.functions import text as tx
from revlens.operators.staging import evaluate_once


def non_empty_comment(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(~tx.is_blank(F.col(content))).withColumn(content, F.trim(F.col(content)))


def non_blank(df: DataFrame, text: str = "cleaned_content", score: str = "score") -> DataFrame:
    """Rows with visible text and a score, the score as an integer."""
    return df.filter(~tx.is_blank(F.col(text)) & F.col(score).isNotNull()).withColumn(score, F.col(score).cast("int"))


def deep_filter(df: DataFrame, content: str = "content", filler: list[str] | None = None) -> DataFrame:
    return df.filter(~tx.is_generic_or_short(F.col(content), filler))


def sentences(df: DataFrame, text: str, min_tokens: int = 3, out: str = "tokens") -> DataFrame:
    """Token arrays of texts with at least ``min_tokens`` tokens."""
    return evaluate_once(df, **{out: tx.split_words(F.col(text))}).filter(F.size(out) >= min_tokens)


def date_range(df: DataFrame, date: str, lo: str = lx.TREND_START, hi: str = lx.TREND_END) -> DataFrame:
    return df.filter(dt.in_range(F.col(date), lo, hi))


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def isin_top_aspects(
    df: DataFrame, aspect: str = "Aspect_EN", ecosystem: str = "ecosystem", top: dict[str, list[str]] | None = None
) -> DataFrame:
    keep = F.lit(False)
    for name, aspects in (top or lx.TOP_ASPECTS).items():
        keep = keep | ((F.col(ecosystem) == name) & F.col(aspect).isin(aspects))
    return df.filter(keep)


def unmapped_labels(df: DataFrame, recoded: str = "Aspect_EN", label: str = "Final_Aspect") -> DataFrame:
    return df.filter(tx.in_persian_script(F.col(recoded))).select(label).distinct()


def load_docs(df: DataFrame, split: str = "train", text: str = "cleaned_content", part: str = "part") -> DataFrame:
    return df.filter(F.col(part) == split).select(text).dropna()
