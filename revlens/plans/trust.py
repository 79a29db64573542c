"""The labelling job from raw text to the trust target, and the flagship trend on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import lexicons as lx
from revlens.functions import dates as dt
from revlens.functions import text as tx
from revlens.operators import labelling as lab
from revlens.operators import trends as tr


def label_reviews(
    df: DataFrame, lexicon=None, positive=None, negative=None, aspects: bool = True, trust: bool = True
) -> DataFrame:
    """Clean text and, as asked for, aspect, and polarity with trust, for every review; nothing is filtered yet."""
    out = lab.with_padded_words(lab.with_final_clean(df))
    if aspects:
        out = lab.aspect_lexicon(out, lexicon=lexicon, words="_words")
    if trust:
        out = lab.composite_trust(lab.sentiment_with_score(out, positive=positive, negative=negative, words="_words"))
    return out.drop("_words")


def trusted_reviews(df: DataFrame, **lists) -> DataFrame:
    """Labelled reviews without noise and contradictions."""
    return lab.drop_contradictory(lab.drop_noise(label_reviews(df, **lists)))


def aspect_trend(
    df: DataFrame, date: str = "date", period: tuple[str, str] | None = (lx.TREND_START, lx.TREND_END), **lists
) -> DataFrame:
    """How trust per aspect moves by month within the report period, smoothed over two observed months."""
    parsed = isinstance(df.schema[date].dataType, T.DateType)
    unified = F.col(date) if parsed else dt.unify_date(F.col(date))
    dated = df.withColumn("Unified_Date", unified)
    if period:
        dated = dated.filter(dt.in_range(F.col("Unified_Date"), *period))
    rows = trusted_reviews(dated, **lists)
    rows = rows.withColumn("Aspect_EN", tx.recode_label(F.col("Final_Aspect")))
    return tr.rolling_mean_2(tr.monthly_trust_by(rows, ["Aspect_EN"]), ["Aspect_EN"])
