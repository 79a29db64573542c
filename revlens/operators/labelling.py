"""Labelling stages over a reviews table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import labels as lb
from revlens.functions import text as tx
from revlens.operators.staging import evaluate_once


def with_final_clean(df: DataFrame, content: str = "content", out: str = "final_clean_content") -> DataFrame:
    return evaluate_once(df, **{out: tx.clean_symbols_final(F.col(content))})


def with_padded_words(df: DataFrame, text: str = "final_clean_content", out: str = "_words") -> DataFrame:
    """The word column of a cleaned text, to be shared by the labelling steps that follow."""
    return evaluate_once(df, **{out: tx.padded_clean_words(F.col(text))})


def _with_words(df: DataFrame, text: str, words: str | None) -> tuple[DataFrame, str, str, list[str]]:
    """Lower-case text and its padded words, computed here unless the caller has them already."""
    if words:
        return df, text, words, []
    low = evaluate_once(df, _low=F.lower(F.coalesce(F.col(text), F.lit(""))))
    return evaluate_once(low, _padded=tx.padded_words(F.col("_low"))), "_low", "_padded", ["_low", "_padded"]


def aspect_first_match(df: DataFrame, text: str = "cleaned_content", rules=None, out: str = "Final_Aspect") -> DataFrame:
    low = evaluate_once(df, _low=F.lower(F.col(text)))
    return evaluate_once(low, **{out: lb.aspect_first_match(F.col("_low"), rules)}).drop("_low")


def aspect_lexicon(
    df: DataFrame, text: str = "final_clean_content", lexicon=None, out: str = "Final_Aspect", words: str | None = None
) -> DataFrame:
    rows, low, padded, extra = _with_words(df, text, words)
    return evaluate_once(rows, **{out: lb.aspect_lexicon(F.col(low), F.col(padded), lexicon)}).drop(*extra)


def drop_noise(df: DataFrame, label: str = "Final_Aspect") -> DataFrame:
    return df.filter(F.col(label) != lx.NOISE)


def sentiment_lexicon(
    df: DataFrame, text: str = "cleaned_content", positive=None, negative=None, out: str = "Sentiment_Polarity"
) -> DataFrame:
    """Sign of whole-word hit counts; only texts without any whole-word hit are tested by substring."""
    positive, negative = positive or lx.POSITIVE_WORDS, negative or lx.NEGATIVE_WORDS
    rows, low, padded, extra = _with_words(df, text, None)
    counted = evaluate_once(
        rows, _pos=lb.whole_word_count(F.col(padded), positive), _neg=lb.whole_word_count(F.col(padded), negative)
    )
    sub = lb.sign_of_difference(tx.count_contained(F.col(low), positive), tx.count_contained(F.col(low), negative))
    none = (F.col("_pos") == 0) & (F.col("_neg") == 0)
    polarity = F.when(none, sub).otherwise(lb.sign_of_difference(F.col("_pos"), F.col("_neg")))
    return evaluate_once(counted, **{out: polarity}).drop(*extra, "_pos", "_neg")


def sentiment_with_score(
    df: DataFrame, text: str = "final_clean_content", score: str = "score", positive=None, negative=None,
    out: str = "Sentiment_Polarity", words: str | None = None,
) -> DataFrame:
    rows, low, padded, extra = _with_words(df, text, words)
    value = lb.polarity_with_score(F.col(low), F.col(padded), F.col(score), positive, negative)
    return evaluate_once(rows, **{out: value}).drop(*extra)


def fill_sentiment(
    df: DataFrame, text: str = "final_clean_content", score: str = "score", polarity: str = "Sentiment_Polarity",
    positive=None, negative=None,
) -> DataFrame:
    """Missing polarity counts as 0, and only rows at 0 get a new value."""
    current = F.coalesce(F.col(polarity).cast("int"), F.lit(0)) if polarity in df.columns else F.lit(0)
    now = df.withColumn("_now", current)
    # Rows that keep their value skip the text work.
    needed = evaluate_once(now, _low=F.when(F.col("_now") == 0, F.lower(F.coalesce(F.col(text), F.lit("")))))
    rows = evaluate_once(needed, _padded=tx.padded_words(F.col("_low")))
    value = lb.polarity_with_score(F.col("_low"), F.col("_padded"), F.col(score), positive, negative)
    filled = F.when(F.col("_now") == 0, value).otherwise(F.col("_now"))
    return evaluate_once(rows, **{polarity: filled}).drop("_low", "_padded", "_now")


def composite_trust(
    df: DataFrame, score: str = "score", polarity: str = "Sentiment_Polarity", out: str = "Composite_Trust"
) -> DataFrame:
    return df.withColumn(out, lb.composite_trust(F.col(score), F.col(polarity)))


def drop_contradictory(df: DataFrame, trust: str = "Composite_Trust") -> DataFrame:
    return df.filter(F.col(trust) != -1)


def contradiction_report(df: DataFrame, trust: str = "Composite_Trust") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(trust) == -1).alias("removed"),
        F.count_if(F.col(trust) != -1).alias("kept"),
    )


def seed_anchor(
    df: DataFrame, topics: list[list[str]] | None = None, text: str = "cleaned_content", out: str = "anchor"
) -> DataFrame:
    """Number of the topic with most distinct seed words in the text, -1 without one; by default ``lexicons.SEED_TOPICS``."""
    topics = list(lx.SEED_TOPICS.values()) if topics is None else topics
    words = evaluate_once(df, _words=tx.split_words(F.coalesce(F.col(text), F.lit(""))))
    return evaluate_once(words, **{out: lb.seed_anchor(F.col("_words"), topics)}).drop("_words")
