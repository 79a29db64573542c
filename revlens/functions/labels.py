"""Aspect, sentiment and trust labels as column expressions over already computed text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import text as tx


def aspect_first_match(low_text: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """First rule with a substring hit in lower-case text, else noise."""
    chain = F.when(tx.is_blank(low_text), lx.NOISE)
    for label, words in (rules or lx.FIRST_MATCH_RULES).items():
        chain = chain.when(tx.contains_any(low_text, words), label)
    return chain.otherwise(lx.NOISE)


def aspect_lexicon(clean_text: Column, padded: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """First aspect, in lexicon order, with a whole-word hit or a substring hit of a longer word."""
    chain = None
    for label, words in (lexicon or lx.ASPECT_LEXICON).items():
        test = tx.hit_any(clean_text, padded, words)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(lx.NOISE)


def sign_of_difference(positive: Column, negative: Column) -> Column:
    return F.signum(positive - negative).cast("int")


def whole_word_count(padded: Column, words: list[str]) -> Column:
    """Number of distinct list words in the text as whole words."""
    return tx.count_contained(padded, tx.in_spaces(words))


def polarity_with_score(clean_text: Column, padded: Column, score: Column, positive=None, negative=None) -> Column:
    """Sign of hit counts; a tie is decided by the stars."""
    pos = tx.hit_count(clean_text, padded, positive or lx.POSITIVE_WORDS_RICH)
    neg = tx.hit_count(clean_text, padded, negative or lx.NEGATIVE_WORDS_RICH)
    by_score = F.when(number(score) >= 4, 1).otherwise(-1)
    return tx.let(pos - neg, lambda diff: F.when(diff > 0, 1).when(diff < 0, -1).otherwise(by_score))


def number(score: Column) -> Column:
    """Score as a number in which NaN is null: NaN compares above every number in Spark."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def composite_trust(score: Column, polarity: Column) -> Column:
    """1 for high stars with positive text, 0 for low stars with negative text, else -1."""
    s = number(score)
    return F.when((s >= 4) & (polarity == 1), 1).when((s <= 3) & (polarity == -1), 0).otherwise(-1)


def trust_level(score: Column) -> Column:
    s = number(score)
    return F.when(s >= 4, lx.LEVEL_HIGH).when(s <= 2, lx.LEVEL_LOW).otherwise(lx.LEVEL_NEUTRAL)


def trust_level_exact(score: Column) -> Column:
    """Stars 1, 2 and 4, 5 by membership; every other value is neutral."""
    s = number(score)
    return F.when(s.isin(1.0, 2.0), lx.LEVEL_LOW).when(s.isin(4.0, 5.0), lx.LEVEL_HIGH).otherwise(lx.LEVEL_NEUTRAL)


def seed_anchor(words: Column, topics: list[list[str]]) -> Column:
    """Index of the topic with most distinct seed words in the text, first on ties, -1 without a hit."""
    hits = F.array(*[F.size(F.array_intersect(words, tx.string_array(seeds))) for seeds in topics])
    best = F.array_max(hits)
    return F.when(best > 0, (F.array_position(hits, best) - 1).cast("int")).otherwise(-1)


def target_class(target: Column) -> Column:
    """0 and 1, in text or number form, to class names; other values pass as text."""
    n = target.try_cast("double")
    return F.when(n == 0, lx.CLASS_LOW).when(n == 1, lx.CLASS_HIGH).otherwise(target.cast("string"))
