"""Text cleaning, tokens and keyword tests as native column expressions.

Word characters are letters, numbers and the underscore of any script, stated as an explicit class: the
short classes of the JVM's regex engine only know ASCII.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import lexicons as lx

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}"
PERSIAN_RANGE = r"\x{0622}-\x{06CC}"

# What the cleaners keep and drop.
URL_PATTERN = rf"(?:http|www)[^{SPACE}]+"
NON_WORD_RUN = rf"[^{WORD}{PERSIAN_RANGE}]+"
NOT_TEXT_FA = rf"[^{WORD}{SPACE}.!?؟]"
NOT_TEXT_EN = rf"[^{WORD}{SPACE}.!?]"
PUNCTUATION_RUN = r"[.!?؟]+"
PERSIAN_MARK = rf"[{PERSIAN_RANGE}&&[^{WORD}]]"
PERSIAN_DIGITS, LATIN_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "0123456789"


def string_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also where several CASE branches or lambdas use it."""
    return F.transform(F.array(value), body)[0]


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def clean_symbols(text: Column) -> Column:
    """Lower case; each run of other characters than word characters becomes one space; null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD_RUN, " "))


clean_symbols_letters = clean_symbols
clean_symbols_final = clean_symbols


def split_words(text: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda t: t != "")


def split_word_runs(text: Column) -> Column:
    """Runs of word characters."""
    return F.split(text, rf"[^{WORD}]+")


def padded_words(text: Column) -> Column:
    """Word runs between single spaces, with a space at both ends: ``' w '`` is in it for a whole-word hit of w."""
    return F.concat(F.lit(" "), F.regexp_replace(text, rf"[^{WORD}]+", " "), F.lit(" "))


def padded_clean_words(clean_text: Column) -> Column:
    """``padded_words`` of text that ``clean_symbols`` made: only kept Persian marks are left to part words."""
    plain = F.when(F.rlike(clean_text, F.lit(PERSIAN_MARK)), F.regexp_replace(clean_text, PERSIAN_MARK, " "))
    return F.concat(F.lit(" "), plain.otherwise(clean_text), F.lit(" "))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def stopwords_keep_negation(stopwords: list[str], negations: list[str]) -> list[str]:
    keep = set(negations)
    return [w for w in stopwords if w not in keep]


def _lemmatised(tokens: Column, stopwords: list[str], lemmas: dict[str, str]) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(stopwords))
    if not lemmas:
        return kept
    return F.transform(kept, lambda t: F.substring_index(F.coalesce(lookup(lemmas, t), t), "#", 1))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key, null if there is none.

    Spark searches a map entry by entry, so the table is dealt by checksum to maps of a few entries each; its size then
    does not matter.
    """
    parts = max(1, len(table) // 4)
    dealt: list[dict[str, str]] = [{} for _ in range(parts)]
    for k, v in table.items():
        dealt[zlib.crc32(k.encode()) % parts][k] = v
    maps = [F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map().cast("map<string,string>")
            for d in dealt]
    return F.try_element_at(F.element_at(F.array(*maps), (F.crc32(key) % parts + 1).cast("int")), key)


def clean_fa(text: Column, stopwords: list[str] | None = None, lemmas: dict[str, str] | None = None) -> Column:
    """Persian cleaning: URLs, symbols, letter variants, function words, one-letter tokens, lemmas."""
    stopwords = stopwords_keep_negation(lx.STOPWORDS_FA, lx.NEGATIONS_FA) if stopwords is None else stopwords
    lemmas = lx.LEMMAS_FA if lemmas is None else lemmas
    body = F.regexp_replace(strip_urls(F.coalesce(text, F.lit(""))), NOT_TEXT_FA, "")
    body = F.translate(body, "يك", "یک")
    body = F.regexp_replace(body, rf"({PUNCTUATION_RUN})", " $1 ")
    tokens = F.filter(F.split(body, rf"[{SPACE}]+"), lambda t: F.length(t) > 1)
    return F.array_join(_lemmatised(tokens, stopwords, lemmas), " ")


def clean_en(text: Column, stopwords: list[str] | None = None, lemmas: dict[str, str] | None = None) -> Column:
    """English cleaning: URLs, symbols, lower case, function words, punctuation, lemmas."""
    stopwords = stopwords_keep_negation(lx.STOPWORDS_EN, lx.NEGATIONS_EN) if stopwords is None else stopwords
    lemmas = lx.LEMMAS_EN if lemmas is None else lemmas
    body = F.lower(F.regexp_replace(strip_urls(F.coalesce(text, F.lit(""))), NOT_TEXT_EN, ""))
    tokens = F.filter(F.split(body, rf"[{SPACE}.!?]+"), lambda t: t != "")
    return F.array_join(_lemmatised(tokens, stopwords, lemmas), " ")


def clean_by_lang(text: Column, lang: Column, english: str = "en_us") -> Column:
    return F.when(lang == english, clean_en(text)).otherwise(clean_fa(text))


def is_blank(text: Column) -> Column:
    return F.coalesce(~F.rlike(text, F.lit(rf"[^{SPACE}]")), F.lit(True))


def is_generic_or_short(text: Column, filler: list[str] | None = None) -> Column:
    """Null, at most two words, or nothing but filler words.

    One anchored pattern: on a longer text it fails at the first word that is no filler, after a few characters.
    """
    words = "|".join(rf"\Q{w}\E" for w in (filler or lx.GENERIC_WORDS))
    gap, word = rf"[{SPACE}]", rf"[^{SPACE}]+"
    short = rf"(?:{word}(?:{gap}+{word})?)?"
    only_filler = rf"(?:{words})(?:{gap}+(?:{words}))*"
    return F.coalesce(F.rlike(text, F.lit(rf"(?iu)^{gap}*(?:{short}|{only_filler}){gap}*\z")), F.lit(True))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word is a substring. Plain search is several times faster than a regex alternation."""
    return F.exists(string_array(words), lambda w: F.contains(text, w))


def count_contained(text: Column, words: list[str]) -> Column:
    """Number of distinct list words that are substrings."""
    return F.size(F.filter(string_array(dict.fromkeys(words)), lambda w: F.contains(text, w)))


def in_spaces(words: list[str]) -> list[str]:
    """Whole words as they stand in a padded text."""
    return [f" {w} " for w in words]


def _by_length(words: list[str], longer_than: int) -> tuple[list[str], list[str]]:
    return [w for w in words if len(w) > longer_than], [w for w in words if len(w) <= longer_than]


def hit_any(text: Column, padded: Column, words: list[str], longer_than: int = 3) -> Column:
    """Whole-word hit, or substring hit for words longer than ``longer_than`` characters.

    A whole-word hit is a substring hit as well, so long words need only the substring test.
    """
    long, short = _by_length(words, longer_than)
    tests = [contains_any(c, ws) for c, ws in ((text, long), (padded, in_spaces(short))) if ws]
    return reduce(lambda a, b: a | b, tests)


def hit_count(text: Column, padded: Column, words: list[str], longer_than: int = 3) -> Column:
    """Number of distinct list words hit by the rule of ``hit_any``."""
    long, short = _by_length(words, longer_than)
    counts = [count_contained(c, ws) for c, ws in ((text, long), (padded, in_spaces(short))) if ws]
    return reduce(lambda a, b: a + b, counts)


def flag_keywords(text: Column, lang: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """True when the text contains a keyword of its language; null text and unknown languages give False."""

    def flags(low: Column) -> Column:
        chain = F.lit(False)
        for key, words in (keywords or lx.HALLUCINATION_WORDS).items():
            chain = F.when(lang == key, F.coalesce(contains_any(low, words), F.lit(False))).otherwise(chain)
        return chain

    return let(F.lower(text), flags)


def category_flags(text: Column, lang: Column, categories=None, english: str = "en_us") -> Column:
    """A struct with one boolean per category; keywords are plain substrings, case-insensitive."""
    categories = categories or lx.EXPERT_CATEGORIES

    def flags(low: Column) -> Column:
        tests = [
            F.when(lang == english, contains_any(low, words["en"])).otherwise(contains_any(low, words["fa"]))
            for words in categories.values()
        ]
        return F.struct(*[t.alias(name) for t, name in zip(tests, categories)])

    return let(F.lower(F.coalesce(text, F.lit(""))), flags)


def fa_digits_to_latin(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS, LATIN_DIGITS)


def likert_recode(answer: Column, scale: dict[str, int | None] | None = None) -> Column:
    """Answer text to its number; other text is read as a number, unreadable text gives null."""
    scale = lx.LIKERT_SCALE if scale is None else scale
    known = F.create_map(*[F.lit(x) for k, v in scale.items() if v is not None for x in (k, float(v))])
    return F.when(
        answer.isin([k for k, v in scale.items() if v is None]), F.lit(None).cast("double")
    ).otherwise(F.coalesce(F.try_element_at(known, answer), answer.try_cast("double")))


def recode_label(label: Column, names: dict[str, str] | None = None, trim: bool = True) -> Column:
    names = lx.ASPECT_NAMES if names is None else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(label) if trim else label), label)


def recode_by_substring(label: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """First rule with a substring hit wins; the zero-width non-joiner counts as a space."""

    def first_rule(text: Column) -> Column:
        chain = None
        for name, words in (rules or lx.SUBSTRING_RULES_SHORT).items():
            test = contains_any(text, words)
            chain = F.when(test, name) if chain is None else chain.when(test, name)
        return chain.otherwise(text)

    return let(F.translate(label, "‌", " "), first_rule)


def in_persian_script(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"[{PERSIAN_RANGE}]"))
