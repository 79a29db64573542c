"""Pieces of the SQL twins, written from the rules and not from the Spark code."""

from __future__ import annotations

from revlens.plans.fixtures import REVIEWS_SQL

W = r"\p{L}\p{N}_"
S = r"\s\p{Z}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def reviews(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([REVIEWS_SQL, *ctes]) + "\n" + select


def whole_word(column: str, word: str) -> str:
    return f"regexp_matches({column}, '(^|[^{W}]){word}($|[^{W}])')"


def hit(column: str, word: str) -> str:
    """Whole word, or substring for words of more than three characters."""
    test = whole_word(column, word)
    return f"({test} OR contains({column}, {quoted(word)}))" if len(word) > 3 else test


def any_of(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def count_of(tests) -> str:
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"


def first_case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {quoted(label)}" for label, test in pairs) + f" ELSE {default} END"


def clean_symbols(column: str) -> str:
    body = rf"regexp_replace(lower(coalesce({column}, '')), '[^{W}{S}\x{{0622}}-\x{{06CC}}]', ' ', 'g')"
    return rf"trim(regexp_replace({body}, '[{S}]+', ' ', 'g'))"


def words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '[{S}]+'), lambda t: t <> '')"
