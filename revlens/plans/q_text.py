"""Queries: text cleaning, filters and recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import text as tx
from revlens.operators import filters as fl
from revlens.operators.staging import evaluate_once
from revlens.plans import demo
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import PARTS, documents, reviews, table

S, W = sq.S, sq.W
LABELS = list(lx.ASPECT_NAMES) + ["شایستگی فنی و عملیاتی (اکتشافی)"]


@query("strip_urls", rf"SELECT page_id, regexp_replace(html, '(http|www)[^{S}]+', '', 'g') AS stripped FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_urls(F.col("html")).alias("stripped"))


def _clean_en_sql(column: str) -> str:
    keep = [w for w in lx.STOPWORDS_EN if w not in lx.NEGATIONS_EN]
    lemmas = "MAP {" + ", ".join(f"{sq.quoted(k)}: {sq.quoted(v)}" for k, v in lx.LEMMAS_EN.items()) + "}"
    body = rf"regexp_replace(regexp_replace({column}, '(http|www)[^{S}]+', '', 'g'), '[^{W}{S}.!?]', '', 'g')"
    tokens = rf"regexp_split_to_array(regexp_replace(lower({body}), '[.!?]', ' ', 'g'), '[{S}]+')"
    kept = f"list_filter({tokens}, lambda t: t <> '' AND NOT list_contains({sq.sql_list(keep)}, t))"
    return f"array_to_string(list_transform({kept}, lambda t: coalesce({lemmas}[t], t)), ' ')"


def _clean_fa_sql(column: str) -> str:
    keep = [w for w in lx.STOPWORDS_FA if w not in lx.NEGATIONS_FA]
    lemmas = "MAP {" + ", ".join(f"{sq.quoted(k)}: {sq.quoted(v.split('#')[0])}" for k, v in lx.LEMMAS_FA.items()) + "}"
    body = rf"regexp_replace(regexp_replace({column}, '(http|www)[^{S}]+', '', 'g'), '[^{W}{S}.!?؟]', '', 'g')"
    body = f"replace(replace({body}, 'ي', 'ی'), 'ك', 'ک')"
    tokens = rf"regexp_split_to_array(regexp_replace({body}, '([.!?؟]+)', ' \1 ', 'g'), '[{S}]+')"
    kept = f"list_filter({tokens}, lambda t: length(t) > 1 AND NOT list_contains({sq.sql_list(keep)}, t))"
    return f"array_to_string(list_transform({kept}, lambda t: coalesce({lemmas}[t], t)), ' ')"


@query("clean_en", f"SELECT doc_id, {_clean_en_sql('text')} AS cleaned_content FROM documents")
def _(spark, folder):
    return documents(spark, folder, "doc_id", "text", parts=PARTS).select("doc_id", tx.clean_en(F.col("text")).alias("cleaned_content"))


@query("clean_fa", f"SELECT doc_id, {_clean_fa_sql('text')} AS cleaned_content FROM documents")
def _(spark, folder):
    return documents(spark, folder, "doc_id", "text", parts=PARTS).select("doc_id", tx.clean_fa(F.col("text")).alias("cleaned_content"))


@query(
    "clean_by_lang",
    f"SELECT doc_id, CASE WHEN lang = 'en' THEN {_clean_en_sql('text')} ELSE {_clean_fa_sql('text')} END "
    "AS cleaned_content FROM documents",
)
def _(spark, folder):
    cleaned = tx.clean_by_lang(F.col("text"), F.col("lang"), english="en")
    return documents(spark, folder, parts=PARTS).select("doc_id", cleaned.alias("cleaned_content"))


_KEPT = [w for w in demo.STOPWORDS if w not in demo.NEGATIONS]


@query(
    "stopwords_keep_negation",
    f"""SELECT conv_id, turn, array_to_string(list_filter({sq.words('lower(text)')},
          lambda t: NOT (list_contains({sq.sql_list(demo.STOPWORDS)}, t)
                         AND NOT list_contains({sq.sql_list(demo.NEGATIONS)}, t))), ' ') AS kept
        FROM conversations""",
)
def _(spark, folder):
    stop = tx.stopwords_keep_negation(demo.STOPWORDS, demo.NEGATIONS)
    kept = F.filter(tx.split_words(F.lower("text")), lambda t: ~t.isin(stop))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@query("clean_symbols_letters", f"SELECT doc_id, {sq.clean_symbols('text')} AS ultra_clean_content FROM documents")
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", tx.clean_symbols_letters(F.col("text")).alias("ultra_clean_content")
    )


@query("clean_symbols_final", f"SELECT page_id, {sq.clean_symbols('html')} AS final_clean_content FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", tx.clean_symbols_final(F.col("html")).alias("final_clean_content")
    )


@query(
    "non_blank",
    sq.reviews(
        f"SELECT review_id, score FROM reviews r LEFT JOIN labels l ON r.review_id = concat('r', CAST(l.doc_id AS VARCHAR)) "
        f"WHERE regexp_matches({sq.clean_symbols('content')}, '[^{S}]') AND l.quality IS NOT NULL"
    ),
)
def _(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("review_id"), "quality"
    )
    rows = reviews(spark, folder).join(labels, "review_id", "left")
    rows = rows.withColumn("score", F.when(F.col("quality").isNotNull(), F.col("score").cast("double")))
    cleaned = rows.withColumn("cleaned_content", tx.clean_symbols(F.col("content")))
    return fl.non_blank(cleaned).select("review_id", "score")


def _generic_sql(column: str) -> str:
    w = sq.words(f"lower({column})")
    return f"({column} IS NULL OR len({w}) <= 2 OR len(list_filter({w}, lambda t: NOT list_contains({sq.sql_list(demo.FILLER)}, t))) = 0)"


@query("is_generic_or_short", sq.reviews(f"SELECT review_id, {_generic_sql('content')} AS is_generic FROM reviews"))
def _(spark, folder):
    flag = tx.is_generic_or_short(F.col("content"), demo.FILLER)
    return reviews(spark, folder, scored=False).select("review_id", flag.alias("is_generic"))


@query("deep_filter", sq.reviews(f"SELECT review_id, app_label, content FROM reviews WHERE NOT {_generic_sql('content')}"))
def _(spark, folder):
    return fl.deep_filter(reviews(spark, folder, scored=False), filler=demo.FILLER).select("review_id", "app_label", "content")


@query("word_count", f"SELECT conv_id, turn, CAST(len({sq.words('text')}) AS BIGINT) AS words FROM conversations")
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", tx.word_count(F.col("text")).alias("words"))


def flag_sql(column: str, lang: str) -> str:
    cases = " ".join(
        f"WHEN {lang} = {sq.quoted(k)} THEN regexp_matches(lower({column}), {sq.quoted('|'.join(v))})"
        for k, v in demo.FLAGS.items()
    )
    return f"(CASE {cases} ELSE FALSE END)"


@query("flag_keywords", sq.reviews(f"SELECT review_id, lang, {flag_sql('content', 'lang')} AS flagged FROM reviews"))
def _(spark, folder):
    flag = tx.flag_keywords(F.col("content"), F.col("lang"), demo.FLAGS)
    return reviews(spark, folder, scored=False).select("review_id", "lang", flag.alias("flagged"))


def category_sql(column: str, lang: str, name: str) -> str:
    words = demo.CATEGORIES[name]
    en, other = (sq.quoted("|".join(words[k])) for k in ("en", "fa"))
    return f"regexp_matches(lower({column}), CASE WHEN {lang} = 'en' THEN {en} ELSE {other} END)"


@query(
    "category_flags",
    sq.reviews(
        "SELECT review_id, "
        + ", ".join(
            f"(lang = 'en' AND regexp_matches(lower(content), {sq.quoted('|'.join(v['en']))}) OR lang <> 'en' AND "
            f"regexp_matches(lower(content), {sq.quoted('|'.join(v['fa']))})) AS \"{k}\""
            for k, v in demo.CATEGORIES.items()
        )
        + " FROM reviews"
    ),
)
def _(spark, folder):
    flags = tx.category_flags(F.col("content"), F.col("lang"), demo.CATEGORIES, "en")
    return evaluate_once(reviews(spark, folder, scored=False), flags=flags).select("review_id", "flags.*")


@query(
    "sentences",
    f"SELECT conv_id, turn, array_to_string(t, '|') AS tokens, CAST(len(t) AS BIGINT) AS n FROM "
    f"(SELECT conv_id, turn, {sq.words(sq.clean_symbols('text'))} AS t FROM conversations) WHERE len(t) > 2",
)
def _(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("clean", tx.clean_symbols(F.col("text")))
    out = fl.sentences(rows, "clean", 3)
    return out.select("conv_id", "turn", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").cast("bigint").alias("n"))


@query("fa_digits_to_latin", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS plain FROM orders")
def _(spark, folder):
    native = F.translate(F.date_format("o_orderdate", "yyyy/MM/dd"), tx.LATIN_DIGITS, tx.PERSIAN_DIGITS)
    rows = table(spark, folder, "orders").select("o_orderkey", native.alias("native"))
    return rows.select("o_orderkey", tx.fa_digits_to_latin(F.col("native")).alias("plain"))


_ANSWERS = list(lx.LIKERT_SCALE) + ["5", "4.5", "-", ""]
_ANSWER_SQL = "[" + ", ".join("NULL" if v is None else str(float(v)) for v in lx.LIKERT_SCALE.values()) + ", 5.0, 4.5, NULL, NULL]"


@query(
    "likert_recode",
    f"SELECT l_orderkey, l_linenumber, CAST({_ANSWER_SQL}[1 + CAST(l_quantity AS INT) % {len(_ANSWERS)}] AS DOUBLE) AS answer "
    "FROM lineitem",
)
def _(spark, folder):
    pick = F.element_at(tx.string_array(_ANSWERS), 1 + (F.col("l_quantity").cast("int") % len(_ANSWERS)))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", pick.alias("text"))
    return rows.select("l_orderkey", "l_linenumber", tx.likert_recode(F.col("text")).alias("answer"))


def labelled_by_number(spark, folder):
    """Reviews with a Persian aspect label picked by document number."""
    n = F.substring("review_id", 2, 20).cast("bigint")
    pick = F.element_at(tx.string_array(LABELS), (1 + n % len(LABELS)).cast("int"))
    return reviews(spark, folder).withColumn("Final_Aspect", pick)


LABEL_SQL = f"{sq.sql_list(LABELS)}[1 + CAST(substr(review_id, 2) AS BIGINT) % {len(LABELS)}]"


def _exact_sql(label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN {sq.quoted(k)} THEN {sq.quoted(v)}" for k, v in lx.ASPECT_NAMES.items()) + f" ELSE {label} END"


@query("recode_label", sq.reviews(f"SELECT review_id, {_exact_sql(LABEL_SQL)} AS \"Aspect_EN\" FROM reviews"))
def _(spark, folder):
    rows = labelled_by_number(spark, folder)
    return rows.select("review_id", tx.recode_label(F.col("Final_Aspect")).alias("Aspect_EN"))


def _substring_sql(label: str, rules) -> str:
    plain = f"replace({label}, chr(8204), ' ')"
    return sq.first_case(
        [(name, sq.any_of(f"contains({plain}, {sq.quoted(w)})" for w in words)) for name, words in rules.items()], plain
    )


for _name, _rules in {"recode_by_substring": lx.SUBSTRING_RULES_SHORT, "recode_by_substring_wide": lx.SUBSTRING_RULES_WIDE}.items():

    @query(_name, sq.reviews(f"SELECT review_id, {_substring_sql(LABEL_SQL, _rules)} AS \"Aspect_EN\" FROM reviews"))
    def _(spark, folder, rules=_rules):
        rows = labelled_by_number(spark, folder)
        return rows.select("review_id", tx.recode_by_substring(F.col("Final_Aspect"), rules).alias("Aspect_EN"))


@query(
    "unmapped_labels",
    sq.reviews(
        f"SELECT DISTINCT label AS \"Final_Aspect\" FROM (SELECT {LABEL_SQL} AS label FROM reviews) "
        f"WHERE label NOT IN ({', '.join(sq.quoted(k) for k in lx.ASPECT_NAMES)})"
    ),
)
def _(spark, folder):
    rows = labelled_by_number(spark, folder).withColumn("Aspect_EN", tx.recode_label(F.col("Final_Aspect")))
    return fl.unmapped_labels(rows)


@query(
    "date_range",
    sq.reviews("SELECT review_id, date FROM reviews WHERE date BETWEEN DATE '2025-11-15' AND DATE '2026-05-31'"),
)
def _(spark, folder):
    return fl.date_range(reviews(spark, folder, scored=False), "date", "2025-11-15", "2026-05-31").select("review_id", "date")


@query(
    "isin_top_aspects",
    sq.reviews(
        f"SELECT * FROM (SELECT review_id, ecosystem, {_exact_sql(LABEL_SQL)} AS \"Aspect_EN\" FROM reviews) WHERE "
        + " OR ".join(
            f"(ecosystem = {sq.quoted(e)} AND \"Aspect_EN\" IN ({', '.join(sq.quoted(a) for a in tops)}))"
            for e, tops in lx.TOP_ASPECTS.items()
        )
    ),
)
def _(spark, folder):
    rows = labelled_by_number(spark, folder).withColumn("Aspect_EN", tx.recode_label(F.col("Final_Aspect")))
    return fl.isin_top_aspects(rows).select("review_id", "ecosystem", "Aspect_EN")


@query("drop_nulls", sq.reviews("SELECT review_id, developer_reply FROM reviews WHERE developer_reply IS NOT NULL AND score IS NOT NULL"))
def _(spark, folder):
    return fl.drop_nulls(reviews(spark, folder), ["developer_reply", "score"]).select("review_id", "developer_reply")


@query("non_empty_comment", sq.reviews(f"SELECT review_id, trim(content) AS content FROM reviews WHERE regexp_matches(content, '[^{S}]')"))
def _(spark, folder):
    return fl.non_empty_comment(reviews(spark, folder, scored=False)).select("review_id", "content")
