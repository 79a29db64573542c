"""Queries: aspects, sentiment and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import labels as lb
from revlens.operators import labelling as lab
from revlens.plans import demo
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import PARTS, documents, reviews, table
from revlens.plans.trust import label_reviews, trusted_reviews

LISTS = {"lexicon": demo.ASPECTS, "positive": demo.POSITIVE, "negative": demo.NEGATIVE}

# The labelling chain in SQL.
_ASPECT = sq.first_case(
    [(name, sq.any_of(sq.hit("t", w) for w in words)) for name, words in demo.ASPECTS.items()], sq.quoted(lx.NOISE)
)
_POS = sq.count_of(sq.hit("t", w) for w in demo.POSITIVE)
_NEG = sq.count_of(sq.hit("t", w) for w in demo.NEGATIVE)
CLEAN_CTE = f"cleaned AS (SELECT *, {sq.clean_symbols('content')} AS t FROM reviews)"
COUNTED_CTE = f'counted AS (SELECT *, {_ASPECT} AS "Final_Aspect", {_POS} AS pos, {_NEG} AS neg FROM cleaned)'
POLAR_CTE = """polar AS (SELECT *, CAST(CASE WHEN pos > neg THEN 1 WHEN pos < neg THEN -1 WHEN score >= 4 THEN 1 ELSE -1 END AS INT)
                 AS "Sentiment_Polarity" FROM counted)"""
LABELLED_CTE = """labelled AS (SELECT *, CAST(CASE WHEN score >= 4 AND "Sentiment_Polarity" = 1 THEN 1
                 WHEN score <= 3 AND "Sentiment_Polarity" = -1 THEN 0 ELSE -1 END AS INT) AS "Composite_Trust" FROM polar)"""
CHAIN = (CLEAN_CTE, COUNTED_CTE, POLAR_CTE, LABELLED_CTE)
TRUSTED_CTE = f"""trusted AS (SELECT * FROM labelled WHERE "Final_Aspect" <> '{lx.NOISE}' AND "Composite_Trust" <> -1)"""
TRUSTED = (*CHAIN, TRUSTED_CTE)


def labelled(spark, folder, **steps):
    return label_reviews(reviews(spark, folder, parts=PARTS), **LISTS, **steps)


def trusted(spark, folder):
    return trusted_reviews(reviews(spark, folder, parts=PARTS), **LISTS)


_FIRST = sq.first_case(
    [(name, sq.any_of(f"contains(lower(text), {sq.quoted(w)})" for w in words)) for name, words in demo.FIRST_MATCH.items()],
    sq.quoted(lx.NOISE),
)


@query("aspect_first_match", f'SELECT doc_id, {_FIRST} AS "Final_Aspect" FROM documents')
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return lab.aspect_first_match(docs, "text", demo.FIRST_MATCH).select("doc_id", "Final_Aspect")


@query("aspect_lexicon", sq.reviews('SELECT review_id, "Final_Aspect" FROM counted', CLEAN_CTE, COUNTED_CTE))
def _(spark, folder):
    clean = lab.with_final_clean(reviews(spark, folder, scored=False, parts=PARTS))
    return lab.aspect_lexicon(clean, lexicon=demo.ASPECTS).select("review_id", "Final_Aspect")


@query(
    "drop_noise",
    sq.reviews(f"""SELECT review_id, "Final_Aspect" FROM counted WHERE "Final_Aspect" <> '{lx.NOISE}'""", CLEAN_CTE, COUNTED_CTE),
)
def _(spark, folder):
    clean = lab.with_final_clean(reviews(spark, folder, scored=False, parts=PARTS))
    return lab.drop_noise(lab.aspect_lexicon(clean, lexicon=demo.ASPECTS)).select("review_id", "Final_Aspect")


_PLAIN_POS = sq.count_of(sq.whole_word("t", w) for w in demo.POSITIVE)
_PLAIN_NEG = sq.count_of(sq.whole_word("t", w) for w in demo.NEGATIVE)
_SUB_POS = sq.count_of(f"contains(t, {sq.quoted(w)})" for w in demo.POSITIVE)
_SUB_NEG = sq.count_of(f"contains(t, {sq.quoted(w)})" for w in demo.NEGATIVE)


@query(
    "sentiment_lexicon",
    f"""SELECT doc_id, CAST(CASE WHEN p = 0 AND n = 0 THEN sign(sp - sn) ELSE sign(p - n) END AS INT) AS "Sentiment_Polarity"
        FROM (SELECT doc_id, {_PLAIN_POS} AS p, {_PLAIN_NEG} AS n, {_SUB_POS} AS sp, {_SUB_NEG} AS sn
              FROM (SELECT doc_id, lower(text) AS t FROM documents))""",
)
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    out = lab.sentiment_lexicon(docs, "text", demo.POSITIVE, demo.NEGATIVE)
    return out.select("doc_id", "Sentiment_Polarity")


@query(
    "sentiment_with_score",
    sq.reviews('SELECT review_id, "Sentiment_Polarity" FROM polar', CLEAN_CTE, COUNTED_CTE, POLAR_CTE),
)
def _(spark, folder):
    clean = lab.with_final_clean(reviews(spark, folder, parts=PARTS))
    out = lab.sentiment_with_score(clean, positive=demo.POSITIVE, negative=demo.NEGATIVE)
    return out.select("review_id", "Sentiment_Polarity")


_STORED = "CASE CAST(substr(review_id, 2) AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END"


@query(
    "fill_sentiment",
    sq.reviews(
        f"""SELECT review_id, CAST(CASE WHEN coalesce({_STORED}, 0) = 0 THEN "Sentiment_Polarity" ELSE {_STORED} END AS INT)
            AS "Sentiment_Polarity" FROM polar""",
        CLEAN_CTE, COUNTED_CTE, POLAR_CTE,
    ),
)
def _(spark, folder):
    n = F.substring("review_id", 2, 20).cast("bigint") % 4
    stored = F.when(n == 1, 0).when(n == 2, 1).when(n == 3, -1)
    clean = lab.with_final_clean(reviews(spark, folder, parts=PARTS)).withColumn("Sentiment_Polarity", stored)
    out = lab.fill_sentiment(clean, positive=demo.POSITIVE, negative=demo.NEGATIVE)
    return out.select("review_id", "Sentiment_Polarity")


@query(
    "composite_trust",
    sq.reviews('SELECT review_id, score, "Final_Aspect", "Sentiment_Polarity", "Composite_Trust" FROM labelled', *CHAIN),
)
def _(spark, folder):
    return labelled(spark, folder).select("review_id", "score", "Final_Aspect", "Sentiment_Polarity", "Composite_Trust")


@query("drop_contradictory", sq.reviews('SELECT review_id, "Final_Aspect", "Composite_Trust" FROM trusted', *TRUSTED))
def _(spark, folder):
    return trusted(spark, folder).select("review_id", "Final_Aspect", "Composite_Trust")


@query(
    "contradiction_report",
    sq.reviews(
        'SELECT count(*) AS total, count(*) FILTER (WHERE "Composite_Trust" = -1) AS removed, '
        'count(*) FILTER (WHERE "Composite_Trust" <> -1) AS kept FROM labelled', *CHAIN
    ),
)
def _(spark, folder):
    return lab.contradiction_report(labelled(spark, folder, aspects=False))


@query(
    "trust_level",
    sq.reviews(
        f"SELECT review_id, CASE WHEN score >= 4 THEN '{lx.LEVEL_HIGH}' WHEN score <= 2 THEN '{lx.LEVEL_LOW}' "
        f"ELSE '{lx.LEVEL_NEUTRAL}' END AS \"Trust_Level\" FROM reviews"
    ),
)
def _(spark, folder):
    return reviews(spark, folder).select("review_id", lb.trust_level(F.col("score")).alias("Trust_Level"))


@query(
    "trust_level_exact",
    f"SELECT event_id, CASE WHEN value IN (1, 2) THEN '{lx.LEVEL_LOW}' WHEN value IN (4, 5) THEN '{lx.LEVEL_HIGH}' "
    f"ELSE '{lx.LEVEL_NEUTRAL}' END AS \"Trust_Level\" FROM (SELECT event_id, round(value) AS value FROM events)",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.round("value").alias("value"))
    return events.select("event_id", lb.trust_level_exact(F.col("value")).alias("Trust_Level"))


_HITS = ", ".join(f"len(list_distinct(list_filter(w, lambda x: list_contains({sq.sql_list(t)}, x))))" for t in demo.TOPICS)


@query(
    "seed_anchor",
    f"""SELECT doc_id, CAST(CASE WHEN list_max(h) = 0 THEN -1 ELSE list_position(h, list_max(h)) - 1 END AS INT) AS anchor
        FROM (SELECT doc_id, [{_HITS}] AS h FROM (SELECT doc_id, {sq.words('text')} AS w FROM documents))""",
)
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return lab.seed_anchor(docs, demo.TOPICS, "text").select("doc_id", "anchor")


@query(
    "target_class",
    f"SELECT doc_id, CASE quality WHEN 0 THEN '{lx.CLASS_LOW}' WHEN 1 THEN '{lx.CLASS_HIGH}' END AS from_int, "
    f"CASE WHEN doc_id % 3 = 2 THEN 'other' WHEN quality = 0 THEN '{lx.CLASS_LOW}' ELSE '{lx.CLASS_HIGH}' END AS from_text "
    "FROM labels",
)
def _(spark, folder):
    text = F.when(F.col("doc_id") % 3 == 2, "other").when(F.col("doc_id") % 3 == 1, F.col("quality").cast("double").cast("string"))
    rows = table(spark, folder, "labels").withColumn("text", text.otherwise(F.col("quality").cast("string")))
    return rows.select(
        "doc_id", lb.target_class(F.col("quality")).alias("from_int"), lb.target_class(F.col("text")).alias("from_text")
    )


@query(
    "labelled_summary",
    sq.reviews(
        'SELECT ecosystem, "Final_Aspect", count(*) AS reviews, count(*) FILTER (WHERE "Composite_Trust" = 1) AS trusting '
        "FROM labelled GROUP BY ALL", *CHAIN
    ),
)
def _(spark, folder):
    return labelled(spark, folder).groupBy("ecosystem", "Final_Aspect").agg(
        F.count("*").alias("reviews"), F.count_if(F.col("Composite_Trust") == 1).alias("trusting")
    )


