"""Queries: descriptive reports, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import text as tx
from revlens.operators import stats as st
from revlens.plans import demo
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import PARTS, documents, reviews, table
from revlens.plans.q_labels import CHAIN, labelled
from revlens.plans.q_text import category_sql, flag_sql


def platform(spark, folder):
    return reviews(spark, folder).withColumnRenamed("ecosystem", "platform_type")


@query(
    "app_basic_stats",
    sq.reviews(
        "SELECT ecosystem AS platform_type, app_label, count(content) AS total_comments, "
        "round(avg(score), 2) AS avg_score FROM reviews GROUP BY ALL"
    ),
)
def _(spark, folder):
    return st.app_basic_stats(platform(spark, folder))


_NULL_COLUMNS = ["review_id", "user_name", "content", "score", "date", "app_version", "developer_reply", "app_label"]


@query(
    "null_report",
    sq.reviews(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS null_percentage FROM reviews"
            for c in _NULL_COLUMNS
        )
    ),
)
def _(spark, folder):
    return st.null_report(reviews(spark, folder), _NULL_COLUMNS)


@query(
    "reply_rate",
    sq.reviews(
        "SELECT ecosystem AS platform_type, count(content) AS total_reviews, count(developer_reply) AS replied_reviews, "
        "round(count(developer_reply) / count(content) * 100, 2) AS reply_rate_percentage FROM reviews GROUP BY ALL"
    ),
)
def _(spark, folder):
    return st.reply_rate(platform(spark, folder))


@query("volume_by_platform", sq.reviews("SELECT ecosystem AS platform_type, count(*) AS reviews FROM reviews GROUP BY ALL"))
def _(spark, folder):
    return st.volume_by_platform(platform(spark, folder))


@query("avg_score_ranked", sq.reviews("SELECT app_label, avg(score) AS mean_score FROM reviews GROUP BY ALL ORDER BY 2 DESC, 1"))
def _(spark, folder):
    return st.avg_score_ranked(reviews(spark, folder))


_DESCRIBE = f"""round(avg(len({sq.words('TEXT')})), 1) AS "Avg_Words_per_Comment", round(avg(score), 2) AS "Mean_Score",
  round(stddev_samp(score), 2) AS "Score_Std_Dev", coalesce(strftime(min(date), '%Y-%m-%d'), 'N/A') AS "Start_Date",
  coalesce(strftime(max(date), '%Y-%m-%d'), 'N/A') AS "End_Date" """


@query(
    "macro_stats",
    sq.reviews(
        'SELECT ecosystem AS "Ecosystem", app_label, lang, count(*) AS "Total_Reviews", '
        + _DESCRIBE.replace("TEXT", "content") + "FROM reviews GROUP BY 1, 2, 3"
    ),
)
def _(spark, folder):
    rows = reviews(spark, folder, parts=PARTS).withColumnsRenamed({"ecosystem": "Ecosystem", "date": "parsed_date"})
    return st.macro_stats(rows)


@query(
    "table_stats",
    sq.reviews(
        'SELECT ecosystem AS "Ecosystem", app_label, count(review_id) AS "Total_Reviews", '
        + _DESCRIBE.replace("TEXT", "t") + f"FROM (SELECT *, {sq.clean_symbols('content')} AS t FROM reviews) GROUP BY 1, 2"
    ),
)
def _(spark, folder):
    rows = reviews(spark, folder, parts=PARTS).withColumnRenamed("ecosystem", "Ecosystem")
    return st.table_stats(rows.withColumn("final_clean_content", tx.clean_symbols_final(F.col("content"))))


@query(
    "hallucination_impact",
    sq.reviews(
        "SELECT app_label, lang, round(count(*) FILTER (WHERE f) / count(*) * 100, 2) AS hallucination_rate, "
        "round(coalesce(avg(score) FILTER (WHERE NOT f), 0), 2) AS avg_score_normal, "
        "round(coalesce(avg(score) FILTER (WHERE f), 0), 2) AS avg_score_hallucinated "
        f"FROM (SELECT *, {flag_sql('content', 'lang')} AS f FROM reviews) GROUP BY ALL"
    ),
)
def _(spark, folder):
    return st.hallucination_impact(reviews(spark, folder), keywords=demo.FLAGS)


@query(
    "score_dist_by_flag",
    sq.reviews(f"SELECT score, {flag_sql('content', 'lang')} AS flag, count(*) AS reviews FROM reviews GROUP BY ALL"),
)
def _(spark, folder):
    flag = tx.flag_keywords(F.col("content"), F.col("lang"), demo.FLAGS)
    return st.score_dist_by_flag(reviews(spark, folder), flag)


_LEVEL = f"CASE WHEN score IN (1, 2) THEN '{lx.LEVEL_LOW}' WHEN score IN (4, 5) THEN '{lx.LEVEL_HIGH}' END"


@query(
    "mention_pct",
    sq.reviews(
        " UNION ALL ".join(
            f"""SELECT level AS "Trust_Level", '{name.replace('_', ' ')}' AS "Category",
                avg(CAST({category_sql('content', 'lang', name)} AS INT)) * 100 AS "Mention_Percentage"
                FROM leveled WHERE level IS NOT NULL GROUP BY level"""
            for name in demo.CATEGORIES
        ),
        f"leveled AS (SELECT *, {_LEVEL} AS level FROM reviews)",
    ),
)
def _(spark, folder):
    return st.mention_pct(reviews(spark, folder), categories=demo.CATEGORIES, english="en")


@query(
    "aspect_freq_pct",
    sq.reviews(
        f"""SELECT "Final_Aspect" AS "English_Aspect", level AS "Trust_Level", count(*) AS "Count",
              count(*) / (SELECT count(*) FROM labelled WHERE app_label = 'src3' AND score <> 3) * 100 AS "Percentage"
            FROM (SELECT *, CASE WHEN score >= 4 THEN '{lx.LEVEL_HIGH}' WHEN score <= 2 THEN '{lx.LEVEL_LOW}' END AS level FROM labelled)
            WHERE app_label = 'src3' AND level IS NOT NULL GROUP BY 1, 2""",
        *CHAIN,
    ),
)
def _(spark, folder):
    return st.aspect_freq_pct(labelled(spark, folder, trust=False), "src3")


@query(
    "ecosystem_totals",
    sq.reviews(
        "SELECT ecosystem, count(*) AS reviews FROM reviews GROUP BY ecosystem UNION ALL SELECT 'Total', count(*) FROM reviews"
    ),
)
def _(spark, folder):
    return st.ecosystem_totals(reviews(spark, folder, scored=False))


@query(
    "attrition",
    f"""SELECT count(*) AS before_filter, count(*) FILTER (WHERE g) AS removed,
          round(count(*) FILTER (WHERE g) / count(*) * 100, 1) AS removed_pct, count(*) FILTER (WHERE NOT g) AS kept
        FROM (SELECT text IS NULL OR len(w) <= 2 OR len(list_filter(w, lambda t: NOT list_contains({sq.sql_list(demo.FILLER)}, t))) = 0 AS g
              FROM (SELECT text, {sq.words('lower(text)')} AS w FROM documents))""",
)
def _(spark, folder):
    return st.attrition(documents(spark, folder), tx.is_generic_or_short(F.col("text"), demo.FILLER))


@query(
    "funnel",
    sq.reviews(
        "SELECT count(*) AS all_rows, count(*) FILTER (WHERE developer_reply IS NOT NULL AND score IS NOT NULL) AS complete, "
        "count(*) FILTER (WHERE developer_reply IS NOT NULL AND score IS NOT NULL AND date BETWEEN DATE '2025-12-01' AND "
        "DATE '2026-03-31') AS in_period FROM reviews"
    ),
)
def _(spark, folder):
    complete = F.col("developer_reply").isNotNull() & F.col("score").isNotNull()
    return st.funnel(
        reviews(spark, folder), [("complete", complete), ("in_period", F.col("date").between("2025-12-01", "2026-03-31"))]
    )


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY 2 DESC, 1")
def _(spark, folder):
    return st.value_counts(table(spark, folder, "events"), "event_type")


@query(
    "confusion_matrix",
    """WITH m AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
       spine AS (SELECT t, p FROM (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(p))
       SELECT CAST(s.t AS VARCHAR) AS label, CAST(s.p AS VARCHAR) AS prediction, coalesce(m.n, 0) AS n,
              coalesce(m.n, 0) / greatest(sum(coalesce(m.n, 0)) OVER (PARTITION BY s.t), 1) * 100 AS row_pct
       FROM spine s LEFT JOIN m USING (t, p)""",
)
def _(spark, folder):
    rows = table(spark, folder, "labels").select(
        F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")
    )
    return st.confusion_matrix(rows, "quality", "toxic", ["0", "1"])


@query("accuracy", "SELECT avg(CAST(quality = toxic AS INT)) AS accuracy FROM labels")
def _(spark, folder):
    return st.accuracy(table(spark, folder, "labels"), "quality", "toxic")


_ITEMS = {
    "charges": ["l_discount", "l_tax"],
    "amounts": ["l_quantity", "price_k", "l_linenumber"],
    "mixed": ["l_quantity", "price_k", "discount_pct", "tax_pct", "l_linenumber"],
}
_ITEMS_SQL = """items AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice / 1000 AS price_k, l_discount, l_tax, l_discount * 100 AS discount_pct, l_tax * 100 AS tax_pct,
  CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem)"""


def _alpha_sql(name, items):
    done = " AND ".join(f"{i} IS NOT NULL" for i in items)
    k = len(items)
    return (
        f"SELECT '{name}' AS block, CAST({k} AS BIGINT) AS items, count(*) AS answers, "
        f"round({k}.0 / {k - 1} * (1 - ({' + '.join(f'var_samp({i})' for i in items)}) / var_samp({' + '.join(items)})), 3) AS alpha "
        f"FROM items WHERE {done}"
    )


@query(
    "cronbach_alpha",
    f"WITH {_ITEMS_SQL} SELECT *, CASE WHEN alpha >= 0.7 THEN 'good' ELSE 'check' END AS status FROM ("
    + " UNION ALL ".join(_alpha_sql(n, i) for n, i in _ITEMS.items()) + ")",
)
def _(spark, folder):
    missing = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    rows = table(spark, folder, "lineitem").select(
        F.when(~missing, F.col("l_quantity")).alias("l_quantity"), (F.col("l_extendedprice") / 1000).alias("price_k"),
        "l_discount", "l_tax", (F.col("l_discount") * 100).alias("discount_pct"), (F.col("l_tax") * 100).alias("tax_pct"),
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
    )
    return st.cronbach_alpha(rows, _ITEMS)


@query(
    "sort_multi",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY 1, 3 DESC, 2",
)
def _(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return st.sort_multi(counts, [("o_orderstatus", True), ("n", False), ("o_orderpriority", True)])


@query("sort_single", "SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id")
def _(spark, folder):
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return st.sort_single(counts, "n", "user_id")


@query(
    "head",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey LIMIT 10",
)
def _(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return st.head(counts, [("n", False), ("l_partkey", True)], 10)


@query("nlargest", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_suppkey LIMIT 15")
def _(spark, folder):
    return st.nlargest(table(spark, folder, "lineitem"), "l_suppkey", 15)
