"""Queries: batch and streaming ingest. Orders and events take the part of the feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators import ingest as ig
from revlens.plans.catalog import query
from revlens.plans.fixtures import documents, table
from revlens.session import materialised, scratch_path
from revlens.streaming import ingest as si

START, MONTHS = "2001-08", 6
SPINE = ig.spine_keys(START, MONTHS)
_SPINE_SQL = "('2001-08', '2001-07', '2001-06', '2001-05', '2001-04', '2001-03')"

# Quotas by app and status: urgent orders have half the others' quota, status P is not listed.
_TARGETS_SQL = """targets AS (SELECT app_label, lang, CASE WHEN app_label = '1-URGENT' THEN 4 ELSE 8 END AS target
  FROM (SELECT DISTINCT app_label, lang FROM feed) WHERE lang <> 'P')"""

_FEED_SQL = """feed AS (SELECT concat('o', o_orderkey) AS review_id, o_orderpriority AS app_label, o_orderstatus AS lang,
  o_orderdate AS full_date, CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"""


def feed(spark, folder):
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("review_id"),
        F.col("o_orderpriority").alias("app_label"), F.col("o_orderstatus").alias("lang"),
        F.col("o_orderdate").alias("full_date"), F.col("o_orderdate").cast("date").alias("date"),
    )


def targets(rows, group=("app_label", "lang"), low=4, high=8):
    known = rows.select(*group).distinct()
    if "lang" in group:
        known = known.filter(F.col("lang") != "P")
    return known.withColumn("target", F.when(F.col("app_label") == "1-URGENT", low).otherwise(high))


@query(
    "month_spine",
    """SELECT CAST(i AS BIGINT) AS position, strftime(date_trunc('month', m) - to_months(CAST(i AS INT)), '%Y-%m') AS month
       FROM (SELECT max(o_orderdate) AS m FROM orders), range(0, 6) t(i)""",
)
def _(spark, folder):
    newest = table(spark, folder, "orders").agg(F.max("o_orderdate").alias("start"))
    return ig.month_spine(newest, "start", MONTHS)


@query(
    "quota_admit",
    f"""WITH {_FEED_SQL}, {_TARGETS_SQL} SELECT review_id, app_label, lang, date, month FROM feed JOIN targets USING (app_label, lang)
        WHERE month IN {_SPINE_SQL}
        QUALIFY row_number() OVER (PARTITION BY app_label, lang, month ORDER BY full_date DESC, review_id) <= target""",
)
def _(spark, folder):
    rows = feed(spark, folder)
    return ig.quota_admit(rows, SPINE, targets(rows)).select("review_id", "app_label", "lang", "date", "month")


@query(
    "quota_admit_large",
    f"""WITH {_FEED_SQL} SELECT review_id, app_label, month FROM feed
        QUALIFY row_number() OVER (PARTITION BY app_label ORDER BY full_date DESC, review_id) <= 1500""",
)
def _(spark, folder):
    from revlens.functions.dates import month_key
    from revlens.operators.ranking import SALTS, top_n_per_key

    rows = feed(spark, folder).withColumn("month", month_key(F.col("date")))
    return top_n_per_key(rows, ["app_label"], ig.newest_first(), 1500, SALTS).select("review_id", "app_label", "month")


@query(
    "quota_resume",
    f"""WITH {_FEED_SQL}, old AS (SELECT app_label, month, count(*) AS stored FROM feed WHERE lang = 'F' GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY app_label, month ORDER BY full_date DESC, review_id) AS r
                   FROM feed WHERE lang <> 'F' AND month IN {_SPINE_SQL})
        SELECT review_id, app_label, month FROM ranked LEFT JOIN old USING (app_label, month)
        WHERE r + coalesce(stored, 0) <= CASE WHEN app_label = '1-URGENT' THEN 12 ELSE 24 END""",
)
def _(spark, folder):
    rows = feed(spark, folder)
    admitted = ig.quota_resume(
        rows.filter(F.col("lang") == "F"), rows.filter(F.col("lang") != "F"), SPINE,
        targets(rows, ("app_label",), 12, 24), ["app_label"],
    )
    return admitted.select("review_id", "app_label", "month")


@query(
    "quota_full",
    f"""WITH {_FEED_SQL}, c AS (SELECT app_label, lang, month, count(*) AS n FROM feed WHERE month IN {_SPINE_SQL} GROUP BY ALL)
        SELECT g.app_label, g.lang, count(n) AS months_seen,
          coalesce(count(*) FILTER (WHERE n >= CASE WHEN g.lang = 'P' THEN 0 WHEN g.app_label = '1-URGENT' THEN 5 ELSE 10 END) = 6, FALSE) AS is_full
        FROM (SELECT DISTINCT app_label, lang FROM feed) g LEFT JOIN c USING (app_label, lang) GROUP BY ALL""",
)
def _(spark, folder):
    rows = feed(spark, folder)
    return ig.quota_full(rows, SPINE, targets(rows, low=5, high=10))


@query(
    "quota_overflow",
    f"""WITH {_FEED_SQL}, {_TARGETS_SQL}, c AS (SELECT app_label, lang, month, count(*) - coalesce(any_value(target), 0) AS skipped
          FROM feed LEFT JOIN targets USING (app_label, lang) WHERE month IN {_SPINE_SQL} GROUP BY ALL)
        SELECT * FROM c WHERE skipped > 0""",
)
def _(spark, folder):
    rows = feed(spark, folder)
    return ig.quota_overflow(rows, SPINE, targets(rows))


@query("cut_older_than", f"WITH {_FEED_SQL} SELECT review_id, date FROM feed WHERE month >= '2001-03'")
def _(spark, folder):
    return ig.cut_older_than(feed(spark, folder), SPINE[-1]).select("review_id", "date")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query(
    "append_dedup",
    f"""SELECT {_LINE} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_shipdate DESC, l_linenumber, l_extendedprice, l_partkey, l_suppkey) = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    columns = _LINE.split(", ")
    old, new = rows.filter(F.col("l_returnflag") == "A"), rows.filter(F.col("l_returnflag") != "A")
    order = [F.col("l_shipdate").desc(), F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]
    return ig.append_dedup(old.select(*columns), new.select(*columns), "l_orderkey", order)


@query(
    "dedup_user_text",
    "SELECT doc_id, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1",
)
def _(spark, folder):
    rows = documents(spark, folder, "doc_id", "lang", "text")
    return ig.dedup_user_text(rows, [F.col("doc_id")], "lang", "text")


@query(
    "limit_per_app",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return ig.limit_per_app(rows, 20, [F.col("doc_id")], "source")


# The event feed arrives newest first in four pages; every page repeats the page before it.
_PAGES = ["2024-02-01", "2024-01-24", "2024-01-17", "2024-01-09", "2024-01-01"]


def event_feed(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("review_id"), F.col("event_type").alias("app_label"),
        F.lit("en").alias("lang"), "value", F.col("ts").alias("full_date"), F.col("ts").cast("date").alias("date"),
    )


def _arrivals(spark, folder, landing):
    """Append one page after the other to the landing folder."""
    rows = event_feed(spark, folder)
    for i in range(len(_PAGES) - 1):
        newest = _PAGES[max(i - 1, 0)]
        page = rows.filter((F.col("date") < F.lit(newest).cast("date")) & (F.col("date") >= F.lit(_PAGES[i + 1]).cast("date")))
        page.write.mode("append").parquet(landing)
        yield rows.schema


@query(
    "stream_ingest",
    """SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS app_label, value, CAST(ts AS DATE) AS date,
       strftime(ts, '%Y-%m') AS month FROM events""",
)
def _(spark, folder):
    base = scratch_path(spark, "stream-ingest")
    for schema in _arrivals(spark, folder, base + "/landing"):
        pages = si.review_stream(spark, base + "/landing", schema)
        si.stream_ingest(pages, base + "/sink", base + "/state", ["2024-01"]).awaitTermination()
    return si.read_sink(spark, base + "/sink", schema).select("review_id", "app_label", "value", "date", "month")


@query(
    "stream_quota",
    """SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS app_label, CAST(ts AS DATE) AS date FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY ts DESC, CAST(event_id AS VARCHAR))
         <= CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 300 ELSE 600 END""",
)
def _(spark, folder):
    base = scratch_path(spark, "stream-quota")
    apps = event_feed(spark, folder).select("app_label", "lang").distinct()
    low = F.col("app_label") == F.min("app_label").over(Window.partitionBy())  # one row per app
    quota = materialised(apps.withColumn("target", F.when(low, 300).otherwise(600)), "quotas")
    for schema in _arrivals(spark, folder, base + "/landing"):
        pages = si.review_stream(spark, base + "/landing", schema)
        si.stream_quota(pages, base + "/sink", base + "/state", ["2024-01"], quota).awaitTermination()
    return si.read_sink(spark, base + "/sink", schema).select("review_id", "app_label", "date")


@query(
    "stream_monthly_counts",
    """SELECT event_type AS app_label, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS reviews,
       round(avg(value), 6) AS mean_score FROM events GROUP BY ALL""",
)
def _(spark, folder):
    base = scratch_path(spark, "stream-counts")
    rows = event_feed(spark, folder).withColumn("score", F.col("value"))
    rows.write.parquet(base + "/landing")
    counts = si.monthly_counts_stream(si.review_stream(spark, base + "/landing", rows.schema), ["app_label"])

    def keep(batch, batch_id):
        # Complete output: every batch is the whole result, one row per app and month.
        batch.write.mode("overwrite").parquet(base + "/result")

    (
        counts.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()
    )
    out = spark.read.schema(counts.schema).parquet(base + "/result")
    return out.select(
        "app_label", F.col("month_start").cast("date").alias("month"), "reviews", F.round("mean_score", 6).alias("mean_score")
    )
