"""Queries: files written from the given tables and read back by the package's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as tx
from revlens.operators import filters as fl
from revlens.operators import stats as st
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import documents, reviews, table
from revlens.session import scratch_path
from revlens.sources import reviews as src
from revlens.sources import sinks, survey

# One logical file per app and language: apps a0..a3, English ones global, the others native.
_NAME_SQL = """concat(CASE WHEN lang = 'en' THEN concat('balanced_data_a', n % 4, '_en_us') ELSE concat('native_data_a', n % 4, '_cafebazaar') END,
  CASE n % 3 WHEN 1 THEN '_labeled' WHEN 2 THEN '_ready_for_ml' ELSE '' END)"""
_FILES_SQL = f"files AS (SELECT *, {_NAME_SQL} AS name FROM (SELECT *, CAST(substr(review_id, 2) AS BIGINT) AS n FROM reviews))"


def _raw(spark, folder):
    rows = reviews(spark, folder)
    return rows.select(
        "review_id", "user_name", "content", "score",
        F.concat_ws(" ", F.col("date").cast("string"), F.lit("10:20:30")).alias("full_date"),
        F.col("date").cast("string").alias("date"), F.lit("10:20:30").alias("time"),
        "app_version", "developer_reply", "app_label", "lang",
    )


def _named(spark, folder):
    n = F.substring("review_id", 2, 20).cast("bigint")
    app = (n % 4).cast("string")
    name = F.concat(
        F.when(F.col("lang") == "en", F.concat(F.lit("balanced_data_a"), app, F.lit("_en_us")))
        .otherwise(F.concat(F.lit("native_data_a"), app, F.lit("_cafebazaar"))),
        F.when(n % 3 == 1, "_labeled").when(n % 3 == 2, "_ready_for_ml").otherwise(""),
    )
    return _raw(spark, folder).withColumn("file", name)


def written(spark, folder):
    path = scratch_path(spark, "raw-csv")
    sinks.write_csv(_named(spark, folder), path, "file")
    return path


@query(
    "read_reviews",
    sq.reviews(
        "SELECT review_id, user_name, md5(content) AS digest, score, concat(CAST(date AS VARCHAR), ' 10:20:30') AS full_date, "
        "CAST(date AS VARCHAR) AS date, '10:20:30' AS time, app_version, developer_reply, app_label, lang FROM reviews"
    ),
)
def _(spark, folder):
    rows = src.read_reviews(spark, written(spark, folder))
    return rows.drop("_source").withColumn("digest", F.md5("content")).drop("content")


@query(
    "with_file_meta",
    sq.reviews(
        """SELECT review_id, CASE WHEN lang = 'en' THEN 'Global' ELSE 'Native' END AS platform_type, ecosystem AS "Ecosystem",
             CASE WHEN lang = 'en' THEN 'en_us' ELSE 'fa_ir' END AS file_lang, concat('a', n % 4) AS file_app,
             CASE WHEN lang = 'en' THEN 'us' END AS file_country FROM files""",
        _FILES_SQL,
    ),
)
def _(spark, folder):
    rows = src.with_file_meta(src.read_reviews(spark, written(spark, folder)))
    return rows.select("review_id", "platform_type", "Ecosystem", "file_lang", "file_app", "file_country")


@query("select_files", sq.reviews("SELECT name AS _source, count(*) AS reviews FROM files WHERE n % 3 = 0 GROUP BY ALL", _FILES_SQL))
def _(spark, folder):
    base = src.select_files(src.read_reviews(spark, written(spark, folder)))
    return base.groupBy("_source").agg(F.count("*").alias("reviews"))


@query(
    "read_tolerant",
    sq.reviews(
        "SELECT name AS _source, count(*) AS all_rows, count(*) FILTER (WHERE score = 3) AS corrupt, "
        "count(*) FILTER (WHERE score <> 3) AS good FROM files GROUP BY ALL", _FILES_SQL
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "bad-csv")
    # Three-star rows are written with a score that is no number.
    rows = _named(spark, folder).withColumn("score", F.when(F.col("score") == 3, "three").otherwise(F.col("score").cast("string")))
    sinks.write_csv(rows, path, "file")
    return src.corrupt_rows(src.read_tolerant(spark, path))


@query(
    "parse_store_payload",
    """SELECT concat('bazaar_', event_type, '_', CAST(event_id AS VARCHAR)) AS review_id, 'Unknown' AS user_name, props AS content,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 5 END AS INT) AS score, strftime(ts, '%Y/%m/%d') AS full_date,
       '00:00:00' AS time, event_type AS app_label, 'fa' AS lang FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, folder):
    review = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise("").alias("comment"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 5).alias("rate"),
        F.date_format("ts", "yyyy/MM/dd").alias("date"),
    )
    # Replies page by page, as a store sends them: ids are unique, so a page holds at most 20 reviews.
    replies = table(spark, folder, "events").groupBy("event_type", F.floor(F.col("event_id") / 20).alias("page")).agg(
        F.to_json(
            F.struct(F.struct(F.struct(F.collect_list(review).alias("reviews")).alias("reviewReply")).alias("singleReply"))
        ).alias("payload")
    )
    end = replies.select("event_type", F.lit('{"properties": {"statusCode": 200}}').alias("payload")).distinct()
    rows = src.parse_store_payload(replies.select("event_type", "payload").union(end), F.col("event_type"))
    return rows.select("review_id", "user_name", "content", "score", "full_date", "time", "app_label", "lang")


@query(
    "normalise_review",
    """SELECT concat('ios_u', CAST(user_id AS VARCHAR), '_', strftime(ts, '%Y%m%d%H%M%S')) AS review_id,
       concat('u', CAST(user_id AS VARCHAR)) AS user_name, concat(event_type, '. ', props) AS content,
       CAST(trunc(value) AS INT) AS score, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
       'Unknown' AS app_version FROM events""",
)
def _(spark, folder):
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_name"), F.col("event_type").alias("title"),
        F.col("props").alias("content"), F.col("value").alias("score"), F.col("ts").alias("at"),
        F.lit(None).cast("string").alias("app_version"), F.lit(None).cast("string").alias("developer_reply"),
        F.lit("app").alias("app_label"), F.lit("us").alias("lang"),
    )
    out = src.normalise_review(rows, "at", "title", ios=True)
    return out.select("review_id", "user_name", "content", "score", "date", "time", "app_version")


@query("write_stage", sq.reviews("SELECT review_id, score, app_label, date, ecosystem FROM reviews"))
def _(spark, folder):
    path = scratch_path(spark, "stage")
    rows = reviews(spark, folder)
    sinks.write_stage(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.select("review_id", "score", "app_label", "date", "ecosystem")


@query("ecosystem_split", sq.reviews("SELECT ecosystem, app_label, count(*) AS reviews FROM reviews GROUP BY ALL"))
def _(spark, folder):
    path = scratch_path(spark, "ecosystems")
    rows = _raw(spark, folder)
    english, other = rows.filter(F.col("lang") == "en"), rows.filter(F.col("lang") != "en").drop("developer_reply")
    tag = F.when(F.col("lang") == "en", "Global").otherwise("Native")
    merged = sinks.ecosystem_split([english, other], tag)
    sinks.write_stage(merged, path)
    stored = spark.read.schema(merged.schema).parquet(path)
    return stored.groupBy("ecosystem", "app_label").agg(F.count("*").alias("reviews"))


@query("load_docs", f"SELECT {sq.clean_symbols('text')} AS cleaned_content FROM documents WHERE doc_id % 4 <> 3")
def _(spark, folder):
    part = F.when(F.col("doc_id") % 4 == 3, "test").otherwise("train")
    rows = documents(spark, folder).select(part.alias("part"), tx.clean_symbols(F.col("text")).alias("cleaned_content"))
    return fl.load_docs(rows)


@query("load_embeddings", "SELECT vec_id, len(embedding)::BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def _(spark, folder):
    path = scratch_path(spark, "embeddings")
    table(spark, folder, "embeddings").select("vec_id", "embedding").write.parquet(path)
    rows = src.load_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 6).alias("total"))


@query("write_report", sq.reviews("SELECT app_label, count(content) AS total_comments, round(avg(score), 2) AS avg_score FROM reviews GROUP BY ALL"))
def _(spark, folder):
    path = scratch_path(spark, "report")
    rows = reviews(spark, folder).withColumnRenamed("ecosystem", "platform_type").withColumn("platform_type", F.lit("all"))
    sinks.write_report(st.app_basic_stats(rows).drop("platform_type"), path)
    return spark.read.option("header", True).schema("app_label string, total_comments bigint, avg_score double").csv(path)


_SURVEY = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


@query(
    "read_survey",
    """SELECT count(*) AS answers, count(l_quantity) AS rated, round(avg(l_quantity), 6) AS mean_q, max(l_linenumber) AS max_line
       FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber
             FROM lineitem)""",
)
def _(spark, folder):
    path = scratch_path(spark, "survey")
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "قابل ارزیابی نیست").otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
    )
    notes = rows.groupBy().agg(F.lit("note").alias("l_quantity"), F.lit("note").alias("l_linenumber"))
    sinks.write_csv(notes.union(notes).union(rows), path)
    answers = survey.recode_survey(survey.read_survey(spark, path, F.col("l_quantity") == "note"))
    return answers.agg(
        F.count("*").alias("answers"), F.count("l_quantity").alias("rated"),
        F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.max("l_linenumber").alias("max_line"),
    )


@query("read_survey_by_position", "SELECT l_returnflag, count(*) AS answers, sum(l_linenumber)::DOUBLE AS total FROM lineitem GROUP BY 1")
def _(spark, folder):
    """Exports of every answer, each with two note rows at its head that carry no marker."""
    path = scratch_path(spark, "surveys")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("l_linenumber"))
    exports = rows.withColumn("export", F.concat_ws("-", "l_returnflag", (F.col("l_orderkey") % 4).cast("string"))).withColumn("place", F.lit(1))
    notes = exports.select("export").distinct().withColumn("l_returnflag", F.lit("note")).withColumn("l_linenumber", F.lit("7"))
    notes = notes.withColumn("place", F.explode(F.array(F.lit(0), F.lit(0))))
    dealt = exports.drop("l_orderkey").unionByName(notes).repartition("export").sortWithinPartitions("export", "place")
    sinks.write_csv(dealt.drop("place"), path, "export")
    answers = survey.read_survey(spark, path)
    return answers.groupBy("l_returnflag").agg(F.count("*").alias("answers"), F.sum(F.col("l_linenumber").cast("double")).alias("total"))
