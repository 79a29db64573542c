"""The reviews view over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.staging import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tasks for costly text work: the given files have one row group each.
PARTS = 16


def documents(spark: SparkSession, folder: str, *columns: str, parts: int | None = None) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spread(docs.select(*columns) if columns else docs, parts, "doc_id")


def reviews(spark: SparkSession, folder: str, scored: bool = True, parts: int | None = None) -> DataFrame:
    """Documents and labels in the shape of reviews; without ``scored`` there is no score, and no join moves the texts."""
    d = documents(spark, folder, "doc_id", "text", "lang", "source", parts=parts)
    joined = d.join(table(spark, folder, "labels"), "doc_id", "left") if scored else d
    n = F.col("doc_id")
    score = (
        F.when(F.col("quality") == 1, 4 + n % 2).when(F.col("quality") == 0, 1 + n % 3).otherwise(1 + n % 5).cast("int")
    ) if scored else None
    return joined.select(
        F.concat(F.lit("r"), n.cast("string")).alias("review_id"),
        F.concat(F.lit("u"), (n % 97).cast("string")).alias("user_name"),
        F.col("text").alias("content"),
        *([score.alias("score")] if scored else []),
        F.date_add(F.lit("2025-10-01").cast("date"), (n % 270).cast("int")).alias("date"),
        F.when(n % 11 == 0, "Unknown").otherwise(
            F.concat((n % 4).cast("string"), F.lit("."), (n % 3).cast("string"), F.lit(".7"))
        ).alias("app_version"),
        F.when(n % 4 == 0, "reply").alias("developer_reply"),
        F.col("source").alias("app_label"),
        F.col("lang"),
        F.when(F.col("lang") == "en", "Global").otherwise("Native").alias("ecosystem"),
    )


REVIEWS_SQL = """reviews AS (
  SELECT concat('r', CAST(d.doc_id AS VARCHAR)) AS review_id,
         concat('u', CAST(d.doc_id % 97 AS VARCHAR)) AS user_name,
         d.text AS content,
         CAST(CASE WHEN l.quality = 1 THEN 4 + d.doc_id % 2
                   WHEN l.quality = 0 THEN 1 + d.doc_id % 3
                   ELSE 1 + d.doc_id % 5 END AS INT) AS score,
         DATE '2025-10-01' + CAST(d.doc_id % 270 AS INT) AS date,
         CASE WHEN d.doc_id % 11 = 0 THEN 'Unknown'
              ELSE concat(CAST(d.doc_id % 4 AS VARCHAR), '.', CAST(d.doc_id % 3 AS VARCHAR), '.7') END AS app_version,
         CASE WHEN d.doc_id % 4 = 0 THEN 'reply' END AS developer_reply,
         d.source AS app_label, d.lang AS lang,
         CASE WHEN d.lang = 'en' THEN 'Global' ELSE 'Native' END AS ecosystem
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
