"""Reading review files, their metadata, and raw store replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schema as sc
from revlens.sources.records import whole_records

# Default for missing text fields, time of day of native reviews, stage file suffixes.
UNKNOWN = "Unknown"
NATIVE_TIME = "00:00:00"
STAGE_SUFFIXES = ("_labeled", "_ready_for_ml")


def read_reviews(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = sc.RAW_REVIEW, tolerant: bool = False,
) -> DataFrame:
    """Review CSV files with a header as one table with a ``_source`` column.

    Fields may hold line breaks inside quotes, and large files are still split between tasks (``whole_records``).
    ``tolerant`` skips unreadable files and keeps bad rows in ``_corrupt_record``.
    """
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    if tolerant:
        schema = sc.with_corrupt_column(schema)
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
    records = whole_records(spark, paths, tolerant)
    fields = F.from_csv(F.col("record"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options)
    rows = records.select("file", fields.alias("r"))
    return rows.select("r.*", source_name(F.col("file")).alias("_source"))


def read_tolerant(spark: SparkSession, paths: str | list[str], schema: T.StructType = sc.RAW_REVIEW) -> DataFrame:
    return read_reviews(spark, paths, schema, tolerant=True)


def corrupt_rows(df: DataFrame) -> DataFrame:
    """Rows, bad rows and good rows with an id, per file.

    The reader only converts the fields a query uses, so the test touches them all.
    """
    fields = [F.col(c).cast("string") for c in df.columns if not c.startswith("_")]
    bad = (F.length(F.concat_ws("", *fields)) >= 0) & F.col("_corrupt_record").isNotNull()
    return df.groupBy("_source").agg(
        F.count("*").alias("all_rows"), F.count_if(bad).alias("corrupt"),
        F.count_if(~bad & F.col("review_id").isNotNull()).alias("good"),
    )


def source_name(path: Column) -> Column:
    """Logical file name: the deepest path part that is not one of Spark's own part files, without ``.csv``."""
    plain = F.url_decode(F.regexp_replace(path, r"/part-[^/]*$", ""))
    return F.regexp_replace(F.regexp_extract(plain, r"([^/=]+)/?$", 1), r"\.csv$", "")


def with_file_meta(df: DataFrame, source: str = "_source") -> DataFrame:
    """Ecosystem, platform type, app, language and country from the logical file name."""
    name = F.col(source)
    parts = F.split(name, "_")
    native = F.contains(name, F.lit("native")) | F.contains(name, F.lit("cafebazaar"))
    collected = F.startswith(name, F.lit("balanced_data_"))
    old_style = F.startswith(name, F.lit("data_"))
    third = F.contains(name, F.lit("balanced")) | F.contains(name, F.lit("native"))
    return df.select(
        "*",
        F.when(F.startswith(name, F.lit("balanced_data")), "Global")
        .when(F.startswith(name, F.lit("native_data")), "Native").otherwise("Unknown").alias("platform_type"),
        F.when(native, "Native").otherwise("Global").alias("Ecosystem"),
        F.when(F.contains(name, F.lit("_en_us")), "en_us").otherwise("fa_ir").alias("file_lang"),
        F.when(third, F.get(parts, F.lit(2))).when(old_style, F.get(parts, F.lit(1)))
        .otherwise(F.get(parts, F.lit(0))).alias("file_app"),
        F.when(collected, F.get(parts, F.lit(4))).when(old_style, F.get(parts, F.lit(3))).alias("file_country"),
    )


def select_files(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = STAGE_SUFFIXES,
                 source: str = "_source") -> DataFrame:
    """Rows of files whose name ends with one of ``include`` and with none of ``exclude``."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for suffix in include:
            keep = keep | F.endswith(F.col(source), F.lit(suffix))
    for suffix in exclude:
        if suffix not in include:
            keep = keep & ~F.endswith(F.col(source), F.lit(suffix))
    return df.filter(keep)


def parse_store_payload(df: DataFrame, app: Column, payload: str = "payload") -> DataFrame:
    """Raw JSON replies to the review contract, one row per review with a comment.

    A reply without the expected path yields no rows.
    """
    reviews = F.from_json(F.col(payload), sc.STORE_PAYLOAD)["singleReply"]["reviewReply"]["reviews"]
    rows = df.withColumn("_app", app).select("_app", F.explode(reviews).alias("r"))
    rows = rows.filter(F.coalesce(F.col("r.comment"), F.lit("")) != "")
    made_up_id = F.xxhash64("r.user", "r.comment", "r.date").cast("string")
    return rows.select(
        F.concat_ws("_", F.lit("bazaar"), "_app", F.coalesce("r.id", made_up_id)).alias("review_id"),
        F.coalesce("r.user", F.lit(UNKNOWN)).alias("user_name"),
        F.trim(F.col("r.comment")).alias("content"),
        F.coalesce("r.rate", F.lit(0)).alias("score"),
        F.coalesce("r.date", F.lit(UNKNOWN)).alias("full_date"),
        F.coalesce("r.date", F.lit(UNKNOWN)).alias("date"),
        F.lit(NATIVE_TIME).alias("time"),
        F.coalesce("r.appVersion", F.lit(UNKNOWN)).alias("app_version"),
        F.col("r.reply").alias("developer_reply"),
        F.col("_app").alias("app_label"),
        F.lit("fa").alias("lang"),
    )


def normalise_review(df: DataFrame, ts: str = "at", title: str | None = None, ios: bool = False) -> DataFrame:
    """Store rows to the review contract: date and time split from the timestamp, defaults for missing fields.

    With ``ios`` the id is made of user and second, and ``title`` is put before the text.
    """
    at = F.col(ts).cast("timestamp")
    user = F.coalesce("user_name", F.lit(UNKNOWN))
    content = F.col("content")
    if title:
        content = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit(""))))
    made_id = F.concat_ws("_", F.lit("ios"), F.coalesce("user_name", F.lit("user")), F.date_format(at, "yyyyMMddHHmmss"))
    return df.select(
        (made_id if ios else F.col("review_id")).alias("review_id"),
        user.alias("user_name"),
        content.alias("content"),
        F.coalesce(F.col("score").cast("int"), F.lit(0)).alias("score"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("full_date"),
        F.date_format(at, "yyyy-MM-dd").alias("date"),
        F.date_format(at, "HH:mm:ss").alias("time"),
        F.coalesce("app_version", F.lit(UNKNOWN)).alias("app_version"),
        F.col("developer_reply"),
        F.col("app_label"),
        F.col("lang"),
    )


def read_lexicon(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """An ordered lexicon from a CSV file with the columns priority, label and word; it becomes part of the plan."""
    rows = (
        spark.read.option("header", True).schema("priority int, label string, word string").csv(path)
        .orderBy("priority", "label", "word").collect()
    )
    lexicon: dict[str, list[str]] = {}
    for row in rows:
        lexicon.setdefault(row.label, []).append(row.word)
    return lexicon


def load_embeddings(spark: SparkSession, path: str, schema: str = "vec_id bigint, embedding array<float>") -> DataFrame:
    return spark.read.schema(schema).parquet(path)


