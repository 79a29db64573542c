"""Resumable review feeds.

The feed arrives newest first, so no event-time watermark is set: it would drop almost every later batch. What was seen
is looked up in the sink, and no query keeps state. Ids are looked up in all of it, since an edited review comes again with
a date in another month; only the key column is read for that.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from revlens.functions.dates import month_key
from revlens.operators import ingest as ig
from revlens.operators.ranking import first_per_key


def review_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_ingest(
    feed: DataFrame, sink: str, checkpoint: str, spine: list[str] | None = None, key: str = "review_id",
    date: str = "date", ts: str = "full_date",
) -> StreamingQuery:
    """Append every new review once; the stored row wins. Reviews of months outside ``spine`` stay out.

    Without ``spine``, reviews with an unreadable date are kept too, in the partition of a null month.
    """
    return _append(feed, sink, checkpoint, spine, key, date, ts, lambda stored, fresh: fresh)


def stream_quota(
    feed: DataFrame, sink: str, checkpoint: str, spine: list[str], target: ig.Target, group: list[str] | None = None,
    key: str = "review_id", date: str = "date", ts: str = "full_date",
) -> StreamingQuery:
    """Admit reviews up to the quota of their group and month, counting what the sink holds, whoever wrote it.

    The sink holds at most the quota per group and month, which bounds both lookups.
    """
    group, order = group or ig.GROUP, ig.newest_first(ts, key)

    def admit(stored: DataFrame, fresh: DataFrame) -> DataFrame:
        return ig.quota_resume(stored, fresh, spine, target, group, date, order)

    return _append(feed, sink, checkpoint, spine, key, date, ts, admit)


def _append(feed, sink, checkpoint, spine, key, date, ts, admit) -> StreamingQuery:
    """Write what ``admit(stored, fresh)`` returns for every batch.

    A batch owns the directories month=/run=/batch=, where the run is the id that Spark keeps in the checkpoint. It
    overwrites only those, and counts all others as stored. A replayed batch so gives the same rows again, and a new
    checkpoint on a filled sink adds to it.
    """
    schema = feed.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        rows = batch.withColumn("month", month_key(F.col(date)))
        if spine is not None:
            rows = rows.filter(F.col("month").isin(spine))
        rows = first_per_key(rows, [key], [F.col(ts).desc()])
        others = ~((F.col("run") == run) & (F.col("batch") == batch_id))
        seen = read_sink(spark, sink, schema).filter(others).select(key)
        fresh = rows.join(seen, key, "left_anti")
        admitted = admit(read_sink(spark, sink, schema, spine).filter(others), fresh).withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        writer = admitted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("month", "run", "batch").parquet(sink)

    return (
        feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; it outlives restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def read_sink(spark: SparkSession, sink: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame:
    """Everything admitted so far, or in the listed months only; an empty table before the first batch."""
    parts = ("month", "run", "batch")
    full = T.StructType([f for f in schema.fields if f.name not in parts])
    full = full.add("month", T.StringType()).add("run", T.StringType()).add("batch", T.LongType())
    found = []
    for path in [sink] if months is None else [f"{sink}/month={m}" for m in months]:
        try:
            found.append(spark.read.schema(full).option("basePath", sink).parquet(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return spark.createDataFrame([], full)
    return reduce(DataFrame.unionByName, found)


def monthly_counts_stream(feed: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Running review count and mean stars per key and month, for update or complete output."""
    month = F.date_trunc("month", F.col(date).cast("timestamp")).alias("month_start")
    return feed.groupBy(*keys, month).agg(F.count("*").alias("reviews"), F.avg("score").alias("mean_score"))
