"""Writing stages, reports and models."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition: str | None = "ecosystem", file_rows: int = 2_000_000) -> None:
    """Write a stage as Parquet, one directory per ecosystem, to a new path.

    Files are cut by row count, so one huge ecosystem becomes many files and no shuffle is needed.
    """
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", file_rows)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write review CSV files that ``read_reviews`` reads back unchanged."""
    writer = (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", None)
    )
    (writer.partitionBy(partition) if partition else writer).csv(path)


def write_report(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a report table as CSV: one file, gathered by one last task, or with ``single_file=False`` one per partition."""
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def ecosystem_split(parts: list[DataFrame], ecosystem: Column) -> DataFrame:
    """All parts as one table tagged with its ecosystem, ready for ``write_stage``."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("ecosystem", ecosystem)


def balance_classes(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Optional: thin larger classes to about the size of the smallest by a hash of the key."""
    counts = df.dropna(subset=[label]).groupBy(label).agg(F.count("*").alias("_n"))
    share = counts.select(label, (F.min("_n").over(Window.partitionBy()) / F.col("_n")).alias("_share"))  # one row per class
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2**32)
    return df.join(share, label).filter(draw < F.col("_share")).drop("_share")


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
