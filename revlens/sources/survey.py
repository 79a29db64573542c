"""Agreement-scale surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions.text import likert_recode
from revlens.operators.stats import cronbach_alpha
from revlens.sources.records import whole_records


def read_survey(spark: SparkSession, path: str, is_note: Column | None = None, skip: int = 2) -> DataFrame:
    """A survey export without its leading note rows.

    ``is_note`` marks them where the export has a marker. Otherwise the first ``skip`` data rows of the file go,
    by position within each file. Large files are read by many tasks, also with line breaks inside answers.
    """
    options = {"escape": '"', "multiLine": "true"}
    names = spark.read.options(header=True, **options).csv(path).columns  # of the first line
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    records = whole_records(spark, path, skip=0 if is_note is not None else skip)
    raw = records.select(F.from_csv("record", fields, options).alias("r")).select("r.*")
    return raw if is_note is None else raw.filter(~F.coalesce(is_note, F.lit(False)))


def recode_survey(df: DataFrame, columns: list[str] | None = None, scale=None) -> DataFrame:
    columns = columns or df.columns
    return df.select(*[likert_recode(F.col(f"`{c}`"), scale).alias(c) for c in columns])


def blocks_by_position(df: DataFrame, blocks: dict[str, tuple[int, int]] | None = None) -> dict[str, list[str]]:
    return {name: df.columns[lo:hi] for name, (lo, hi) in (blocks or lx.SURVEY_BLOCKS).items()}


def survey_reliability(df: DataFrame, blocks: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    named = blocks_by_position(df, blocks)
    items = list(dict.fromkeys(c for cols in named.values() for c in cols))
    return cronbach_alpha(recode_survey(df, items), named)
