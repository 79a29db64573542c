"""CSV files with line breaks inside quotes, cut into small stretches, against pandas."""

import csv
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.sources import reviews as src
from revlens.sources.records import whole_records

SCHEMA = "review_id string, content string, score string"


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["review_id", "content", "score"])
        out.writerows(rows)


@pytest.fixture
def small_stretches(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "400")
    yield
    spark.conf.set(name, before)


def got(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    df = src.read_reviews(spark, str(path), schema)
    return df, sorted(tuple("" if v is None else v for v in r[:3]) for r in df.collect())


def by_pandas(*paths):
    frames = [pd.read_csv(p, dtype=str, keep_default_na=False) for p in paths]
    return sorted(tuple(r) for f in frames for r in f.itertuples(index=False))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_pandas_with_many_tasks_per_file(spark, tmp_path, small_stretches, end):
    r = random.Random(1)
    for name in ("a", "b"):
        rows = [(f"{name}{i}", "".join(r.choice(["word ", "\n", '"', ",", "é", "\n\n", "x" * 30]) for _ in range(r.randint(1, 12))) + "z", str(i % 5))
                for i in range(300)]
        write(tmp_path / f"{name}.csv", rows, end)
    df, rows = got(spark, tmp_path)
    assert rows == by_pandas(tmp_path / "a.csv", tmp_path / "b.csv") and len(rows) == 600
    assert df.rdd.getNumPartitions() > 10
    assert {x["_source"]: x["count"] for x in df.groupBy("_source").count().collect()} == {"a": 300, "b": 300}


def test_one_record_over_many_stretches(spark, tmp_path, small_stretches):
    rows = [("1", "short", "5"), ("2", "\n".join(f'line {i} of "many"' for i in range(400)), "4"), ("3", 'end"', "3"), ("4", "a\nb", "2")]
    write(tmp_path / "long.csv", rows)
    df, found = got(spark, tmp_path)
    assert found == sorted(rows) == by_pandas(tmp_path / "long.csv")


def test_blank_lines_header_only_and_no_end_of_line(spark, tmp_path, small_stretches):
    (tmp_path / "x.csv").write_text('review_id,content,score\n\n1,"a\n\nb",5\n\n2,c,4', encoding="utf-8")
    (tmp_path / "y.csv").write_text("review_id,content,score\n", encoding="utf-8")
    (tmp_path / "z.csv").write_text('﻿review_id,content,score\n3,"",1\n', encoding="utf-8")
    assert got(spark, tmp_path)[1] == [("1", "a\n\nb", "5"), ("2", "c", "4"), ("3", "", "1")]


def test_other_stretches_than_were_counted_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", [(str(i), "text\nmore", "1") for i in range(200)])
    df = whole_records(spark, str(tmp_path))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        with pytest.raises(Exception, match="changed since"):
            df.agg(F.count("*")).collect()
    finally:
        spark.conf.set(name, before)
    assert whole_records(spark, str(tmp_path)).count() == 200


def test_notes_below_the_header(spark, tmp_path, small_stretches):
    rows = [("note", "two\nlines", ""), ("note", "", "")] + [(str(i), "text " * 5, "1") for i in range(60)]
    write(tmp_path / "a.csv", rows)
    assert whole_records(spark, str(tmp_path), skip=2).count() == 60
    write(tmp_path / "b.csv", [("note", "long " * 50, "")] * 3)
    with pytest.raises(Exception, match="must lie in its first stretch"):
        whole_records(spark, str(tmp_path / "b.csv"), skip=3).collect()
