"""Small tables with the awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest
from pyspark.sql import Row

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_tokens int, s string, "
          "`_size` int, `a.b` string, kept string")
WORDS = "the of and to in river stone light winter garden letter window music paper road house water tree bird cloud".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) + r.choice(["", "s", "ing", str(r.randint(0, 99))]) for _ in range(n))


def rows(seed: int = 0, n: int = 40) -> list[tuple]:
    r = random.Random(seed)
    out = [(i, prose(seed * 1000 + i, r.randint(20, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for i in range(n)]
    out += [(n, None, "en", "a"), (n + 1, "", "de", "b"), (n + 2, " \n\t ", None, None), (n + 3, "one", "en", "a"),
            (None, prose(7, 30), "en", None), (None, None, None, None), (n + 4, out[3][1], "en", "c"), out[5], out[5],
            (n + 5, prose(99, 20_000), "en", "a"), (n + 6, "éß 日本 <|endoftext|> I'll İ", "fr", "b")]
    base = prose(12345, 200).split()
    out.append((n + 7, " ".join(base), "en", "a"))
    base[100] = "changed"
    out.append((n + 8, " ".join(base), "en", "b"))
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*d, len(d[1] or ""), 0.5, 1, "x", 2, "y", "z") for d in data], SCHEMA)


def plain(spark, data=None):
    return table(spark, data).select("doc_id", "text", "lang", "source", "n_chars")


def folder(spark, path, data, labelled=()):
    """A folder with documents and labels, as the queries read it."""
    plain(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([Row(*x) for x in labelled], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture
def docs(spark):
    return table(spark)
