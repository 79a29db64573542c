"""Extendible hashing: shards are hash-prefix buckets, and only a bucket beyond the byte limit splits on another bit.

Bytes are counted once per prefix of fixed length; the directory is worked out from that table, a few cells per shard.
Cells that are still too large count their own rows again with more bits, until every bucket fits. A bucket whose rows
all have one hash cannot split: it overflows into pages, each of which fits. A document above the limit is alone on its
page. Null and empty texts have no bytes; rows with null ids share one hash; repeated rows stay separate rows. An empty
table has no shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import col, documents, fresh, staged
from revlens.session import scratch_path

HASH_BITS = 60
SPARE_BITS = 4  # bits of the first table beyond an even split, and of each further one
SHARD_BYTES = 1 << 24


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def prefix(hashed: str, bits: Column | int) -> Column:
    return F.expr(f"shiftright({hashed}, {HASH_BITS} - {bits})") if isinstance(bits, int) else F.call_function(
        "shiftright", F.col(hashed), F.lit(HASH_BITS) - bits)


def leaves(cells: DataFrame, bits: int, above: int, limit: int) -> DataFrame:
    """Depth of the bucket that holds each cell of ``bits`` bits; null where it must split further.

    ``cells``: cell, bytes, rows, low, high (least and greatest hash). Depths from ``above`` on are tried.
    """
    depth = F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")
    tried = cells.select("*", depth).withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")))
    buckets = tried.groupBy("depth", "bucket").agg(F.sum("bytes").alias("b"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    fits = (F.col("b") <= limit) | (F.col("lo") == F.col("hi"))
    buckets = buckets.filter(fits).select(F.col("depth").alias("d"), "bucket")
    found = tried.join(buckets, (F.col("depth") == F.col("d")) & (tried["bucket"] == buckets["bucket"]), "left")
    return found.groupBy("cell").agg(F.min("d").alias("depth"), F.max("bytes").alias("bytes"))


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """(bits, (c, d)) per table of cells: the depth of the bucket that holds each cell. ``rows``: h, n_bytes, staged."""
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits, above = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS), 0
    out, open_rows = [], rows
    while True:
        cells = open_rows.groupBy(prefix("h", bits).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        found = staged(leaves(staged(cells, "shard-cells"), bits, above, limit), "shard-depths")
        out.append((bits, found.filter("depth IS NOT NULL").select(F.col("cell").alias("c"), F.col("depth").cast("int").alias("d"))))
        split = found.filter("depth IS NULL")
        if bits == HASH_BITS or split.isEmpty():
            return out
        open_rows = open_rows.join(split.select(F.col("cell").alias("c")), prefix("h", bits) == F.col("c"), "left_semi")
        above, bits = bits, min(HASH_BITS, bits + SPARE_BITS)


def placed(rows: DataFrame, sizes: DataFrame, limit: int, names: list[str]) -> DataFrame:
    """Append depth, prefix and page to each of ``rows``. ``names``: of its hash and bytes, and of the new columns.

    ``sizes`` has the same hashes and bytes as h and n_bytes, staged. Rows meet the small directory by their own hash, so
    rows that repeat an id stay as many as they are.
    """
    h, n_bytes, depth, start, page = names
    cell, deep = fresh(rows, "_cell", "_deep")
    rows = rows.withColumn(depth, F.lit(None).cast("int"))
    for bits, known in directory(sizes, limit):
        known = known.select(F.col("c").alias(cell), F.col("d").alias(deep))
        rows = rows.join(known, prefix(h, bits) == col(cell), "left").withColumn(depth, F.coalesce(col(depth), col(deep))).drop(cell, deep)
    rows = rows.withColumn(start, F.call_function("shiftright", col(h), F.lit(HASH_BITS) - col(depth)))
    return overflow(rows, sizes, limit, h, n_bytes, page)


def overflow(rows: DataFrame, sizes: DataFrame, limit: int, h: str, n_bytes: str, page: str) -> DataFrame:
    """Number the pages of buckets that hold one hash and more bytes than fit; all other rows are on page 0.

    Rows of such a bucket are laid end to end, part by part of the stored table, so no task holds all of a hot id. A page
    is the stretch in which a row starts, short enough for the longest row to end within the limit.
    """
    large = sizes.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("longest"), F.count("*").alias("n"))
    x, longest, part, at, y, p, before, inside = fresh(rows, "_x", "_longest", "_part", "_at", "_y", "_p", "_before", "_inside")
    large = large.filter((F.col("b") > limit) & (F.col("n") > 1)).select(F.col("h").alias(x), F.col("longest").alias(longest))
    large = staged(large, "shard-overflow")
    if large.isEmpty():
        return rows.withColumn(page, F.lit(0).cast("bigint"))
    plain = rows.join(large, col(h) == col(x), "left_anti").withColumn(page, F.lit(0).cast("bigint"))
    hot = rows.join(large, col(h) == col(x)).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    hot = staged(hot, "shard-hot")
    sums = hot.groupBy(col(x).alias(y), col(part).alias(p)).agg(F.sum(col(n_bytes)).alias("n"))
    sums = sums.select(y, p, (F.sum("n").over(W.partitionBy(y).orderBy(p)) - F.col("n")).alias(before))
    hot = hot.withColumn(inside, F.sum(col(n_bytes)).over(W.partitionBy(x, part).orderBy(at)) - col(n_bytes))
    hot = hot.join(sums, (col(x) == col(y)) & (col(part) == col(p)))
    stretch = F.greatest(F.lit(limit) - col(longest), F.lit(1))
    hot = hot.withColumn(page, F.floor((col(before) + col(inside)) / stretch))
    keep = [col(c) for c in [*rows.columns, page]]
    return plain.select(keep).unionByName(hot.select(keep))


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, depth, prefix, page) of every row; a shard is (depth, prefix, page)."""
    rows = staged(docs.select(col(key).alias("id"), hash60(col(key)).alias("h"), text_bytes(text).alias("n_bytes")), "shard-rows")
    out = placed(rows, rows, limit, ["h", "n_bytes", "depth", "prefix", "page"])
    return out.select(F.col("id").alias(key), "n_bytes", "depth", "prefix", "page")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> list[str]:
    """Write the rows to ``path``, one folder per shard; returns the names of the columns that folders stand for.

    There are as many tasks as shards half full would hold the bytes, so a task's share stays the same as tables grow.
    """
    names = fresh(docs, "_h", "_bytes", "_depth", "_prefix", "_page")
    sizes = staged(docs.select(hash60(col(key)).alias("h"), text_bytes(text).alias("n_bytes")), "shard-rows")
    rows = docs.withColumn(names[0], hash60(col(key))).withColumn(names[1], text_bytes(text))
    rows = placed(rows, sizes, limit, names).drop(*names[:2])
    held = sizes.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    rows.repartition(max(1, math.ceil(2 * held / limit)), *[col(n) for n in names[2:]]).write.partitionBy(*names[2:]).parquet(path)
    return names[2:]


def op6_extendible_shards(spark, folder):
    """Writes the shards and tells from the files what each of them holds."""
    docs, path = documents(spark, folder), scratch_path(spark, "shards")
    depth, start, page = write_shards(docs, path)
    schema = T.StructType([*docs.schema.fields, T.StructField(depth, T.IntegerType()), T.StructField(start, T.LongType()),
                           T.StructField(page, T.LongType())])
    held = spark.read.schema(schema).parquet(path)
    return held.select("doc_id", text_bytes("text").alias("n_bytes"), col(depth).alias("depth"), col(start).alias("prefix"), col(page).alias("page"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT d.*, r.depth::INTEGER AS depth, h >> ({HASH_BITS} - r.depth) AS prefix FROM d, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth) r),
b AS (SELECT depth, prefix FROM p GROUP BY depth, prefix HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h))
SELECT doc_id, n_bytes, depth, prefix, 0::BIGINT AS page
FROM p JOIN b USING (depth, prefix)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
