"""Top-n and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts per key of the two cuts that come first for a large n.
SALTS = (65536, 256)


def _numbered(df: DataFrame, keys: list, order: list[Column], n: int, out: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: tuple[int, ...] = (),
    out: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each key in a total order.

    Spark cuts each key to ``n`` rows before the shuffle as long as ``n`` is within its group limit (1000, or the
    setting spark.sql.optimizer.windowGroupLimitThreshold). For a larger ``n`` state ``salts``, such as ``SALTS``: the
    same cut is then made within ever fewer parts of the key first, which is exact, as a row among the first ``n`` of
    its key is among the first ``n`` of its part. The second level keeps the last one from collecting ``n`` rows of
    every first part in one task.
    """
    rank = out or "_rank"
    if salts:
        # The input partition as salt: balanced whatever the rows hold, and the same when a task is retried.
        df = df.withColumn("_salt", F.spark_partition_id())
        for parts in salts:
            salted = df.withColumn("_salt", F.pmod(F.col("_salt"), F.lit(parts)))
            df = _numbered(salted, [*keys, "_salt"], order, n, "_part_rank").drop("_part_rank")
        df = df.drop("_salt")
    ranked = _numbered(df, keys, order, n, rank)
    return ranked if out else ranked.drop(rank)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep-first deduplication in a stated order; copies are dropped before the shuffle."""
    return top_n_per_key(df, keys, order, 1)


def _hash_key(key: str, seed) -> Column:
    text = F.col(key).cast("string")
    return F.md5(text if seed is None else F.concat_ws(":", text, F.lit(str(seed))))


def _class(label: str | list[str] | None) -> Column:
    if label is None:
        return F.lit(0)
    return F.col(label) if isinstance(label, str) else F.struct(*label)


def class_cuts(df: DataFrame, label: str | list[str] | None, key: str, percents: list[int], seed=None, digits: int = 4) -> DataFrame:
    """Per class, the hash of the last row within each cumulative percentage of the class.

    Ranks by hash are not taken over whole classes: a histogram over hash prefixes, summed before the shuffle,
    finds the one prefix in which each cut falls, and only rows with such a prefix are ranked.
    """
    base = df.select(
        _class(label).alias("_class"), _hash_key(key, seed).alias("_hash")
    ).withColumn("_prefix", F.substring("_hash", 1, digits))
    running = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        base.groupBy("_class", "_prefix")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(Window.partitionBy("_class")))
    )
    wanted = (
        histogram.select("*", F.posexplode(F.array(*[F.lit(p) for p in percents])).alias("cut", "percent"))
        .withColumn("target", F.floor(F.col("total") * F.col("percent") / 100).cast("bigint"))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter((F.col("target") > F.col("before")) & (F.col("target") <= F.col("upto")))
        .select("_class", "_prefix", "cut", (F.col("target") - F.col("before")).alias("nth"))
    )
    places = wanted.groupBy("_class", "_prefix").agg(F.collect_list(F.struct("cut", "nth")).alias("_cuts"))
    # Copies of one key count as one row here, so a much repeated key does not fill a task.
    within = Window.partitionBy("_class", "_prefix").orderBy("_hash")
    ranked = (
        base.join(places, ["_class", "_prefix"])
        .groupBy("_class", "_prefix", "_hash")
        .agg(F.count("*").alias("n"), F.first("_cuts").alias("_cuts"))
        .withColumn("_upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("_class", "_prefix", "_hash", "_upto", F.inline("_cuts").alias("cut", "_nth"))
    )
    # A bare prefix sorts before all hashes that start with it.
    reached = F.when(F.col("_upto") <= F.col("_nth"), F.col("_hash")).otherwise(F.col("_prefix"))
    return ranked.groupBy("_class").agg(
        *[F.max(F.when(F.col("cut") == i, reached)).alias(f"_cut{i}") for i in range(len(percents))]
    )


def hash_split(
    df: DataFrame, key: str, parts: list[tuple[str, int]], label: str | list[str] | None = None, seed=None, out: str = "part",
    digits: int = 4,
) -> DataFrame:
    """Split rows into named parts with exact shares, per class if ``label`` is given; a list, such as the file and the
    score, makes a class of each combination. Rows without a label are dropped.

    ``parts`` lists names with percentages that add up to 100. The last pass over the full rows needs no shuffle:
    a row's part follows from its own hash and its class's cut hashes. There is one row of cuts per class; classes are
    few, as the labels of a model or its files and labels are.
    """
    percents, total = [], 0
    for _, share in parts[:-1]:
        total += share
        percents.append(total)
    if total + parts[-1][1] != 100:
        raise ValueError("shares must add up to 100")
    rows = df if label is None else df.dropna(subset=[label] if isinstance(label, str) else label)
    cuts = class_cuts(rows, label, key, percents, seed, digits)
    rows = rows.withColumn("_class", _class(label)).withColumn("_hash", _hash_key(key, seed))
    joined = rows.join(F.broadcast(cuts), ["_class"], "left")  # one row per class
    chain = None
    for i, (name, _) in enumerate(parts[:-1]):
        test = F.col("_hash") <= F.col(f"_cut{i}")
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    part = chain.otherwise(parts[-1][0])
    return joined.withColumn(out, part).drop("_class", "_hash", *[f"_cut{i}" for i in range(len(percents))])


def sample_n(df: DataFrame, key: str, n: int, seed=None) -> DataFrame:
    """Fixed-size random sample, repeatable: the ``n`` rows with the smallest hash of their key."""
    return df.orderBy(_hash_key(key, seed), F.col(key)).limit(n)
