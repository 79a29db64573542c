"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document (up to ``max_repeats`` of each) has a virtual finish time: the words its source has queued up to
and with it, in shuffled order and one pass after the other, divided by the source's target. Copies are served in the
order of their finish times until the next one would exceed the total budget.

No step orders all rows, or all rows of a source, in one task. Running sums inside a source are taken within ranges of
the shuffle key and shifted by the ranges' totals. The place of the cut is found by two histograms of finish times, so
only the copies of one bin of the finer one are sorted. Within a source a pass is served in shuffled order, hence the
whole decision is one cut per source and pass, and texts join a table of one row per source without a shuffle.

Null texts have no words, null sources form one source, which comes last. Empty texts take no budget. Rows that tie in
shuffle key, id and size are served together. If no text has a word, targets are 0 and nothing is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.llm.common import WORD, col, documents, fresh, staged

ROWS_A_RANGE = 20_000
COARSE, FINE = 64, 4096  # bins per unit of finish time, and per coarse bin


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Rank, weight (1, 2, 3, repeating) and target of each source of (source, source_size).

    A target of more than ``max_repeats`` times its source stops there. Ordered by size for weight, the sources that stop
    are the first ones, so running sums give the common level of the others without a loop.
    """
    number = lambda c: c.cast("decimal(38,0)")
    by_rank, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    df = sizes.withColumn("rank", F.row_number().over(by_rank)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    df = df.withColumn("most", max_repeats * F.col("source_size"))
    df = df.withColumn("budget", F.sum("source_size").over(all_rows))
    upto = W.orderBy(F.col("most").cast("double") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("left", F.col("budget") - F.sum("most").over(upto) + F.col("most"))
    df = df.withColumn("weights", F.sum("weight").over(all_rows) - F.sum("weight").over(upto) + F.col("weight"))
    df = df.withColumn("stops", number(F.col("most")) * number(F.col("weights")) < number(F.col("weight")) * number(F.col("left")))
    df = df.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(all_rows))
    df = df.withColumn("open", F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(all_rows))
    share = (F.col("weight") * F.col("rest")).cast("double") / F.col("open").cast("double")
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(share)
    return df.select("source", "source_size", "rank", "weight", target.alias("target"))


def queue_cuts(queue: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Per source: source_size, target, and ``cuts``, the last place served in each pass (null if none).

    ``queue`` has (id, source, size); a place is (shuffle key, id, size).
    """
    spark = queue.sparkSession
    rows = staged(queue.select("id", "source", "size", shuffle_key(F.col("id")).alias("k")), "mix-queue")
    targets = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats), "mix-targets")
    total = targets.agg(F.sum("source_size").alias("b")).first()["b"] or 0
    bits = max(0, math.ceil(math.log2(max(rows.count(), 1) / ROWS_A_RANGE)))
    part = F.shiftright(F.conv(F.substring("k", 1, 8), 16, 10).cast("bigint"), 32 - min(bits, 32))
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
    before = F.sum("in_part").over(W.partitionBy("source").orderBy("part")) - F.col("in_part")
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), before.alias("before"))
    inside = F.sum("size").over(W.partitionBy("source", "part").orderBy("k", "id", "size"))
    rows = rows.withColumn("inside", inside)
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["part"] == sums["p"]))
    rows = rows.select("id", "source", "size", "k", (F.col("before") + F.col("inside")).alias("sum"))
    t = targets.select(F.col("source").alias("s"), "rank", "target", "source_size")
    rows = rows.join(t, rows["source"].eqNullSafe(t["s"])).drop("s").filter("target > 0")
    times = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)),
                        lambda e: F.struct(((e * F.col("source_size") + F.col("sum")).cast("double") / F.col("target")).alias("time"),
                                           e.alias("turn")))
    rows = staged(rows.select("source", "rank", "k", "id", "size", times.alias("times")), "mix-times")

    copies = rows.select("source", "rank", "k", "id", "size", F.inline("times"))
    copies = copies.withColumn("coarse", F.floor(F.col("time") * COARSE))
    copies = copies.withColumn("fine", F.floor((F.col("time") * COARSE - F.col("coarse")) * FINE))

    def bin_of_cut(bins: DataFrame, name: str, budget: int) -> tuple[int, int] | None:
        """The first bin whose end lies beyond the budget, and the words before it."""
        summed = bins.groupBy(name).agg(F.sum("size").alias("n"))
        ends = summed.withColumn("end", F.sum("n").over(W.orderBy(name)))
        found = ends.filter(F.col("end") > budget).agg(F.min(F.struct(name, (F.col("end") - F.col("n")).alias("b"))).alias("x"))
        cut = found.first()["x"]
        return None if cut is None else (cut[name], cut["b"])

    place = F.struct("time", "rank", "k", "id", "size", "turn")
    served = F.lit(True)
    if (coarse := bin_of_cut(copies, "coarse", total)) is not None:
        in_coarse = copies.filter(F.col("coarse") == coarse[0])
        fine = bin_of_cut(in_coarse, "fine", total - coarse[1])
        left = total - coarse[1] - fine[1]
        order = W.orderBy("time", "rank", "k", "id", "size", "turn")
        ends = in_coarse.filter(F.col("fine") == fine[0]).withColumn("end", F.sum("size").over(order))
        last = ends.filter(F.col("end") <= left).agg(F.max(place).alias("last"))
        copies = copies.crossJoin(F.broadcast(last))  # one row
        at_cut = F.coalesce(place <= F.col("last"), F.lit(False))
        served = (F.col("coarse") < coarse[0]) | ((F.col("coarse") == coarse[0]) & (
            (F.col("fine") < fine[0]) | ((F.col("fine") == fine[0]) & at_cut)))
    last_served = [F.max(F.when(served & (F.col("turn") == e), F.struct("k", "id", "size"))).alias(f"cut{e}")
                   for e in range(max_repeats)]
    cuts = copies.groupBy("source").agg(*last_served).withColumnRenamed("source", "s")
    out = targets.join(cuts, targets["source"].eqNullSafe(cuts["s"]), "left")
    out = out.select("source", "source_size", "target", F.array(*[f"cut{e}" for e in range(max_repeats)]).alias("cuts"))
    return staged(out, "mix-cuts")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_repeats: int = 3,
        names=("size", "source_size", "target", "turns")) -> DataFrame:
    """Append each row's size, its source's size and target, and how many times the mix takes the row."""
    queue = docs.select(col(key).alias("id"), col(source).alias("source"), word_count(col(text)).alias("size"))
    cuts = queue_cuts(queue, max_repeats)
    z, s, n, t, c = fresh(docs, "_size", "_source", "_source_size", "_target", "_cuts")
    cuts = cuts.select(F.col("source").alias(s), F.col("source_size").alias(n), F.col("target").alias(t), F.col("cuts").alias(c))
    out = docs.withColumn(z, word_count(col(text))).join(cuts, col(source).eqNullSafe(F.col(s)))
    here = F.struct(shuffle_key(col(key)).alias("k"), col(key).alias("id"), col(z).alias("size"))
    turns = F.size(F.filter(F.col(c), lambda cut: cut.isNotNull() & (here <= cut)))
    made = zip(names, (col(z), F.col(n), F.col(t), turns), strict=True)
    return out.select(*[col(x) for x in docs.columns if x not in names], *[x.alias(name) for name, x in made])


def mixed_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of ``docs``."""
    names = fresh(docs, "_size", "_source_size", "_target", "_turns")
    turn, = fresh(docs, "_turn")
    out = mix(docs, key, source, text, names=names).filter(col(names[3]) > 0)
    out = out.withColumn(turn, F.explode(F.sequence(F.lit(1), col(names[3]))))
    return out.select(*[col(c) for c in docs.columns])


def op7_fair_mix(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source", "text")
    taken = (F.col("turns") * F.col("size")).cast("bigint")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most,
         sum(source_size) OVER ()::BIGINT AS budget
  FROM s),
l AS (
  SELECT *, budget - sum(most) OVER o + most AS left_, sum(weight) OVER () - sum(weight) OVER o + weight AS weights
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, rank ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, most::HUGEINT * weights < weight::HUGEINT * left_ AS stops FROM l),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN stops THEN most::DOUBLE
              ELSE (weight * (budget - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ()))::DOUBLE
                   / (sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target,
         budget
  FROM c),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size) AS queued FROM d),
x AS (
  SELECT q.doc_id, q.k, q.size, t.rank, t.budget, e.turn, (e.turn * t.source_size + q.queued)::DOUBLE / t.target AS time
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS turn) e WHERE t.target > 0),
y AS (SELECT *, sum(size) OVER (ORDER BY time, rank, k, doc_id, size, turn) AS taken_by_then FROM x),
z AS (SELECT doc_id, k, rank, size, count(*) AS turns FROM y WHERE taken_by_then <= budget GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(z.turns, 0) * d.size)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN z ON z.k = d.k AND z.rank = t.rank AND z.size = d.size AND z.doc_id IS NOT DISTINCT FROM d.doc_id
"""
