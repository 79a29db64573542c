"""Rows of a table in the order of an integer id, cut into balanced ranges without a pass over the texts."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import col, fresh


def ordered_ranges(df: DataFrame, key: str, text: str, ranges: int) -> tuple[DataFrame, str, int]:
    """Add the number of the range that holds each row; ranges ascend with ``key``, null keys come last.

    The cuts are quantiles of the key column alone. A key that spans several quantiles gets as many ranges, and its rows
    go to them by a hash of their text; so rows with equal ids have an order fixed by their texts.
    """
    number, position = fresh(df, "_range", "_split")
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = df.agg(F.percentile_approx(col(key), shares, 20 * max(ranges, 50)).alias("c")).first()["c"] or []
    width: dict[float, int] = {}
    value: dict[float, int] = {}
    for cut in cuts:
        width[float(cut)] = width.get(float(cut), 0) + 1
        value.setdefault(float(cut), cut)
    edges = sorted(width)
    if not edges:
        return df.withColumn(number, F.lit(0)), number, 1
    as_double = F.when(col(key).isNull(), F.lit(float("nan"))).otherwise(col(key).cast("double"))
    split = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=position, outputCol=number,
                       handleInvalid="keep")
    df = split.transform(df.withColumn(position, as_double))
    # range 0 lies below the first edge; edge e opens width[e] ranges
    first, many, opens = [0], [1], [None]
    for e in edges:
        first.append(first[-1] + many[-1])
        many.append(width[e])
        opens.append(value[e])
    total = first[-1] + many[-1]
    first.append(total - 1)  # null keys: after all others in the last range
    many.append(1)
    opens.append(None)
    at = col(number).cast("int")
    if max(width.values()) == 1:  # no key fills a range; keeps the texts out of the plan
        number_of = F.when(at == len(edges) + 1, F.lit(len(edges))).otherwise(at)
        return df.withColumn(number, number_of).drop(position), number, total
    look = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), at + 1)
    many_here = look(many, "int")
    inside = F.when(many_here == 1, F.lit(0)).when(
        col(key) == look(opens, "bigint"), F.pmod(F.xxhash64(col(text)), many_here).cast("int")
    ).otherwise(many_here - 1)
    return df.withColumn(number, look(first, "int") + inside).drop(position), number, total


def in_order(df: DataFrame, key: str, text: str, ranges: int) -> tuple[DataFrame, str, int]:
    """One partition per range, each sorted; the range number stays in the named column."""
    df, number, total = ordered_ranges(df, key, text, ranges)
    dealt = df.repartitionById(total, col(number))
    return dealt.sortWithinPartitions(col(number), col(key).asc_nulls_last(), F.xxhash64(col(text))), number, total
