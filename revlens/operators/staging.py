"""Plan shaping shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, parts: int | None, key: str) -> DataFrame:
    """Deal rows to ``parts`` tasks before costly work on them, for files of few row groups, which few tasks read.

    Without a number the rows stay where they are read.
    """
    return df if parts is None else df.repartition(parts, key)


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters and projections reuse their values.

    Catalyst moves a filter below the projection that computes its column and repeats the expression there,
    and inlines single references. A one-row generator stays where it is, so each expression runs once per row.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(row)))

