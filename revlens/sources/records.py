"""Whole CSV records of large files, read by many tasks, also where a quoted field runs over several lines.

A task sees a stretch of a file. Whether the stretch begins inside quotes depends on the number of quotes before it, so a
first pass counts the quotes of every stretch, and their running sum in the file tells each stretch how it begins. The second
pass joins the lines of a record within its stretch. What crosses a border, at most one piece at each end of a stretch, is put
together from both sides; no other line leaves its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD, OPEN, MIDDLE, CLOSE = "record", "open", "middle", "close"


def lines_of(spark: SparkSession, paths: str | list[str], tolerant: bool = False) -> DataFrame:
    """(value, file, block): lines with the file and the start of the stretch that they begin in."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("ignoreCorruptFiles", tolerant)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def starts_inside(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each stretch begins inside quotes: one entry per stretch, of 128 MB unless set otherwise."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return {(r["file"], r["block"]): r["odd"] for r in counts.select("file", "block", (before % 2 == 1).alias("odd")).collect()}


def joined_lines(batches, inside: dict[tuple[str, int], bool], skip: int = 0):
    """(file, block, kind, record) from lines in order, without a file's header and the ``skip`` records below it."""
    key, odd, left, kind, pending = None, False, 0, RECORD, []  # left: records to leave out

    def rows(kinds, records):
        n = len(records)
        records = records if isinstance(records, (pa.Array, pa.ChunkedArray)) else pa.array(records, pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.string()), records],
            names=["file", "block", "kind", "record"])

    def left_over():
        if left and (key[0], True) in later:
            raise ValueError("a file's header and notes must lie in its first stretch")
        if pending:
            yield rows([MIDDLE if kind == CLOSE else OPEN], ["\n".join(pending)])

    later = {(file, True) for file, block in inside if block}
    for batch in batches:
        values, files, blocks = (batch.column(i) for i in range(3))
        names, places = files.to_pylist(), blocks.to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if places[i] != places[i - 1] or names[i] != names[i - 1]), len(names)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if (names[start], places[start]) != key:
                yield from left_over()
                key, pending = (names[start], places[start]), []
                if key not in inside:
                    raise ValueError("the files or the size of their stretches changed since their quotes were counted")
                odd, left = inside[key], 0 if key[1] else skip + 1
                kind = CLOSE if odd else RECORD
            part = values.slice(start, end - start)
            parity = pc.count_substring(part, '"').to_numpy(zero_copy_only=False) & 1
            if not odd and not parity.any():  # no record runs over a line
                out = min(left, len(part))
                yield rows([RECORD] * (len(part) - out), part.slice(out))
                left -= out
                continue
            kinds, records = [], []
            for line, ends_odd in zip(part.to_pylist(), (int(odd) + np.cumsum(parity)) & 1):
                pending.append(line)
                if not ends_odd:
                    if left:
                        left -= 1
                    else:
                        kinds.append(kind)
                        records.append("\n".join(pending))
                    kind, pending = RECORD, []
            odd = bool((int(odd) + parity.sum()) & 1)
            yield rows(kinds, records)
    if key is not None:
        yield from left_over()


def whole_records(spark: SparkSession, paths: str | list[str], tolerant: bool = False, skip: int = 0) -> DataFrame:
    """(file, record): every record of the files below their headers and ``skip`` more, without its line end."""
    lines = lines_of(spark, paths, tolerant)
    inside = starts_inside(lines)
    shared = spark.sparkContext.broadcast(inside)

    def task(batches):
        yield from joined_lines(batches, shared.value, skip)

    pieces = lines.mapInArrow(task, "file string, block bigint, kind string, record string")
    out = pieces.filter(F.col("kind") == RECORD).select("file", "record")
    if any(inside.values()):  # a record runs over the border of two stretches
        cut = pieces.filter(F.col("kind") != RECORD)
        # a stretch closes the record before it, then opens its own
        order = F.struct("block", F.col("kind") == OPEN)
        number = F.count_if(F.col("kind") == OPEN).over(Window.partitionBy("file").orderBy("block", F.col("kind") == OPEN))
        cut = cut.withColumn("number", number).groupBy("file", "number").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "record"))), lambda x: x["record"]), "\n").alias("record"))
        out = out.unionByName(cut.select("file", "record"))
    record = F.regexp_replace("record", "\\r$", "")
    return out.select("file", record.alias("record")).filter(F.btrim("record") != "")
