"""Helpers shared by the operators: reading, per-task text functions, ordered buckets, staged tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revlens.session import materialised

#: Word separators of the contracts: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that one Python call handles at a time; one longer document makes a slice of its own.
SLICE_CHARS = 1_000_000


#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 rows would hold tens of megabytes in every task and
#: worker, besides what the executor needs itself.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; results do not depend on it."""
    if not 0 < int(spark.conf.get(BATCH_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file: the installed package, else the folder named by TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
    return public_tokenizers.path(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """Column by its literal name, also with dots or spaces in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the Python copies of its texts stay small."""
    sizes = pc.utf8_length(batch.column(text_at)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, fields: list[tuple[str, str]], make: Callable[[], Callable],
              also: tuple[str, ...] = ()) -> DataFrame:
    """Append columns that are computed from one text column, in Arrow batches without a shuffle.

    ``make()`` runs once per task and gives a function from a list of texts (None where null), and one more list for each
    column in ``also``, to one sequence or Arrow array per field. All columns of ``df`` stay; ``fields`` must have new
    names.
    """
    small_batches(df.sparkSession)
    at, more = df.columns.index(text), [df.columns.index(c) for c in also]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # mapInArrow looks columns up by name, dots or not
    new = T.StructType.fromDDL(", ".join(f"n{i} {kind}" for i, (_, kind) in enumerate(fields)))
    schema = T.StructType([*plain.schema.fields, *new.fields])
    arrow = to_arrow_schema(schema)

    def task(batches):
        with held_by_this_task():
            work = make()
        for batch in batches:
            for part in text_slices(batch, at):
                made = work(part.column(at).to_pylist(), *(part.column(i).to_pylist() for i in more))
                new = [
                    x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type)
                    for x, f in zip(made, list(arrow)[len(part.columns):], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(c.cast(f.type) if c.type != f.type else c for c, f in zip(part.columns, arrow)), *new],
                    schema=arrow)

    return plain.mapInArrow(task, schema).toDF(*df.columns, *[name for name, _ in fields])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cut lineage that outlives executors."""
    return materialised(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict = {}  # of a worker process


def held(kind: str, path: str, make: Callable):
    """An instance that outlives the task in its worker process, with what it remembers; there is one at a time."""
    if (kind, path) not in _HELD:
        _HELD.clear()
        _HELD[kind, path] = make()
    _HELD["used"] = True
    return _HELD[kind, path]


@contextmanager
def held_by_this_task():
    """Let go of an earlier task's instance if the block does not ask for it."""
    _HELD.pop("used", None)
    yield
    if "used" not in _HELD:
        _HELD.clear()


class Kept:
    """A dictionary of bounded size: the older half goes when the younger half is full."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys) -> list:
        """The keys that are not held; held keys move to the younger half."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        """Call between slices only: what a slice has put in stays until the slice is done."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
