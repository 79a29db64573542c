"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation over the rows of a table.

Entries become whole numbers x (``to_grid``), so n, the sums S and the centred rows (n x - S) / n are exact up to one
rounding; large common offsets cost no digits. The fit list holds each distinct vector once, as blocks of rows in the
shared folder.

A step is one pass over the blocks: u = X v on the rows, freed of all earlier left vectors, then X'u on the columns. Both
sides are reorthogonalised in full, twice: what u has along an earlier left vector is known from that one's X'u, and what
rounding left of it is measured in the pass. Left vectors have an entry per row and are never stored: each is X y with
``d`` numbers y, so a task that needs its rows of u computes them from its rows of X, and a lost executor loses nothing.
Tasks send back ``d`` numbers and one per left vector; Spark sums them. The driver holds vectors of the dimension and the
small bidiagonal matrix, whose SVD gives components and deviations. A run that stops before the directions are used up is
repeated with the found components taken out, so repeated eigenvalues are all found.

Rows that have no vector, an empty one, null or non-finite entries, or entries beyond +-LARGEST are left out, and so are
vectors of another length than the commonest (of equally common lengths the smaller). Components without variance are left
out: equal vectors or a single one give no rows. Repeated rows and null ids are rows like all others. Columns of ``df``
stay, unless a result column is to have their name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revlens.llm.common import col, fresh, staged

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0 ** 46  # of an entry; its whole number is exact as a double
COMPONENTS = 16
BLOCK_BYTES = 4_000_000  # of the whole numbers in one block
#: Relative residual at which a singular value has converged, and the share of the largest below which one counts as none.
RESIDUAL, NOTHING = 1e-14, 1e-10
LONG = 2 ** 63 - 1


def to_grid(vector: Column) -> Column:
    """The vector as whole numbers, null if it has an entry that is null, not finite or too large."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    grid = F.transform(entries, lambda c: F.floor(SCALE * c) + OFFSET)
    return F.when(F.coalesce(bad, F.lit(True)) | (F.size(vector) < 1), F.lit(None)).otherwise(grid)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list array whose lists all have length d."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def as_blocks(vectors: DataFrame, d: int) -> DataFrame:
    """(m, block): rows of the distinct vectors ``x`` as matrices of at most BLOCK_BYTES, eight bytes an entry."""
    rows = max(1, BLOCK_BYTES // (8 * d))

    def task(batches):
        held, n = [], 0

        def flush():
            nonlocal held, n
            whole = np.concatenate(held)
            for at in range(0, len(whole), rows):
                part = whole[at: at + rows]
                yield pa.RecordBatch.from_pydict({"m": pa.array([len(part)], pa.int32()), "block": pa.array([part.tobytes()], pa.binary())})
            held, n = [], 0

        for batch in batches:
            held.append(matrix(batch.column(0), d).astype(np.int64))
            n += batch.num_rows
            if n >= rows:
                yield from flush()
        if n:
            yield from flush()

    return vectors.select("x").mapInArrow(task, "m int, block binary")


def block_rows(batches, d: int):
    for batch in batches:
        for block in batch.column(batch.schema.get_field_index("block")):
            yield np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S exactly, as 64-bit integers or, where these could overflow, Python's; and (n x - S) / n as doubles."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest < LONG // 2:
        exact = x * n - np.array(sums, np.int64)
    else:
        exact = x.astype(object) * n - np.array(sums, object)
    return exact, exact.astype(np.float64) / n


def deviations(exact: np.ndarray) -> list[int]:
    """Exact sums of squares of each row."""
    if exact.dtype != object and exact.size and int(np.abs(exact).max()) ** 2 * exact.shape[1] > LONG:
        exact = exact.astype(object)
    return [int(s) for s in (exact * exact).sum(axis=1)]


class CentredRows:
    """The fit list, its size, sums per dimension and total variance. Each call of ``total`` is one pass over the blocks."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d, self.n, self.sums = blocks, d, blocks.agg(F.sum("m").alias("n")).first()["n"] or 0, []

        def column_sums(batches):
            for x in block_rows(batches, d):
                s = x.astype(object).sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) > LONG else x.sum(axis=0)
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()),
                                                  "s": pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))})

        rows = blocks.mapInArrow(column_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
        self.sums = [int(r["s"]) for r in sorted(rows.collect(), key=lambda r: r["i"])]
        self.trace = float(self.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / self.n if self.n else 0.0

    def total(self, of_rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """Sum over the blocks of ``of_rows(centred rows)``, an array of ``width`` numbers; bounded by ``width`` per task."""
        d, n, sums = self.d, self.n, self.sums

        def task(batches):
            whole = np.zeros(width)
            for x in block_rows(batches, d):
                whole += of_rows(centred(x, n, sums)[1])
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "s": pa.array(whole, pa.float64())})

        rows = self.blocks.mapInArrow(task, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
        out = np.zeros(width)
        for r in rows.collect():
            out[r["i"]] = r["s"]
        return out


def free_of(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``v`` without its parts along the orthonormal columns of ``others``, taken out twice."""
    for _ in range(2):
        v = v - others @ (others.T @ v)
    return v


def start(d: int, others: np.ndarray, seed: int) -> np.ndarray:
    v = free_of(np.random.default_rng(seed).standard_normal(d), others)
    return v / np.linalg.norm(v)


def bidiagonalise(rows: CentredRows, want: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Largest singular values of the rows without the directions ``found``, and their right vectors; at most ``want``.

    With all directions used up (the last result), all values are exact; otherwise the ``want`` largest have converged.
    """
    d = rows.d
    most = d - found.shape[1]
    right, left, across = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v; y with u = X y; X'u
    alphas, betas, scale = [], [], math.sqrt(rows.trace * rows.n)
    v = start(d, found, 1)
    while True:
        k = left.shape[1]
        right = np.column_stack([right, v])
        y = v - left @ (across.T @ v)  # X v, freed of the left vectors before it

        def columns(x, y=y, left=left):
            u = x @ y
            return np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u]])

        sums = rows.total(columns, d + k + 1)
        again = sums[d: d + k]  # what rounding left along earlier left vectors
        size = math.sqrt(max(sums[-1] - again @ again, 0.0))
        if size <= NOTHING * scale:
            alphas.append(0.0)
            left, across, r = np.column_stack([left, np.zeros(d)]), np.column_stack([across, np.zeros(d)]), np.zeros(d)
        else:
            u, xu = (y - left @ again) / size, (sums[:d] - across @ again) / size
            alphas.append(size)
            left, across = np.column_stack([left, u]), np.column_stack([across, xu])
            r = free_of(xu, np.column_stack([found, right]))
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        ends, values, turned = np.linalg.svd(small)
        ends = beta * np.abs(ends[-1])
        if len(alphas) == most:
            break
        if len(values) > want and (ends[:want] <= RESIDUAL * values[0]).all():
            break
        if beta <= NOTHING * scale:  # nothing else is reached from here
            beta, r = 0.0, start(d, np.column_stack([found, right]), len(alphas) + 1)
            v = r
        else:
            v = r / beta
        betas.append(beta)
    return values[:want], (right @ turned.T)[:, :want], len(alphas) == most


@dataclass
class Whitening:
    """``directions``: unit components as columns; ``variances``: of the fit list along them; the worst entry of the
    whitened fit list's covariance less the identity."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def whitening_of(rows: CentredRows, components: int) -> Whitening:
    d = rows.d
    values, vectors = np.zeros(0), np.zeros((d, 0))
    while rows.n > 1 and vectors.shape[1] < d:
        new, found, complete = bidiagonalise(rows, min(components, d - vectors.shape[1]), vectors)
        least = np.sort(values)[::-1][components - 1] if len(values) >= components else -1.0
        values, vectors = np.append(values, new), np.column_stack([vectors, found])
        if complete or new[0] <= least or new[0] <= NOTHING * math.sqrt(rows.trace * rows.n):
            break
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > NOTHING * math.sqrt(rows.trace * rows.n)] if len(values) else order
    kept = vectors[:, order]
    k = kept.shape[1]
    if not k:
        return Whitening(rows.n, rows.sums, kept, np.zeros(0), rows.trace, 0.0)
    variances = values[order] ** 2 / rows.n

    def covariance(x):
        z = x @ kept / np.sqrt(variances)
        return (z.T @ z).ravel()

    identity = rows.total(covariance, k * k).reshape(k, k) / rows.n
    return Whitening(rows.n, rows.sums, kept, variances, rows.trace, float(np.abs(identity - np.eye(k)).max()))


def usable(df: DataFrame, vector: str, name: str) -> tuple[DataFrame, int]:
    """The rows that can be whitened, with their whole numbers under ``name``, and the dimension."""
    df = df.withColumn(name, to_grid(col(vector))).filter(col(name).isNotNull())
    lengths = df.groupBy(F.size(col(name)).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 1
    return df.filter(F.size(col(name)) == d), d


def whiten(df: DataFrame, vector: str, components: int = COMPONENTS,
           names: tuple[str, ...] = ("component", "n", "deviation", "whitened", "explained", "identity_error")) -> DataFrame:
    """Fits on the distinct vectors; one row for each usable row and component, with all other columns of ``df``.

    ``deviation`` is null where it is too large for a long.
    """
    grid, *new = fresh(df, "_grid", "_component", "_n", "_deviation", "_whitened", "_explained", "_error")
    rows, d = usable(df, vector, grid)
    distinct = rows.select(col(grid).alias("x")).distinct()
    model = whitening_of(CentredRows(staged(as_blocks(distinct, d), "vector-blocks"), d), components)
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in names]
    plain = rows.select(*[col(c).alias(f"c{i}") for i, c in enumerate(keep)], col(grid).alias("x"))
    made = T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    schema = T.StructType([*plain.schema.fields[:-1], *made.fields])
    arrow = to_arrow_schema(schema)

    def task(batches):
        m = shared.value
        k = len(m.variances)
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            exact, near = centred(matrix(batch.column(batch.num_columns - 1), d), m.n, m.sums)
            z = near @ m.directions / np.sqrt(m.variances)
            far = [s if s <= LONG else None for s in deviations(exact)]
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            size = batch.num_rows * k
            yield pa.RecordBatch.from_arrays(
                [*(c.take(each).cast(f.type) for c, f in zip(batch.columns[:-1], arrow)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, m.n)),
                 pa.array(far, pa.int64()).take(each), pa.array(z.ravel()),
                 pa.array(np.tile(m.variances / m.trace, batch.num_rows)), pa.array(np.full(size, m.identity_error))], schema=arrow)

    out = plain.mapInArrow(task, schema).toDF(*[f"c{i}" for i in range(len(keep))], *new)
    return out.select(*[col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[col(x).alias(name) for x, name in zip(new, names, strict=True)])


def op13_lanczos_whitening(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(vectors, "embedding")
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
