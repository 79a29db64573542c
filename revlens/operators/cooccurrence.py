"""Word vectors from co-occurrence: counts in a window, shifted positive mutual information, randomised factorisation.

For the vectors, words that occur often enough are numbered by the order of their hashes, and the numbers are cut into blocks. Counts of
pairs are packed by (block, block), one side of the diagonal only, and are all that is stored of the matrix: weights are
computed where they are used. A task multiplies the packs of two blocks with the vectors of both, so a word's products move
once per block, not once per task; a block holds as many words as memory allows. The random start of a word is drawn from its hash, and
turns by small matrices are done where a block is read. What the next step does not need is removed. The driver holds a hash and a sum,
16 bytes, per word, and matrices of the width of a vector; words themselves stay in tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import materialised, removed

KIND = np.float32  # of stored vectors; sums are doubles
#: Blocks of few and of many words, and words of one at most; words of a task that only adds or joins.
BLOCKS, MANY, BLOCK, ADDED = (3, 4), 400_000, 1_600_000, 100_000
CELLS, COLUMNS = 3_400_000, 12  # numbers in a block of vectors that move at a time, and columns at least
COUNTED = 300_000  # words whose pairs a task counts at a time for the vectors
ENTRIES, PIECE, STEP = 500_000, 4096, 20_000  # entries of the matrix in a pack, words of a block in a row, entries in one product
#: Words that have a number in every task; words whose pairs a task counts at a time; pairs that a part sums.
HOT, HELD, PAIRS_A_PART = 1 << 16, 1_000_000, 4_000_000


def word_counts(tokens: DataFrame, column: str = "tokens", min_count: int = 3) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more."""
    words = tokens.select(F.explode(column).alias("word")).filter("word IS NOT NULL")
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def cooccurrences(
    tokens: DataFrame, column: str = "tokens", window: int = 5, totals: bool = False, hot: int = HOT, held: int = HELD,
) -> DataFrame:
    """(word, other, n): how often ``other`` stands at most ``window`` places from ``word``, on either side.

    With ``totals``, (word, total, others): the sum of n and the number of others, from the same counts.

    A task counts the unordered pairs of ``held`` words by numbers and packs them, dealt by their rarer word. The ``hot``
    commonest words have a number in every task; a pack lists its other words once. So no word brings more pairs to a part than it has
    occurrences or commoner words, and a part sums the packs of all tasks.
    """
    spark = tokens.sparkSession
    words = materialised(word_counts(tokens, column, 1), "word-counts")
    known = [r["word"] for r in words.orderBy(F.col("n").desc(), "word").limit(hot).collect()]
    n_pairs = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) * window
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_pairs / PAIRS_A_PART))
    shared = spark.sparkContext.broadcast(known)

    def task(batches):
        common, lists, size = pa.array(shared.value, pa.string()), [], 0
        for batch in batches:
            lists.append(batch.column(0))
            size += len(batch.column(0).flatten())
            if size >= held:
                yield packed(lists, window, common, parts)
                lists, size = [], 0
        if size:
            yield packed(lists, window, common, parts)

    def task_sums(table: pa.Table) -> pa.Table:
        return summed(table, pa.array(shared.value, pa.string()), totals)

    rows = tokens.select(F.col(column).cast("array<string>").alias("t")).mapInArrow(task, "part int, words array<string>, size int, pairs binary")
    if not totals:
        return rows.groupBy("part").applyInArrow(task_sums, "word string, other string, n bigint")
    sums = rows.groupBy("part").applyInArrow(task_sums, "word string, total bigint, others bigint")
    return sums.groupBy("word").agg(F.sum("total").alias("total"), F.sum("others").alias("others"))


def packed(lists: list[pa.Array], window: int, common: pa.Array, parts: int) -> pa.RecordBatch:
    """The pairs in some token lists: a row per part, with the words that are not among ``common`` and (rarer, other, n) compressed.

    Numbers up to the size of ``common`` mean its words, others the words of the row.
    """
    column = pa.concat_arrays(lists)
    doc = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    encoded = column.flatten().dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    v = len(words)
    rank = pc.index_in(words, value_set=common).fill_null(len(common)).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    order = np.lexsort((hashes, rank))  # common words first, the others by hash
    place = np.empty(v + 1, np.int64)
    place[order], place[-1] = np.arange(v), -1  # null at the end
    at, n_common = place[codes], int((rank < len(common)).sum())
    keys = []
    for o in range(1, window + 1):
        a, b = at[:-o], at[o:]
        both = (doc[:-o] == doc[o:]) & (a >= 0) & (b >= 0)
        keys.append((np.maximum(a, b) * v + np.minimum(a, b))[both])
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    first, second = np.divmod(keys, max(v, 1))
    part = (hashes[order] % np.uint64(parts)).astype(np.int32)[first]
    by = np.argsort(part, kind="stable")
    first, second, n, part = first[by], second[by], n[by], part[by]
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    rows, listed = [], []
    for i, j in zip(cuts, cuts[1:]):
        rare = np.unique(np.concatenate([x[i:j][x[i:j] >= n_common] for x in (first, second)]))
        number = lambda x: np.where(x < n_common, rank[order[x]], len(common) + np.searchsorted(rare, x))  # noqa: B023, E731
        raw = np.concatenate([np.diff(number(first[i:j]), prepend=0), number(second[i:j]), n[i:j]]).astype(np.uint32)
        rows.append((int(part[i]), int(j - i), pa.compress(raw.tobytes(), codec="zstd", asbytes=True)))
        listed.append(order[rare])
    ends = np.cumsum([0, *(len(x) for x in listed)])
    names = words.take(pa.array(np.concatenate([np.zeros(0, np.int64), *listed])))
    kinds = zip(range(3), (pa.int32(), pa.int32(), pa.binary()))
    numbers, sizes, data = (pa.array([r[k] for r in rows], kind) for k, kind in kinds)
    return pa.RecordBatch.from_arrays([numbers, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names), sizes, data], ["part", "words", "size", "pairs"])


def summed(table: pa.Table, common: pa.Array, totals: bool) -> pa.Table:
    """The packs of a part as rows, both words of a pair in turn."""
    lists = table.column("words").combine_chunks()
    starts = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    encoded = lists.flatten().dictionary_encode()
    here, h = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(common)
    firsts, seconds, counts = [], [], []
    for start, size, data in zip(starts, table.column("size").to_pylist(), table.column("pairs").to_pylist()):
        raw = np.frombuffer(pa.decompress(data, decompressed_size=12 * size, codec="zstd", asbytes=True), np.uint32).astype(np.int64)
        for out, x in ((firsts, np.cumsum(raw[:size])), (seconds, raw[size: 2 * size].copy())):
            rare = x >= h
            x[rare] = h + here[start + x[rare] - h]
            out.append(x)
        counts.append(raw[2 * size:])
    first, second, n = (np.concatenate(x) for x in (firsts, seconds, counts))
    names = pa.concat_arrays([common, encoded.dictionary])
    keys = np.maximum(first, second) * len(names) + np.minimum(first, second)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.add.reduceat(n[order], new)
    first, second = np.divmod(keys[new], len(names))
    same = first == second
    n = np.where(same, 2 * n, n)  # a word beside itself is seen from both places
    word, other, n = (np.concatenate(x) for x in ((first, second[~same]), (second, first[~same]), (n, n[~same])))
    if not totals:
        return pa.table({"word": names.take(pa.array(word)), "other": names.take(pa.array(other)), "n": n})
    found, at = np.unique(word, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, n)
    return pa.table({"word": names.take(pa.array(found)), "total": total, "others": np.bincount(at, minlength=len(found)).astype(np.int64)})


def positive_information(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(word, other, weight): log of observed over expected less log ``shift``, where it is positive."""
    sums = counts.groupBy("word").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").cast("double").alias("total"))  # one row
    of = lambda c: sums.select(F.col("word").alias(f"{c}_of"), F.col("s").alias(f"{c}_sum"))
    joined = counts.join(of("word"), F.col("word") == F.col("word_of")).join(of("other"), F.col("other") == F.col("other_of"))
    joined = joined.join(F.broadcast(total))
    weight = F.log(F.col("n") * F.col("total") / (F.col("word_sum") * F.col("other_sum"))) - math.log(shift)
    return joined.select("word", "other", weight.alias("weight")).filter("weight > 0")


class Numbers:
    """Words as numbers: the place of their hash among the sorted hashes, in blocks of ``width``."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.n = hashes, len(hashes)
        self.blocks = max(BLOCKS[self.n > MANY], math.ceil(self.n / BLOCK))
        self.width = max(math.ceil(self.n / self.blocks), 1)
        self.columns, self.piece = max(CELLS // self.width, COLUMNS), PIECE  # columns of vectors that move at a time; words of a row

    def of(self, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Numbers, -1 for what is not among the words."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == self.n] = 0
        return np.where(known & (self.hashes[at] == hashes), at, -1)

    def block(self, b: int) -> np.ndarray:
        return self.hashes[b * self.width: (b + 1) * self.width]


def thin(x: np.ndarray) -> bytes:
    """Numbers compressed by their bytes of equal weight."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def thick(data: bytes, size: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size).T).view(kind).ravel()


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their numbers."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(n[order], new) if len(new) else n[:0]


PACKS = "i int, j int, size int, keys binary, counts binary"


def packed_counts(tokens: DataFrame, column: str, window: int, numbers, hashed, n_words: int) -> DataFrame:
    """(i, j, size, keys, counts): how often the words of two blocks, j not above i, stand near one another.

    A key is the place in block i times the width of a block plus the place in block j, and keys are stored by their steps. Pairs
    of ``COUNTED`` words are counted at a time; a pair is dealt by its blocks and, where there are many pairs, by the first word.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(numbers)
    blocks, width = numbers.blocks, numbers.width
    slices = max(1, math.ceil(n_words * window / (blocks * (blocks + 1) // 2) / PAIRS_A_PART))

    def dealt(held):
        numbers = shared.value
        column = pa.concat_arrays(held)
        doc = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        flat = column.flatten()
        at = numbers.of(flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False))
        found = []
        for o in range(1, window + 1):
            a, b = at[:-o], at[o:]
            both = (doc[:-o] == doc[o:]) & (a >= 0) & (b >= 0)
            found.append((np.maximum(a, b) * numbers.n + np.minimum(a, b))[both])
        keys, n = counted(np.concatenate(found))
        first, second = np.divmod(keys, max(numbers.n, 1))
        i, j = first // width, second // width
        part = (i * (i + 1) // 2 + j) * slices + first % slices
        order = np.argsort(part, kind="stable")
        part, keys, n = part[order], (first % width * width + second % width)[order], n[order]
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        rows = [(int(part[x]), y - x, thin(np.diff(keys[x:y], prepend=0)), thin(n[x:y].astype(np.uint32))) for x, y in zip(cuts, cuts[1:])]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", "size", "keys", "counts"])

    def task(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(batch.column(0).flatten())
            if size >= COUNTED:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def summed_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.cumsum(thick(r["keys"], r["size"], np.int64)) for r in rows])
        keys, n = counted(keys, np.concatenate([thick(r["counts"], r["size"], np.uint32) for r in rows]).astype(np.int64))
        pair = rows[0]["part"] // slices
        i = int((math.isqrt(8 * pair + 1) - 1) // 2)
        j = pair - i * (i + 1) // 2
        if i == j:
            n = np.where(keys // width == keys % width, 2 * n, n)  # a word beside itself is seen from both places
        out = [(i, j, len(keys[x: x + ENTRIES]), thin(np.diff(keys[x: x + ENTRIES], prepend=0)), thin(n[x: x + ENTRIES].astype(np.uint32)))
               for x in range(0, len(keys), ENTRIES)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["i", "j", "size", "keys", "counts"])

    parted = tokens.select(hashed(column)).mapInArrow(task, "part int, size int, keys binary, counts binary")
    return parted.groupBy("part").applyInArrow(summed_up, PACKS)


def entries(pack: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, second = np.divmod(np.cumsum(thick(pack["keys"], pack["size"], np.int64)), width)
    return first, second, thick(pack["counts"], pack["size"], np.uint32)


def sums_of(packs: DataFrame, numbers) -> np.ndarray:
    """The sum of n of each word over both sides of the matrix."""
    blocks, width = numbers.blocks, numbers.width

    def task(batches):
        sums = {}
        for batch in batches:
            for r in batch.to_pylist():
                first, second, n = entries(r, width)
                for b, at, w in ((r["i"], first, n), (r["j"], second, np.where(first == second, 0, n) if r["i"] == r["j"] else n)):
                    sums[b] = sums.get(b, 0) + np.bincount(at, w, width)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "s"])

    def whole(batches):
        sums = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums[r["block"]] = sums.get(r["block"], 0) + np.frombuffer(r["s"])
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "s"])

    kind = "block int, s binary"
    out = np.zeros((blocks, width))
    for r in packs.mapInArrow(task, kind).repartitionById(blocks, F.col("block")).mapInArrow(whole, kind).collect():
        out[r["block"]] = np.frombuffer(r["s"])
    return out.ravel()


def start_of(hashes: np.ndarray, size: int) -> np.ndarray:
    rows = [np.random.default_rng(int(h) & (1 << 63) - 1).standard_normal(size) for h in hashes]
    return np.array(rows).reshape(len(hashes), size)


def summed_products(sums: np.ndarray, at: np.ndarray, other: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> None:
    """Adds weight times the other word's vector to each word's sum; ``at`` rises."""
    for i in range(0, len(at), STEP):
        here = at[i: i + STEP]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        sums[here[first]] += np.add.reduceat(vectors[other[i: i + STEP]] * weight[i: i + STEP, None], first)


PIECES = "block int, at int, data binary"


def dealt_pieces(table: DataFrame, numbers) -> DataFrame:
    """Rows of (block, at) by the piece they belong to, at most about ``ADDED`` words to a partition."""
    parts = max(numbers.blocks, math.ceil(numbers.n / ADDED))
    piece_of = F.col("block") * math.ceil(numbers.width / numbers.piece) + F.floor(F.col("at") / numbers.piece)
    return table.repartitionById(parts, F.pmod(piece_of, F.lit(parts)).cast("int"))


def times(packs: DataFrame, numbers, sums: np.ndarray, shift: float, size: int, vectors: DataFrame | None, turn: np.ndarray | None,
          last: bool = False) -> DataFrame:
    """The information matrix times ``vectors`` turned by ``turn``, or times the random start of ``size`` columns, as pieces of blocks.

    With ``last`` the vectors are not needed after it and are removed.

    Where blocks are large, columns follow one another by as many as may move at a time, and are put side by side at the end.
    """
    whole = size if turn is None else turn.shape[1]
    step = min(numbers.columns, whole)
    done = [materialised(products(packs, numbers, sums, shift, size, vectors, turn, x, min(x + step, whole)), "block") for x in range(0, whole, step)]
    if last and vectors is not None:
        removed(vectors)
    if len(done) == 1:
        return done[0]

    def beside(batches):
        held = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault((r["block"], r["at"]), {})[r["part"]] = np.frombuffer(r["data"], KIND)
        for (b, at), parts in held.items():
            widths = [min(step, whole - x) for x in range(0, whole, step)]
            yield piece(b, at, np.concatenate([parts[k].reshape(-1, w) for k, w in enumerate(widths)], axis=1))

    parts = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(k)) for k, d in enumerate(done)])
    out = materialised(dealt_pieces(parts, numbers).mapInArrow(beside, PIECES), "block")
    for d in done:
        removed(d)
    return out


def inner(vectors: DataFrame, turn: np.ndarray, others: DataFrame, numbers) -> np.ndarray:
    """Sum over words of the outer products of the turned vectors and the others: one small matrix per task."""
    def task(batches):
        held, whole = {}, 0.0
        for batch in batches:
            for r in batch.to_pylist():
                data, key = np.frombuffer(r["data"], KIND).astype(np.float64), (r["block"], r["at"])
                if key not in held:
                    held[key] = r["side"], data
                    continue
                side, other = held.pop(key)
                v, u = (other, data) if side == 0 else (data, other)
                whole = whole + (v.reshape(-1, len(turn)) @ turn).T @ u.reshape(-1, turn.shape[1])
        if not np.isscalar(whole):
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["g"])

    both = vectors.withColumn("side", F.lit(0)).unionByName(others.withColumn("side", F.lit(1)))
    rows = dealt_pieces(both, numbers).mapInArrow(task, "g binary").collect()
    return sum((np.frombuffer(r["g"]).reshape(turn.shape[1], -1) for r in rows), np.zeros((turn.shape[1],) * 2))


def products(packs, numbers, sums, shift, size, vectors, turn, low: int, high: int) -> DataFrame:
    """Columns ``low`` to ``high`` of the product. One task has the packs and the vectors of two blocks."""
    spark = packs.sparkSession
    blocks, width, total, random = numbers.blocks, numbers.width, float(sums.sum()), vectors is None
    shared = spark.sparkContext.broadcast((numbers, sums, turn))

    def turned(batches):
        turn = shared.value[2][:, low:high]
        for batch in batches:
            for r in batch.to_pylist():
                yield piece(r["block"], r["at"], (np.frombuffer(r["data"], KIND).reshape(-1, len(turn)) @ turn).astype(KIND))
    task_of = lambda i, j: i * (i + 1) / 2 + j
    left = packs.select(task_of(F.col("i"), F.col("j")).cast("int").alias("task"), "i", "j", "size", "keys", "counts", F.lit(None).cast("int").alias("at"))
    if not random:
        b, other = F.col("block"), F.col("other")
        spread = vectors.mapInArrow(turned, PIECES).select("block", "at", "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
        right = spread.select(task_of(F.greatest(b, other), F.least(b, other)).cast("int").alias("task"), b.alias("i"), F.lit(-1).alias("j"),
                              F.lit(0).alias("size"), F.col("data").alias("keys"), F.lit(None).cast("binary").alias("counts"), "at")
        left = left.unionByName(right)

    def task(batches):
        numbers, sums, turn = shared.value
        held, read = [], {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["j"] >= 0:
                    held.append(r)
                else:
                    read.setdefault(r["i"], []).append((r["at"], r["keys"]))
        if not held:
            return
        i, j = held[0]["i"], held[0]["j"]
        x, y = {}, {}
        for b in {i, j}:
            if random:
                x[b] = start_of(numbers.block(b), size)[:, low:high].astype(KIND)
            else:
                x[b] = np.zeros((len(numbers.block(b)), high - low), KIND)
                for at, data in read.pop(b, []):
                    rows = np.frombuffer(data, KIND).reshape(-1, high - low)
                    x[b][at: at + len(rows)] = rows
            y[b] = np.zeros(x[b].shape)
        while held:
            first, second, n = entries(held.pop(), width)
            weight = np.log(n * total / (sums[i * width + first] * sums[j * width + second])) - math.log(shift)
            kept = weight > 0
            first, second, weight = first[kept], second[kept], weight[kept]
            summed_products(y[i], first, second, weight, x[j])
            if i == j:
                off = first != second
                first, second, weight = first[off], second[off], weight[off]
            order = np.argsort(second, kind="stable")
            summed_products(y[j], second[order], first[order], weight[order], x[i])
        for b, v in y.items():
            yield from pieces_of(b, v, numbers.piece)

    def total_of(batches):
        held = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["block"], r["at"])
                held[key] = held.get(key, 0) + np.frombuffer(r["data"], KIND).astype(np.float64)
        for (b, at), v in held.items():
            yield piece(b, at, v.astype(KIND))

    done = left.repartitionById(blocks * (blocks + 1) // 2, F.col("task")).drop("task").mapInArrow(task, PIECES)
    return dealt_pieces(done, numbers).mapInArrow(total_of, PIECES)


def piece(block: int, at: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["block", "at", "data"])


def pieces_of(block: int, rows: np.ndarray, size: int):
    for at in range(0, len(rows), size):
        yield piece(block, at, rows[at: at + size].astype(KIND))


def orthonormal(vectors: DataFrame, size: int) -> np.ndarray:
    """The turn that gives the block orthonormal columns; directions without length fall away."""
    def task(batches):
        whole = np.zeros((size, size))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v = np.frombuffer(data, KIND).reshape(-1, size).astype(np.float64)
                whole += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["g"])

    rows = vectors.select("data").mapInArrow(task, "g binary").collect()  # a small matrix per task
    values, turn = np.linalg.eigh(sum((np.frombuffer(r["g"]).reshape(size, size) for r in rows), np.zeros((size, size))))
    kept = values > max(values.max(initial=0.0), 1e-300) * 1e-13
    return turn[:, kept] / np.sqrt(values[kept])


def with_vectors(words: DataFrame, hashed, numbers, vectors: DataFrame, turn: np.ndarray, size: int) -> DataFrame:
    """(word, vector): the words with their rows of the blocks, turned."""
    width = numbers.width
    shared = words.sparkSession.sparkContext.broadcast((numbers, turn))

    def numbered(batches):
        for batch in batches:
            numbers = shared.value[0]
            at = numbers.of(batch.column(1).to_numpy(zero_copy_only=False), np.ones(batch.num_rows, bool))
            at, place = np.divmod(at, width)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), batch.column(0)], ["block", "at", "word"])

    def joined(batches):
        numbers, turn = shared.value
        words, places, read = [], [], {}
        for batch in batches:
            named = batch.filter(batch.column("word").is_valid())
            words.append(named.column("word"))
            places.append(named.column("block").to_numpy().astype(np.int64) * width + named.column("at").to_numpy())
            read |= {r["block"] * width + r["at"]: r["data"] for r in batch.filter(batch.column("data").is_valid()).to_pylist()}
        names, place = pa.concat_arrays(words or [pa.array([], pa.string())]), np.concatenate([np.zeros(0, np.int64), *places])
        order = np.argsort(place)
        place = place[order]
        start = place // width * width + place % width // numbers.piece * numbers.piece
        for x in np.unique(start):
            i, j = np.searchsorted(start, [x, x + 1])
            rows = np.frombuffer(read[x], KIND).reshape(-1, len(turn))[place[i:j] - x] if x in read else np.zeros((j - i, len(turn)))
            ends = pa.array(np.arange(j - i + 1) * size, pa.int32())
            vectors = pa.ListArray.from_arrays(ends, pa.array((rows @ turn).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(order[i:j])), vectors], ["word", "vector"])

    named = words.select("word", hashed(F.col("word")).alias("h")).mapInArrow(numbered, "block int, at int, word string").withColumn("data", F.lit(None).cast("binary"))
    both = named.unionByName(vectors.withColumn("word", F.lit(None).cast("string")))
    return dealt_pieces(both, numbers).mapInArrow(joined, "word string, vector array<double>")


def factor_vectors(
    tokens: DataFrame, column: str = "tokens", size: int = 100, window: int = 5, min_count: int = 3, shift: float = 1.0,
    seed: int = 42, rounds: int = 2, spare: int = 8,
) -> DataFrame:
    """(word, vector) of every word that occurs ``min_count`` times: the leading ``size`` directions of the information matrix.

    The matrix is that of ``positive_information`` over the ``cooccurrences`` of these words. Words that go with no other get zeros,
    and so do directions beyond the rank.
    """
    words = materialised(word_counts(tokens, column, min_count), "vocabulary")
    found = words.agg(F.count("*"), F.sum("n")).first()
    for salt in range(9):
        key = lambda w, salt=salt: F.xxhash64(F.lit(seed), w, *([F.lit(salt)] if salt else []))
        hashes = np.sort(words.select(key(F.col("word")).alias("h")).toArrow().column(0).to_numpy().astype(np.int64))
        if not (np.diff(hashes) == 0).any():
            break
    else:
        raise ValueError("words with equal hashes")
    numbers, wide = Numbers(hashes), size + spare
    hashed = lambda c: F.transform(F.col(c).cast("array<string>"), lambda w: F.when(w.isNotNull(), key(w))).alias("t")
    packs = materialised(packed_counts(tokens, column, window, numbers, hashed, found[1] or 0), "pairs")
    sums = sums_of(packs, numbers)
    block, turn = None, None
    for _ in range(rounds + 1):
        block = times(packs, numbers, sums, shift, wide, block, turn, last=True)
        turn = orthonormal(block, wide)
        wide = turn.shape[1]  # the rank, where that is less
        if not wide:
            return words.select("word", F.array_repeat(F.lit(0.0), size).alias("vector"))
    image = times(packs, numbers, sums, shift, wide, block, turn)
    small = inner(block, turn, image, numbers)
    removed(image)
    removed(packs)
    values, by = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:size]
    last = np.zeros((len(turn), size))
    last[:, : len(order)] = turn @ (by[:, order] * np.sqrt(np.maximum(values[order], 0.0)))
    return with_vectors(words, key, numbers, block, last, size)
