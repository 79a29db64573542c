"""Improbable-feature digests: the rarest byte windows of a text in chained Bloom filters, compared by bit overlap.

Every window of 64 bytes has an entropy. How rare each entropy is comes from all windows of all documents, counted by
Spark. In each run of 64 neighbouring windows the rarest gets a vote; windows with 4 votes or more are the features of
the text. Features go in order into Bloom filters of 2048 bits and 5 hashes, 160 to a filter. Two digests are alike by
the overlap of their filters beyond chance: each filter of the smaller digest counts with its best partner, weighted by
its features.

The table of rarities is a parameter of a digest; digests compare under one table only. A text shorter than a window is
one feature. Null and empty texts have an empty digest; two empty ones have likeness 1, an empty and another one 0. The
next document is the one with the next id; rows with equal ids follow in an order fixed by their texts, null ids come
last, and the first document follows the last. Equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import SLICE_CHARS, col, documents, shuffle_partitions, text_slices
from revlens.llm.ordered import ordered_ranges
from revlens.llm.textstats import mixed

WINDOW, RUN, VOTES = 64, 64, 4
LEVELS = 1000
TRIVIAL = 100  # windows of lower entropy (in thousandths) are no features
BLOCK_BYTES = 1 << 24  # of filters compared at a time
FILTER_BITS, HASHES, FILTER_FEATURES = 2048, 5, 160
UNIT = 1 << 20  # fixed-point unit of entropies
BLOCK = 1 << 16


@lru_cache
def entropy_terms() -> np.ndarray:
    counts = np.arange(WINDOW + 1, dtype=np.float64)
    return np.round(counts * np.log2(np.maximum(counts, 1)) * UNIT).astype(np.int64)


def window_levels(data: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of the most possible of the window that starts at each byte.

    A window's sum changes by the terms of the byte that leaves and the byte that enters, whose counts are the numbers of
    equal bytes among the 63 after it and before it.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    after, before = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for start in range(0, n, BLOCK):
        part = data[start: start + BLOCK + WINDOW]
        a, b = after[start: start + BLOCK + WINDOW], before[start: start + BLOCK + WINDOW]
        own = min(BLOCK, n - start)
        for lag in range(1, WINDOW):
            m = min(own, len(part) - lag)
            if m <= 0:
                break
            same = (part[:m] == part[lag: lag + m]).view(np.uint8)
            a[:m] += same
            b[lag: lag + m] += same
    terms = entropy_terms()
    steps = np.diff(terms, prepend=0)
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = terms[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(steps[before[WINDOW:]] - steps[after[: n - WINDOW]], out=sums[1:])
    sums[1:] += sums[0]
    most = WINDOW * 6 * UNIT  # 6 bits for 64 different bytes
    return (most - sums) * LEVELS // most


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def levels_of_texts(data: list[bytes]) -> np.ndarray:
    """Counts of the levels of all windows inside the texts."""
    sizes = np.array([len(d) for d in data], np.int64)
    levels = window_levels(np.frombuffer(b"".join(data), np.uint8))
    if not len(levels):
        return np.zeros(LEVELS + 1, np.int64)
    starts, ends = spans(sizes)
    inside = np.zeros(len(levels) + 1, np.int64)
    long = sizes >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    return np.bincount(levels[np.cumsum(inside[:-1]) > 0], minlength=LEVELS + 1)


def count_levels(docs: DataFrame, text: str = "text") -> DataFrame:
    """(level, n) over all windows of all documents; each task sums its own texts first."""
    def task(batches):
        sums = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                sums += levels_of_texts([(t or "").encode() for t in part.column(0).to_pylist()])
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"level": pa.array(found, pa.int32()), "n": pa.array(sums[found], pa.int64())})

    return docs.select(col(text)).mapInArrow(task, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n"))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each level, the rarest first; levels of trivial windows come last."""
    counts = np.zeros(LEVELS + 1, np.int64)
    for row in count_levels(docs, text).collect():  # at most LEVELS + 1 rows
        counts[row["level"]] = row["n"]
    order = sorted(range(LEVELS + 1), key=lambda level: (level < TRIVIAL, counts[level], level))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    return ranks


def features(data: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the features of the texts, in order of place."""
    sizes = np.array([len(d) for d in data], np.int64)
    stream = np.frombuffer(b"".join(data) + bytes(WINDOW), np.uint8)
    starts, ends = spans(sizes)
    chosen = [np.zeros(0, np.int64)]
    windows = window_levels(stream)
    last = ends - WINDOW  # the last window of each text
    rank = ranks[windows]
    if len(windows) >= RUN:
        # the least rank, and of equals the leftmost, of the run of windows that starts at each place
        best = (rank << 40) | np.arange(len(rank))
        width = 1
        while width < RUN:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        runs = np.zeros(len(best) + 1, np.int64)
        long = last - starts >= RUN - 1
        np.add.at(runs, starts[long], 1)
        np.add.at(runs, last[long] - RUN + 2, -1)
        votes = np.bincount(best[np.cumsum(runs[:-1]) > 0] & (1 << 40) - 1, minlength=len(rank))
        chosen.append(np.flatnonzero(votes >= VOTES))
    places = chosen[-1]
    have = np.zeros(len(data), bool)
    if len(places):
        have[np.searchsorted(ends, places, side="right")] = True
    single = [int(starts[i] + np.argmin(rank[starts[i]: last[i] + 1])) for i in np.flatnonzero(~have & (sizes >= WINDOW))]
    places = np.sort(np.concatenate([places, np.array(single, np.int64)]))
    places = places[windows[places] >= 0]
    parts = np.lib.stride_tricks.sliding_window_view(stream, WINDOW)[places]
    parts = np.ascontiguousarray(parts).view("<u8")
    hashes = np.zeros(len(places), np.uint64)
    for k in range(parts.shape[1]):
        hashes = mixed(hashes ^ parts[:, k])
    texts = np.searchsorted(ends, places, side="right")
    short = [i for i in np.flatnonzero((sizes > 0) & (sizes < WINDOW))]
    if short:
        own = [int.from_bytes(hashlib.blake2b(data[i], digest_size=8).digest(), "little") for i in short]
        texts = np.concatenate([texts, np.array(short, np.int64)])
        hashes = np.concatenate([hashes, np.array(own, np.uint64)])
        order = np.argsort(texts, kind="stable")
        texts, hashes = texts[order], hashes[order]
    return texts, hashes


class Digest:
    """Bloom filters (rows of bytes) with the number of features in each."""

    __slots__ = ("counts", "filters", "ones")

    def __init__(self, counts: np.ndarray, filters: np.ndarray):
        self.counts, self.filters = counts, filters
        self.ones = np.bitwise_count(filters).sum(1).astype(np.int64)

    def text(self) -> str:
        return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts, self.filters))

    @classmethod
    def parse(cls, text: str) -> Digest:
        pairs = [p.split(":") for p in text.split(",")] if text else []
        filters = [np.frombuffer(base64.b64decode(f), np.uint8) for _, f in pairs]
        return cls(np.array([int(n) for n, _ in pairs], np.int64), np.array(filters, np.uint8).reshape(len(pairs), FILTER_BITS // 8))

    def order(self):
        return len(self.counts), int(self.counts.sum()), self.filters.tobytes()

    def likeness(self, other: Digest) -> float:
        if not len(self.counts) or not len(other.counts):
            return float(len(self.counts) == len(other.counts))
        a, b = (self, other) if self.order() <= other.order() else (other, self)
        best, step = np.zeros(len(a.counts)), max(1, BLOCK_BYTES // b.filters.size)
        for i in range(0, len(best), step):  # memory does not grow with the product of both lengths
            filters, ones = a.filters[i: i + step], a.ones[i: i + step]
            common = np.bitwise_count(filters[:, None] & b.filters[None]).sum(2).astype(np.float64)
            most = np.minimum(ones[:, None], b.ones[None]).astype(np.float64)
            chance = ones[:, None] * b.ones[None] / FILTER_BITS  # bits that filters without a common feature share on average
            beyond = np.where(common > chance + 3 * np.sqrt(chance), (common - chance) / np.maximum(most - chance, 1), 0)
            best[i: i + step] = np.clip(np.where(common == most, 1.0, beyond), 0, 1).max(1)
        return float((best * a.counts).sum() / a.counts.sum())


def digests(texts: list[str], ranks: np.ndarray) -> list[Digest]:
    owner, hashes = features([t.encode() for t in texts], ranks)
    per_text = np.bincount(owner, minlength=len(texts))
    first, _ = spans(per_text)
    filters = -(-per_text // FILTER_FEATURES)
    offset, _ = spans(filters)
    within = np.arange(len(owner)) - first[owner]
    row = offset[owner] + within // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    counts = np.bincount(row, minlength=len(bits))
    return [Digest(counts[o: o + n], packed[o: o + n]) for o, n in zip(offset, filters)]


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text and its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select(col(key).cast("bigint").alias("k"), col(text).alias("t"))
    rows, number, total = ordered_ranges(rows, "k", "t", shuffle_partitions(docs.sparkSession))
    rows = rows.withColumnRenamed(number, "range")
    # the first row of each range also closes the range before it; there are as many as ranges
    firsts = {r["range"]: r["k"] for r in rows.groupBy("range").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    closes = {r: order[i - 1] for i, r in enumerate(order)}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(r, firsts[r], closes[r]) for r in order], "r int, f bigint, closes int")
    heads = rows.join(F.broadcast(heads), (F.col("range") == F.col("r")) & F.col("k").eqNullSafe(F.col("f")))
    heads = heads.groupBy("closes").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    heads = heads.select(F.lit(None).cast("bigint").alias("k"), "t", F.col("closes").alias("range"), F.lit(1).alias("tail"))
    rows = rows.select("k", "t", "range", F.lit(0).alias("tail")).unionByName(heads)
    rows = rows.repartitionById(total, F.col("range")).sortWithinPartitions(
        "range", "tail", F.col("k").asc_nulls_last(), F.xxhash64("t"))
    shared = spark.sparkContext.broadcast(ranks)

    def task(batches):
        table, held = shared.value, []

        def made(rows):
            """Results for all rows but the last, which only follows."""
            texts = [t for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            found = digests(texts + changed, table)
            own, other = found[: len(texts)], found[len(texts):]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for k, _ in rows[:-1]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                "fingerprint": pa.array([d.text() for d in own[:-1]], pa.string()),
                "edited_fingerprint": pa.array([d.text() for d in other], pa.string()),
                "near_edited": pa.array([a.likeness(b) for a, b in zip(own, other)], pa.float64()),
                "near_next": pa.array([a.likeness(b) for a, b in zip(own, own[1:])], pa.float64()),
            })

        chars = 0
        for batch in batches:
            for k, t, _, tail in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append((k, t or ""))
                chars += len(held[-1][1])
                if tail or chars > SLICE_CHARS // 2:
                    if len(held) > 1:
                        yield made(held)
                    held, chars = ([], 0) if tail else (held[-1:], len(held[-1][1]))

    return rows.mapInArrow(task, SCHEMA)


def op10_bloom_digest(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return compare_with_next(docs, rarity(docs))
