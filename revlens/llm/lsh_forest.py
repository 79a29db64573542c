"""Near duplicates by a MinHash LSH forest: prefix tries of signatures, then exact verification.

A text is the set of its 5-word shingles. Texts with equal sets are one node. Each node has a MinHash signature, cut into
the keys of ``TREES`` sorted prefix tries of ``DEPTH`` values. Nodes that share a prefix in any tree are candidates.

The search begins with whole keys and shortens the prefix value by value. A level looks at the trie nodes that bring
together families not joined before, compares only members of different families, and drops those whose signatures agree
far less than a similarity of 0.8 would make them (0.0003 % of the pairs at 0.8). What it joins is verified on the exact
shingle sets before the next level, again only between members that no earlier level had in one family; so every pair of
a family is verified once, whether or not a trie held it.

The verified pairs from 0.8 to 0.8 + ``NEAR`` tell when to stop: each stands for 1 / p of them, where p is the chance that a
prefix of the present length finds a pair of its similarity. Closer copies have no part in this, as any length finds them.
Below ``TARGET``, or with no such pair, the prefix gets shorter, down to ``FLOOR`` values, which find 0.9997 of the pairs at 0.8.

No pair of a group is ever a row. Members of a trie node or a family go to blocks of bounded size, each pair of blocks
meets in one task, and a task gives back a spanning forest of its links and a count per node. A group's rows are so dealt
to many tasks, whatever its size.

Texts of fewer than five words are one shingle. Texts without words, null ones included, link to nothing and are classes
of their own. Rows with null ids take part; a class's id is the least id in it, null if it has none. Repeated rows are
copies of each other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import col, documents, fresh, map_texts, shuffle_partitions, small_batches, staged
from revlens.llm.components import connected
from revlens.llm.textstats import MIX, mixed

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8
TREES, DEPTH, FLOOR = 16, 6, 4
TARGET = 0.999
VALUES = TREES * DEPTH
NEAR, BINS = 0.02, 4  # verified pairs that the recall is estimated from, in bins of similarity
LEAST_AGREEMENT = 0.6
BLOCK_NODES = 512
FAMILY_NODES, FAMILY_BYTES = 512, 8_000_000
COLUMNS = 4096  # shingles that a verification multiplies at a time


@lru_cache
def letter_weights() -> np.ndarray:
    return mixed(np.arange(1 << 16) + 7) | np.uint64(1)


@lru_cache
def coefficients() -> tuple[np.ndarray, np.ndarray]:
    return mixed(np.arange(VALUES) + 1001) | np.uint64(1), mixed(np.arange(VALUES) + 5001)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of a byte array, hashed without making strings."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    weights = letter_weights()
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * weights[place & 0xFFFF]
    terms += (place >> 16).astype(np.uint64) * MIX[2]  # words beyond 65,536 bytes
    return starts, mixed(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64) * MIX[1])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word windows of each text."""
    parts = [(t or "").encode() + b"\n" for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    starts, words = word_hashes(np.frombuffer(b"".join(parts), np.uint8))
    n = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    first = np.cumsum(n) - n
    rolled = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled = mixed(rolled * MIX[1] + words[k: k + len(rolled)])
    out = []
    for a, m in zip(first.tolist(), n.tolist()):
        if m >= WORDS:
            out.append(np.unique(rolled[a: a + m - WORDS + 1]))
        elif m:
            key = np.array([m], np.uint64)
            for w in words[a: a + m]:
                key = mixed(key * MIX[1] + w)
            out.append(key)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """MinHash signatures, 16 bits a value; a tree's key is DEPTH values in a row."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    keys = np.concatenate(full)
    sizes = np.array([len(s) for s in full])
    starts = np.cumsum(sizes) - sizes
    factors, offsets = coefficients()
    out = np.empty((len(full), VALUES), ">u2")
    for j in range(VALUES):
        out[:, j] = mixed(np.minimum.reduceat(keys * factors[j] + offsets[j], starts)) >> np.uint64(48)
    made = iter(out)
    return [next(made).tobytes() if len(s) else None for s in sets]


def with_sets(docs: DataFrame, text: str, key: str, size: str | None = None, signature: str | None = None,
              shingles: str | None = None) -> DataFrame:
    """Append the key of each text's shingle set and, if named, its size, signature and the hashes themselves."""
    fields = [(key, "binary"), *((n, k) for n, k in ((size, "bigint"), (signature, "binary"), (shingles, "binary")) if n)]

    def work(texts):
        sets = shingle_sets(texts)
        out = [[set_key(s) for s in sets]]
        if size:
            out.append([len(s) for s in sets])
        if signature:
            out.append(signatures(sets))
        if shingles:
            out.append([s.tobytes() for s in sets])
        return out

    return map_texts(docs, text, fields, lambda: work)


def grouped(batches, keys: int):
    """Rows of consecutive batches with equal values in the first ``keys`` columns, as one list per column."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != now:
                if held is not None:
                    yield now, held
                now, held = row[:keys], [[] for _ in columns[keys:]]
            for cells, value in zip(held, row[keys:]):
                cells.append(value)
    if held is not None:
        yield now, held


def forest_edges(names: list, linked: np.ndarray, other: list | None = None) -> list[tuple]:
    """A spanning forest of the links of a block: (a, b) with b the component's first node."""
    names = names + (other or [])
    offset = len(names) - linked.shape[1]
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(linked)):
        for j in np.flatnonzero(linked[i]).tolist():
            a, b = root(i), root(j + offset)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(names[i], names[root(i)]) for i in range(len(names)) if root(i) != i]


def in_blocks(members: DataFrame, group: list[str], blocks: Column) -> DataFrame:
    """Deal each member to a block of its group and copy it to every pair of blocks it takes part in.

    Adds lo and hi, the pair, and ``own``, the member's block. Rows come out grouped by (group, lo, hi).
    """
    members = members.withColumn("_n", blocks).withColumn("own", F.pmod(F.xxhash64("s"), F.col("_n")).cast("int"))
    members = members.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    members = members.withColumn("lo", F.least("own", "_j")).withColumn("hi", F.greatest("own", "_j")).drop("_n", "_j")
    where = [F.col(c) for c in [*group, "lo", "hi"]]
    return members.repartition(shuffle_partitions(members.sparkSession), *where).sortWithinPartitions(*where, "s")


def candidate_edges(active: DataFrame, depth: int) -> DataFrame:
    """Edges (a, b) between families that have candidates at this prefix length, a spanning forest per block.

    ``active``: s, sig, l (the node's family so far). Trie nodes within one family are left out.
    """
    keys = trie_keys(active, depth)
    nodes = keys.groupBy("t").agg(F.count("*").alias("n"), F.min("family").alias("first"), F.max("family").alias("last"))
    nodes = nodes.filter("first <> last").select(F.col("t").alias("node"), "n")
    members = keys.select("s", "t").join(nodes, F.col("t") == F.col("node")).drop("node")
    members = members.join(active.select(F.col("s").alias("x"), "sig", "l"), F.col("s") == F.col("x")).drop("x")
    blocks = in_blocks(members, ["t"], F.ceil(F.col("n") / BLOCK_NODES)).select("t", "lo", "hi", "own", "sig", "l")

    def task(batches):
        for (_, lo, hi), (own, sigs, labels) in grouped(batches, 3):
            values = np.frombuffer(b"".join(sigs), ">u2").reshape(len(sigs), VALUES).astype(np.uint16)
            own, family = np.array(own), numbered(labels)
            left = np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            apart = family[left][:, None] != family[right][None]
            if not apart.any():
                continue
            a, b = values[left], values[right]
            agree = np.zeros((len(a), len(b)), np.uint8)
            for k in range(VALUES):
                agree += (a[:, k][:, None] == b[:, k][None]).view(np.uint8)
            linked = (agree >= LEAST_AGREEMENT * VALUES) & apart
            if lo == hi:
                linked = np.triu(linked, 1)
            pairs = forest_edges([labels[i] for i in left], linked, None if lo == hi else [labels[i] for i in right])
            if pairs:
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return blocks.mapInArrow(task, "a binary, b binary")


def numbered(labels: list[bytes]) -> np.ndarray:
    """A number for each label, the same for equal ones."""
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    return np.array([number[x] for x in labels])


def trie_keys(active: DataFrame, depth: int) -> DataFrame:
    """(s, t, family) of every node in every tree: hashes of the tree's prefix and of the node's family."""
    rows = active.select("s", "sig", F.xxhash64("l").alias("family"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = F.substring(F.col("sig"), F.col("tree") * F.lit(2 * DEPTH) + 1, F.lit(2 * depth))
    return rows.select("s", F.xxhash64("tree", prefix).alias("t"), "family")


def chance(similarity: float, depth: int) -> float:
    """That a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity ** depth) ** TREES


def recall(near: dict[int, int], depth: int) -> float:
    """Share of the pairs near the threshold that a prefix of this length finds, from those found by bin; 0 without any."""
    due = sum(n / chance(NUMERATOR / DENOMINATOR + k * NEAR / BINS, depth) for k, n in near.items())
    return sum(near.values()) / due if due else 0.0


def descend(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(a, b, links) of all levels as ``verified`` gives them, and the length of the last prefix."""
    active = nodes.select("s", "sig", F.col("s").alias("l"))
    near: dict[int, int] = {}
    found = None
    for depth in range(DEPTH, FLOOR - 1, -1):
        edges = staged(candidate_edges(active, depth), "candidates")
        if not edges.isEmpty():
            joined = connected(edges)
            links = staged(verified(with_texts(docs, nodes, active, joined, key, text)), "links")
            found = links if found is None else found.unionAll(links)
            for r in links.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # BINS rows at most
                near[r["bin"]] = near.get(r["bin"], 0) + r["n"]
        if depth == FLOOR or recall(near, depth) >= TARGET:
            break
        if not edges.isEmpty():
            active = active.join(joined, F.col("l") == F.col("node"), "left").select("s", "sig", F.coalesce("label", "l").alias("l"))
            active = staged(active, "active")
    if found is None:
        found = docs.sparkSession.createDataFrame([], LINKS)
    return found, depth


def with_texts(docs: DataFrame, nodes: DataFrame, active: DataFrame, joined: DataFrame, key: str, text: str) -> DataFrame:
    """Members of the families that a level has joined, with their shingles and the family before, for ``verified``."""
    members = active.select("s", "l").join(joined, F.col("l") == F.col("node")).select(
        F.col("s").alias("m"), F.col("l").alias("before"), F.col("label").alias("family"))
    members = members.join(nodes.select("s", "size", "copies", "first_id", "first_hash"), F.col("m") == F.col("s")).drop("s")
    sizes = members.groupBy(F.col("family").alias("f")).agg(F.count("*").alias("nodes"), F.sum(8 * F.col("size")).alias("bytes"))
    members = staged(members.join(sizes, F.col("family") == F.col("f")).drop("f", "size"), "members")  # Spark knows its size
    texts = docs.select(col(key).alias("id"), col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    texts = texts.join(members, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_hash")))
    texts = with_sets(texts.select("t", "m", "before", "family", "copies", "nodes", "bytes"), "t", "s", shingles="sh")
    return texts.filter("s = m").drop("t", "m").dropDuplicates(["s"])  # rows that repeat id and text


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, from products of 0/1 matrices."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        table = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        out += table[: len(left)] @ table[len(left):].T
    return out.astype(np.int64)


LINKS = "a binary, b binary, links bigint, bin int"


def verified(members: DataFrame) -> DataFrame:
    """Exact links between members of a family that were in different ones before.

    ``members``: family, before, s, copies, nodes, bytes, sh. Result: (a, b) edges of a spanning forest; (a, links):
    documents linked to each of a's documents by this block; (links, bin): pairs near the threshold.
    """
    blocks = F.ceil(F.greatest(F.col("nodes") / FAMILY_NODES, F.col("bytes") / FAMILY_BYTES, F.lit(1)))
    rows = in_blocks(members, ["family"], blocks).select("family", "lo", "hi", "s", "own", "before", "copies", "sh")

    def task(batches):
        for (_, lo, hi), (names, own, before, copies, shingles) in grouped(batches, 3):
            own, copies, before = np.array(own), np.array(copies), numbered(before)
            left = np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            apart = before[left][:, None] != before[right][None]
            if not apart.any():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in shingles]
            sizes = np.array([len(x) for x in sets])
            common = intersections([sets[i] for i in left], [sets[i] for i in right])
            union = sizes[left][:, None] + sizes[right][None] - common
            linked = (DENOMINATOR * common >= NUMERATOR * union) & apart
            pairs = forest_edges([names[i] for i in left], linked, None if lo == hi else [names[i] for i in right])
            counts = list(zip([names[i] for i in left], (linked @ copies[right]).tolist()))
            if lo != hi:
                counts += zip([names[i] for i in right], (copies[left] @ linked).tolist())
            counts = [(s, n) for s, n in counts if n]
            once = np.triu(linked) if lo == hi else linked
            bins = ((common[once] / union[once] - NUMERATOR / DENOMINATOR) * (BINS / NEAR) + 1e-9).astype(np.int64)
            bins = [(k, n) for k, n in enumerate(np.bincount(bins, minlength=BINS)[:BINS].tolist()) if n]
            if pairs or counts:
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([*(x for x, _ in [*pairs, *counts]), *[None] * len(bins)], pa.binary()),
                    "b": pa.array([*(y for _, y in pairs), *[None] * (len(counts) + len(bins))], pa.binary()),
                    "links": pa.array([*[None] * len(pairs), *(n for _, n in [*counts, *bins])], pa.int64()),
                    "bin": pa.array([*[None] * (len(pairs) + len(counts)), *(k for k, _ in bins)], pa.int32())})

    return rows.mapInArrow(task, LINKS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, s, class_id, first_id, class_key, n_links) of every row.

    ``s``: key of the shingle set (null without words); ``first_id``: the least id with this set; ``class_key``: the least
    set key of the class's least id; ``n_links``: other rows that are as alike as 0.8, copies included.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(col(key).alias("id"), col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = staged(with_sets(rows, "t", "s", "size", "sig").drop("t"), "signatures")
    nodes = rows.filter("s IS NOT NULL").groupBy("s").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"),
        F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = nodes.select("s", "copies", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_hash"), "size", "sig")
    nodes = staged(nodes, "nodes")
    links, _ = descend(docs, nodes, key, text)
    classes = connected(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "c")
    linked = links.filter("b IS NULL AND bin IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    found = nodes.select("s", "copies", "first_id").join(classes, F.col("s") == F.col("c"), "left").join(
        linked, F.col("s") == F.col("k"), "left").select("s", "copies", "first_id", F.coalesce("label", "s").alias("label"),
                                                         F.coalesce("links", F.lit(0)).alias("links"))
    found = staged(found, "classes")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "s"))
    heads = found.groupBy("label").agg(first.alias("head")).select(
        F.col("label").alias("l"), F.col("head.first_id").alias("class_id"), F.col("head.s").alias("class_key"))
    sets = found.join(heads, F.col("label") == F.col("l")).select(
        F.col("s").alias("k"), "first_id", "class_id", "class_key", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    out = rows.select("id", "s").join(sets, F.col("s") == F.col("k"), "left")
    return out.select("id", "s", F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      "first_id", "class_key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least id of each class, with the columns of ``docs``; rows without words all stay."""
    found = near_duplicates(docs, key, text)
    s, k, i = fresh(docs, "_set", "_kept_set", "_kept_id")
    kept = found.filter(F.col("s") == F.col("class_key")).select(F.col("s").alias(k), F.col("first_id").alias(i)).distinct()
    rows = with_sets(docs, text, s)
    wordless = rows.filter(col(s).isNull())
    heads = rows.join(kept, (col(s) == col(k)) & col(key).eqNullSafe(col(i))).drop(k, i).dropDuplicates([s])
    return wordless.unionByName(heads).drop(s)


def op1_lsh_forest(spark, folder):
    out = near_duplicates(documents(spark, folder).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")
