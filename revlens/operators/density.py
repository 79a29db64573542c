"""Density topics of vectors: clusters that stay connected over a range of densities, and noise.

The steps are those of hierarchical density clustering: core distances, a minimum spanning tree of mutual reachability,
the tree of clusters of a minimum size, and the choice of the clusters with the greatest excess of mass.

Near points are found in chunks of a space-filling order: vectors are projected on random directions, the quantiles of the
projections interleaved to one number, and each range of that order is cut into overlapping chunks. Several tables with
directions of their own make up for borders. A chunk gives its points' neighbours and then its own spanning tree, so its
pairs are never written out; the tree of all chunks' trees is the tree of all pairs that share a chunk. A table of at most
``CHUNK`` different vectors is one chunk, and the result is exact.

The spanning tree is joined by Boruvka's rounds. The cluster tree takes its edges in ranges of ascending weight, at most
about ``EDGES_A_TASK`` at a time; what lies below is contracted to components with their sizes. Only the clusters, of which there
are at most two per ``min_size`` rows, come to the driver.

Equal vectors are one point that counts as often as it occurs. Rows whose vector is null, empty or not finite are noise.
Vectors have one length.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialised

CHUNK = 2048  # points whose distances a task computes at a time
TABLES = 6
AXES, QUANTILES = 5, 256
EDGES_A_TASK = 500_000
SEED = 42
NOISE = -1
TINY = 1e-12  # least weight of an edge; its inverse is the density of equal points


def chunks(batches, columns: list[str]):
    """Arrays of the columns for each chunk of a partition sorted by (table, code); ``v`` becomes a matrix."""
    half, before, now = CHUNK // 2, None, None

    def both(a, b):
        return a if b is None else b if a is None else pd.concat([a, b], ignore_index=True)

    def arrays(frame):
        return [np.stack(frame[c].to_numpy()).astype(np.float64) if c == "v" else frame[c].to_numpy() for c in columns]

    for batch in batches:
        for _, rows in batch.groupby("table", sort=True):
            if now is not None and len(now) and now["table"].iloc[0] != rows["table"].iloc[0]:
                yield arrays(both(before, now))
                before = now = None
            now = both(now, rows)
            while len(now) > half:
                if before is not None:
                    yield arrays(both(before, now[:half]))
                before, now = now[:half], now[half:]
    if now is not None and len(now):
        yield arrays(both(before, now))


def distances(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), len(v)))
    for axis in v.T:
        out += (axis[:, None] - axis[None, :]) ** 2
    return np.sqrt(out)


def ordered(points: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``points`` with (table, code), one partition per range of the order and sorted by it."""
    if n <= CHUNK:
        return points.withColumn("table", F.lit(0)).withColumn("code", F.lit(0).cast("bigint")).coalesce(1)
    d = len(points.select("v").first()["v"])
    axes = min(AXES, d)
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((d, axes)))[0] for _ in range(TABLES)]

    def project(batches):
        for batch in batches:
            v = np.stack(batch["v"].to_numpy())
            yield pd.DataFrame({f"p{t}_{i}": (v @ turns[t])[:, i] for t in range(TABLES) for i in range(axes)})

    names = [f"p{t}_{i}" for t in range(TABLES) for i in range(axes)]
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = points.select("v").mapInPandas(project, ", ".join(f"{c} double" for c in names)).agg(
        *[F.percentile_approx(c, shares, 10 * QUANTILES).alias(c) for c in names]).first()
    cuts = {c: np.unique(cuts[c]) for c in names}
    bits = 60 // axes
    shifts = rng.random((TABLES, axes)) / 4

    def codes(batches):
        for batch in batches:
            v = np.stack(batch["v"].to_numpy())
            for t in range(TABLES):
                code = np.zeros(len(v), np.int64)
                for i, x in enumerate((v @ turns[t]).T):
                    known = cuts[f"p{t}_{i}"]
                    place = (np.interp(x, known, np.linspace(0, 1, len(known))) + shifts[t, i]) / 1.25
                    level = np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                    for b in range(bits):
                        code |= (level >> b & 1) << (b * axes + i)
                yield batch.assign(table=t, code=code)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    coded = points.mapInPandas(codes, f"{fields}, table int, code bigint")
    parts = max(TABLES, math.ceil(n * TABLES / (32 * CHUNK)))
    return coded.repartitionByRange(parts, "table", "code").sortWithinPartitions("table", "code")


def core_distances(points: DataFrame, order: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance at which a point's ball holds ``min_samples`` rows, its own among them."""
    k = max(min_samples - 1, 1)

    def nearest(batches):
        for ids, v, copies in chunks(batches, ["id", "v", "m"]):
            if len(ids) < 2:
                continue
            d = distances(v)
            np.fill_diagonal(d, np.inf)
            near = np.argpartition(d, min(k, len(ids) - 1) - 1, axis=1)[:, :k] if len(ids) > k else np.argsort(d, axis=1)[:, :-1]
            yield pd.DataFrame({"id": np.repeat(ids, near.shape[1]), "other": ids[near.ravel()],
                                "d": np.take_along_axis(d, near, 1).ravel(), "m": copies[near.ravel()]})

    pairs = order.select("id", "v", "m", "table").mapInPandas(nearest, "id bigint, other bigint, d double, m bigint")
    pairs = pairs.groupBy("id", "other").agg(F.min("d").alias("d"), F.first("m").alias("m"))  # a few per point
    own = points.select(F.col("id").alias("i"), F.col("m").alias("own"))
    upto = F.sum("m").over(Window.partitionBy("id").orderBy("d", "other"))
    held = pairs.withColumn("held", upto).join(own, F.col("id") == F.col("i"))
    reached = F.min(F.when(F.col("held") + F.col("own") >= min_samples, F.col("d")))
    cores = held.groupBy("id").agg(F.coalesce(reached, F.max("d")).alias("c"))
    cores = points.select(F.col("id").alias("i"), "m").join(cores, F.col("id") == F.col("i"), "left")
    return cores.select(F.col("i").alias("id"), F.when(F.col("m") >= min_samples, 0.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("core"))


def chunk_trees(order: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: spanning trees of mutual reachability of the chunks of (table, code, id, v, core)."""
    def trees(batches):
        for ids, v, core in chunks(batches, ["id", "v", "core"]):
            if len(ids) < 2:
                continue
            w = np.maximum(distances(v), np.maximum(core[:, None], core[None, :]))
            least, link = w[0].copy(), np.zeros(len(ids), np.int64)
            out = np.ones(len(ids), bool)
            out[0] = False
            pairs = []
            for _ in range(len(ids) - 1):
                at = int(np.argmin(np.where(out, least, np.inf)))
                pairs.append((link[at], at, least[at]))
                out[at] = False
                closer = w[at] < least
                least, link = np.where(closer, w[at], least), np.where(closer, at, link)
            a, b, weights = (np.array(x) for x in zip(*pairs))
            yield pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "w": weights})

    edges = order.select("id", "v", "core", "table").mapInPandas(trees, "a bigint, b bigint, w double")
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


def group_roots(links: DataFrame) -> DataFrame:
    """(x, p): the one node of x's group that all of it is mapped to, from links (x, p) whose only cycles are pairs."""
    back = links.select(F.col("x").alias("y"), F.col("p").alias("q"))
    pair = (F.col("q") == F.col("x")) & (F.col("x") < F.col("p"))
    now = materialised(links.join(back, F.col("p") == F.col("y")).select("x", F.when(pair, F.col("x")).otherwise(F.col("p")).alias("p")), "links")
    while True:
        on = now.select(F.col("x").alias("y"), F.col("p").alias("q"))
        further = materialised(now.join(on, F.col("p") == F.col("y")).select("x", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "links")
        if further.filter("moved").isEmpty():
            return now
        now = further.drop("moved")


def minimum_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of (a, b, w), a < b, one row per pair. Ties go by (a, b)."""
    left, chosen = materialised(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b"), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y"), "w", "a", "b"))
        best = materialised(both.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.*"), "lightest")
        chosen.append(best.select("a", "b", "w"))
        roots = group_roots(best.select("x", F.col("y").alias("p")))
        of = lambda c: roots.select(F.col("x").alias(f"{c}_of"), F.col("p").alias(f"{c}_to"))
        moved = left.join(of("x"), F.col("x") == F.col("x_of")).join(of("y"), F.col("y") == F.col("y_of")).filter("x_to <> y_to")
        ends = [f("x_to", "y_to").alias(c) for f, c in ((F.least, "x"), (F.greatest, "y"))]
        kept = moved.select(*ends, F.struct("w", "a", "b").alias("e")).groupBy("x", "y").agg(F.min("e").alias("e"))
        left = materialised(kept.select("x", "y", "e.*"), "edges")
    out = edges.limit(0).select("a", "b", "w")
    for part in chosen:
        out = out.unionByName(part)
    return materialised(out.distinct(), "forest")


KERNEL = "kind string, id bigint, other bigint, size bigint, density double"


def take_edges(min_size: int, number: int):
    """Merges one range of edges in ascending order, from components with sizes and, from ``min_size`` on, clusters.

    Gives rows of kind ``map`` (component, its new name), ``info`` (component, cluster, size), ``fall`` (component that joins a
    cluster at a density) and ``split`` (cluster, the cluster that it parts from at a density).
    """
    def task(rows: pd.DataFrame) -> pd.DataFrame:
        infos = rows[rows["kind"] == "info"]
        names = infos["id"].to_numpy()
        at = {int(x): i for i, x in enumerate(names)}
        parent, size = list(range(len(names))), [int(s) for s in infos["size"]]
        cluster = [None if pd.isna(c) else int(c) for c in infos["other"]]
        inside = [[i] if cluster[i] is None else [] for i in range(len(names))]
        out, made = [], 0

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def new_cluster():
            nonlocal made
            made += 1
            return (number << 40) + made

        def fall(i, c, density):
            out.extend(("fall", int(names[j]), c, 0, density) for j in inside[i])
            inside[i] = []

        for i in range(len(names)):
            if cluster[i] is None and size[i] >= min_size:  # many equal vectors
                cluster[i] = new_cluster()
                fall(i, cluster[i], 1 / TINY)
        edges = rows[rows["kind"] == "edge"].sort_values(["density", "size", "other"], kind="stable")
        for a, b, w in zip(edges["id"], edges["other"], edges["density"]):
            i, j, density = find(at[int(a)]), find(at[int(b)]), 1 / max(w, TINY)
            if i == j:
                continue
            if size[i] < size[j]:
                i, j = j, i
            if cluster[i] is not None and cluster[j] is not None:
                above = new_cluster()
                out.extend(("split", c, above, 0, density) for c in (cluster[i], cluster[j]))
                cluster[i] = above
            elif size[i] + size[j] >= min_size:
                if cluster[i] is None:
                    cluster[i] = new_cluster()
                    fall(i, cluster[i], density)
                fall(j, cluster[i], density)
            else:
                inside[i] += inside[j]
            parent[j], size[i] = i, size[i] + size[j]
        for i in range(len(names)):
            r = find(i)
            out.append(("map", int(names[i]), int(names[r]), 0, 0.0))
            if r == i:
                out.append(("info", int(names[i]), cluster[i], size[i], 0.0))
        frame = pd.DataFrame(out, columns=["kind", "id", "other", "size", "density"])
        return frame.astype({"other": "Int64"})

    return task


def cluster_tree(points: DataFrame, forest: DataFrame, min_size: int, edges_a_task: int = EDGES_A_TASK) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, density) of the points that join a cluster of ``min_size`` rows, and (cluster, above, density) of splits."""
    ranges = max(1, math.ceil(forest.count() / edges_a_task))
    cuts = forest.agg(F.percentile_approx("w", [i / ranges for i in range(1, ranges)] or [0.5], 100_000).alias("c")).first()["c"] or []
    number = sum([(F.col("w") > c).cast("int") for c in cuts] if ranges > 1 else [], F.lit(0))
    forest = materialised(forest.withColumn("range", number), "forest-ranges") if ranges > 1 else forest.withColumn("range", number)
    labels = points.select("id", F.col("id").alias("label"))
    infos = points.select("id", F.lit(None).cast("bigint").alias("other"), F.col("m").alias("size"))
    falls, splits = [], []
    for r in range(ranges):
        part = forest.filter(F.col("range") == r)
        of = lambda c: labels.select(F.col("id").alias(f"{c}_of"), F.col("label").alias(f"{c}_in"))
        edges = part.join(of("a"), F.col("a") == F.col("a_of")).join(of("b"), F.col("b") == F.col("b_of"))
        edges = edges.select(F.lit("edge").alias("kind"), F.col("a_in").alias("id"), F.col("b_in").alias("other"), F.col("a").alias("size"),
                             F.col("w").alias("density"))
        touched = edges.select("id").union(edges.select("other"))
        if r == 0:
            touched = touched.union(points.filter(F.col("m") >= min_size).select("id"))
        held = infos.join(touched.distinct(), "id", "left_semi")
        rows = edges.unionByName(held.select(F.lit("info").alias("kind"), "id", "other", "size", F.lit(0.0).alias("density")))
        # at most about edges_a_task edges and twice as many components
        made = materialised(rows.groupBy().applyInPandas(take_edges(min_size, r), KERNEL), "merged")
        fall = made.filter("kind = 'fall'").select(F.col("id").alias("label"), F.col("other").alias("cluster"), "density")
        falls.append(labels.join(fall, "label").select("id", "cluster", "density"))
        splits.append(made.filter("kind = 'split'").select(F.col("id").alias("cluster"), F.col("other").alias("above"), "density"))
        if r + 1 < ranges:
            to = made.filter("kind = 'map'").select(F.col("id").alias("label"), F.col("other").alias("to"))
            labels = materialised(labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            rest = infos.join(to.select(F.col("label").alias("id")), "id", "left_anti")
            infos = materialised(rest.unionByName(made.filter("kind = 'info'").select("id", "other", "size")), "components")
    for parts in (falls, splits):
        while len(parts) > 1:
            parts.append(parts.pop(0).unionByName(parts.pop(0)))
    return materialised(falls[0], "falls"), splits[0]


def chosen_clusters(falls: list, splits: list) -> dict[int, int]:
    """Cluster -> the chosen cluster that holds it, by excess of mass.

    ``falls``: (cluster, rows, rows times density) of what joins it itself; ``splits``: (cluster, above, density). The one cluster that holds
    all others is never chosen; if several have none above, their common root is at density 0.
    """
    below, above, birth = defaultdict(list), {}, defaultdict(float)
    for c, up, density in splits:
        below[up].append(c)
        above[c], birth[c] = up, density
    rows = {c: n for c, n, _ in falls}
    mass = {c: s for c, _, s in falls}
    every = set(rows) | set(above) | set(below)
    roots = [c for c in every if c not in above]
    order, stack = [], list(roots)
    while stack:
        c = stack.pop()
        order.append(c)
        stack.extend(below[c])
    size, best, chosen = {}, {}, {}
    for c in reversed(order):
        size[c] = rows.get(c, 0) + sum(size[x] for x in below[c])
        own = mass.get(c, 0.0) - rows.get(c, 0) * birth[c] + sum(size[x] * (birth[x] - birth[c]) for x in below[c])
        parts = sum(best[x] for x in below[c])
        chosen[c] = own >= parts and not (len(roots) == 1 and c == roots[0])
        best[c] = own if chosen[c] else parts
    held: dict[int, int] = {}
    for c in order:
        if above.get(c) in held:
            held[c] = held[above[c]]
        elif chosen[c]:
            held[c] = c
    return held


def density_topics(df: DataFrame, key: str, embedding: str = "embedding", min_size: int = 300, min_samples: int = 20,
                   anchor: str | None = None, out: str = "topic") -> DataFrame:
    """Append each row's topic: 0 for the largest one and so on, -1 for noise. Ties go to the smaller key.

    With ``anchor`` each anchored row (0 or more) moves to the topic that holds most rows of its anchor.
    """
    spark = df.sparkSession
    vector = F.transform(F.col(embedding), lambda c: c.cast("double") + 0.0)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    vector = F.when(F.coalesce(bad, F.lit(True)) | (F.size(embedding) < 1), F.lit(None)).otherwise(vector)
    rows = df.withColumn("_v", vector)
    points = rows.filter("_v IS NOT NULL").groupBy(F.col("_v").alias("v")).agg(F.count("*").alias("m"))
    points = materialised(points.withColumn("id", F.monotonically_increasing_id()), "points")
    n = points.count()
    order = materialised(ordered(points, n), "near-order")
    order = order if n <= CHUNK else order.repartitionByRange(max(TABLES, math.ceil(n * TABLES / (32 * CHUNK))), "table", "code").sortWithinPartitions("table", "code")
    cores = materialised(core_distances(points, order, min_samples), "cores")
    with_core = order.join(cores, "id")
    with_core = with_core.coalesce(1) if n <= CHUNK else with_core.repartitionByRange(
        max(TABLES, math.ceil(n * TABLES / (32 * CHUNK))), "table", "code").sortWithinPartitions("table", "code")
    edges = chunk_trees(with_core)
    forest = materialised(edges, "forest") if n <= CHUNK else minimum_forest(edges)  # one chunk's tree is a forest already
    falls, splits = cluster_tree(points, forest, min_size)
    joined = falls.join(points.select("id", "m"), "id").groupBy("cluster").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("density")).alias("s"))
    held = chosen_clusters([tuple(r) for r in joined.collect()], [tuple(r) for r in splits.collect()])
    names = spark.createDataFrame(list(held.items()) or [], "cluster bigint, chosen bigint")
    found = falls.join(names, "cluster").join(points.select("id", "v"), "id").select(F.col("v").alias("_w"), "chosen")
    rows = materialised(rows.join(found, F.col("_v") == F.col("_w"), "left").drop("_v", "_w"), "in-clusters")
    if anchor:
        votes = rows.filter((F.col(anchor) >= 0) & F.col("chosen").isNotNull()).groupBy(anchor, "chosen").agg(F.count("*").alias("n"))
        home = votes.groupBy(F.col(anchor).alias("_a")).agg(F.max_by("chosen", F.struct("n", -F.col("chosen"))).alias("_home"))
        moved = F.when(F.col(anchor) >= 0, F.col("_home"))
        rows = rows.join(home, F.col(anchor) == F.col("_a"), "left").withColumn("chosen", F.coalesce(moved, "chosen")).drop("_a", "_home")
    sizes = rows.filter("chosen IS NOT NULL").groupBy(F.col("chosen").alias("_c")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1  # one row per topic
    sizes = sizes.withColumn("_t", place).select("_c", "_t")
    return rows.join(sizes, F.col("chosen") == F.col("_c"), "left").withColumn(out, F.coalesce("_t", F.lit(NOISE))).drop("chosen", "_c", "_t")
