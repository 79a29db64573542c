"""Density topics against a brute-force reading of the definition on small sets."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import density as dn


def brute_topics(rows, min_size, min_samples):
    """Topics of [(key, vector)] by removing edges of the full graph from the longest on, without any of the module's steps."""
    good = [(k, tuple(v)) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    copies = Counter(v for _, v in good)
    points = list(copies)
    n = len(points)
    d = [[math.dist(a, b) for b in points] for a in points]
    core = []
    for i in range(n):
        held, c = 0, 0.0
        for j in sorted(range(n), key=lambda j: d[i][j]):
            held, c = held + copies[points[j]], d[i][j]
            if held >= min_samples:
                break
        core.append(c)
    w = lambda i, j: max(d[i][j], core[i], core[j])
    edges, inside = [], {0}
    while len(inside) < n:  # Prim by full search
        best = min((w(i, j), i, j) for i in inside for j in range(n) if j not in inside)
        edges.append(best)
        inside.add(best[2])

    def parts(members, kept):
        near, out, left = defaultdict(list), [], set(members)
        for _, i, j in kept:
            near[i].append(j)
            near[j].append(i)
        while left:
            stack, part = [left.pop()], []
            while stack:
                i = stack.pop()
                part.append(i)
                for j in near[i]:
                    if j in left:
                        left.remove(j)
                        stack.append(j)
            out.append(part)
        return out

    weight = lambda part: sum(copies[points[i]] for i in part)

    def grown(members, own, birth):
        """(stability, chosen clusters as lists of members) of a cluster and what it parts into."""
        members, kept, stability = list(members), sorted(own), 0.0
        while True:
            if not kept:
                return stability + sum(copies[points[i]] for i in members) * (1 / dn.TINY - birth), [], stability
            longest = kept.pop()
            a, b = parts(members, kept)
            density = 1 / max(longest[0], dn.TINY)
            large = [p for p in (a, b) if weight(p) >= min_size]
            if len(large) == 2:
                stability += weight(members) * (density - birth)
                below = [(p, grown(p, [e for e in kept if e[1] in p], density)) for p in large]
                found = []
                for p, (s, inner, _) in below:
                    found += [(s, inner)] if inner else [(s, [p])]
                return max(stability, sum(s for s, _ in found)), ([] if stability >= sum(s for s, _ in found) else [c for _, cs in found for c in cs]), stability
            if not large:
                return stability + weight(members) * (density - birth), [], stability
            gone = set(members) - set(large[0])
            stability += weight(gone) * (density - birth)
            members = large[0]
            kept = [e for e in kept if e[1] in set(members) and e[2] in set(members)]

    def top(members, kept):
        """The first parting of the whole; the whole itself is no topic."""
        members, kept = list(members), sorted(kept)
        while kept:
            longest = kept.pop()
            a, b = parts(members, kept)
            large = [p for p in (a, b) if weight(p) >= min_size]
            if len(large) == 2:
                out = []
                for p in large:
                    _, inner, _ = grown(p, [e for e in kept if e[1] in set(p)], 1 / max(longest[0], dn.TINY))
                    out += inner or [p]
                return out
            if not large:
                return []
            members = large[0]
            kept = [e for e in kept if e[1] in set(members) and e[2] in set(members)]
        return []

    topic_of = {}
    for t, part in enumerate(top(range(n), edges) if n else []):
        topic_of.update({points[i]: t for i in part})
    return {k: topic_of.get(tuple(v) if v else None, -1) for k, v in rows}


def groups(topics):
    out = defaultdict(set)
    for k, t in topics.items():
        out[t].add(k)
    return {frozenset(v) for t, v in out.items() if t != -1}, frozenset(out[-1])


def found(df, **how):
    out = dn.density_topics(df, "id", **how)
    return {r["id"]: r["topic"] for r in out.collect()}


def planted(seed, sizes=(40, 30, 25), noise=12, dims=3, spread=(0.1, 0.3, 0.6)):
    r = random.Random(seed)
    rows = [[c * 4 * (j == c % dims) + (c // dims) * 9 + r.gauss(0, spread[c % len(spread)]) for j in range(dims)]
            for c, size in enumerate(sizes) for _ in range(size)]
    rows += [[r.uniform(-8, 14) for _ in range(dims)] for _ in range(noise)]
    return list(enumerate(rows))


SCHEMA = "id long, embedding array<double>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topics_and_noise_equal_brute_force(spark, seed):
    rows = planted(seed)
    rows += [(1000 + i, rows[3][1]) for i in range(14)] + [(2000 + i, [50.0, 50.0, 50.0]) for i in range(12)]  # copies
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df, min_size=10, min_samples=5)
    assert groups(got) == groups(brute_topics(rows, 10, 5))
    assert len(groups(got)[0]) >= 3 and -1 in got.values()
    sizes = [n for _, n in sorted(Counter(t for t in got.values() if t >= 0).items())]
    assert sizes == sorted(sizes, reverse=True)


def test_ranges_of_edges_and_chunks_change_nothing(spark, monkeypatch):
    rows = planted(5, sizes=(60, 50, 40), spread=(0.1,), noise=8)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = found(df, min_size=15, min_samples=5)
    monkeypatch.setattr(dn.cluster_tree, "__defaults__", (20,))  # many ranges
    assert found(df, min_size=15, min_samples=5) == whole
    monkeypatch.setattr(dn, "CHUNK", 64)  # several chunks and tables
    assert groups(found(df, min_size=15, min_samples=5))[0] == groups(whole)[0]
    assert groups(whole) == groups(brute_topics(rows, 15, 5))


def test_forest_equals_prim(spark):
    r = random.Random(3)
    pairs = {(a, b): r.choice([1.0, 2.0, 3.0, r.random()]) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.2 and (a < 50) == (b < 50)}
    got = dn.minimum_forest(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double")).collect()
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, n = 0.0, 0
    for (a, b), w in sorted(pairs.items(), key=lambda e: e[1]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, n = total + w, n + 1
    assert len(got) == n and sum(x.w for x in got) == pytest.approx(total)


def test_neighbours_are_found_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(dn, "CHUNK", 256)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 5))
    points = spark.createDataFrame([(i, [float(x) for x in p], 1) for i, p in enumerate(v)], "id long, v array<double>, m long")
    cores = {r["id"]: r["core"] for r in dn.core_distances(points, dn.ordered(points, 3000), 6).collect()}
    exact = np.sort(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), axis=1)[:, 5]
    got = np.array([cores[i] for i in range(3000)])
    assert (got >= exact - 1e-12).all() and (got <= exact + 1e-12).mean() > 0.5 and np.median(got / exact) < 1.1


def test_odd_rows_and_anchor(spark):
    rows = planted(7, sizes=(30, 30), noise=0, spread=(0.1,))
    odd = [(500, None), (501, []), (502, [1.0, float("nan"), 0.0]), (503, [1.0, None, 0.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("anchor", F.when(F.col("id").isin(0, 1, 2, 500), 0).otherwise(-1))
    got = found(df, min_size=10, min_samples=3)
    assert all(got[i] == -1 for i, _ in odd) and len(groups(got)[0]) == 2 and groups(got)[1] == {500, 501, 502, 503}
    moved = found(df, min_size=10, min_samples=3, anchor="anchor")
    assert moved[500] == moved[0] != -1 and moved[501] == -1
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], SCHEMA)
    assert set(found(same, min_size=5, min_samples=3).values()) == {-1}
    assert found(spark.createDataFrame([], SCHEMA), min_size=5, min_samples=3) == {}
