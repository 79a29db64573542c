import math
from collections import Counter

import numpy as np
import pytest

from revlens.llm.lanczos import op13_lanczos_whitening, whiten

SCHEMA = "vec_id bigint, embedding array<double>, n string, `a.b` string, _grid int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y", 1)
                                  for i, v in zip(ids, vectors)], SCHEMA)


def usable(vectors):
    good = [v for v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    d = max(sorted(Counter(map(len, good)).items()), key=lambda x: (x[1], -x[0]))[0] if good else 0
    return [[math.floor(64 * c) + 1000000 for c in v] for v in good if len(v) == d]


def check(df, vectors, most=16):
    rows = df.collect()
    grid = usable(vectors)
    fit = [list(t) for t in sorted(set(map(tuple, grid)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors_ = np.linalg.eigh(x.T @ x / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == k * len(grid)
    exact = Counter(sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in grid)
    got = Counter()
    for r in rows:
        got[r["deviation"]] += 1
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-8
    assert got == Counter({d: k * m for d, m in exact.items()})
    # projections, whatever the sign and the basis of equal eigenvalues: the whitened inner products of all rows
    z = np.zeros((len(grid), k))
    at = Counter()
    by_id = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"])):
        by_id.setdefault((r["vec_id"], at[(r["vec_id"], r["component"])]), []).append(r["whitened"])
        at[(r["vec_id"], r["component"])] += 1
    z = np.array(list(by_id.values()))
    full = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in grid])
    want = full @ vectors_[:, :k] / np.sqrt(values[:k])
    assert np.allclose(np.sort((z @ z.T).ravel()), np.sort((want @ want.T).ravel()), atol=1e-7)
    return values, z, want


def test_equals_eigenvectors_by_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = list(rng.standard_normal((300, 20)) @ np.diag(np.linspace(3, 0.2, 20)))
    vectors += vectors[:5] * 3
    df = whiten(frame(spark, vectors), "embedding")
    _, z, want = check(df.drop("n", "a.b", "_grid") if False else df, vectors)
    assert "a.b" in df.columns and "_grid" in df.columns and df.columns.count("n") == 1


def test_rows_that_cannot_be_whitened(spark):
    rng = np.random.default_rng(4)
    good = [list(v) for v in rng.standard_normal((40, 3))]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [1.0] * 4]
    df = whiten(frame(spark, good + bad), "embedding")
    check(df, good + bad)
    assert {r["vec_id"] for r in df.collect()} == set(range(40))


def test_repeated_eigenvalues_and_missing_variance(spark):
    corners = [[a, b, c, 0.5, a] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]  # equal variances, rank 3
    df = whiten(frame(spark, corners, [None] * 3 + list(range(5))), "embedding")
    assert {r["component"] for r in df.collect()} == {1, 2, 3} and df.count() == 24
    assert sorted({round(r["explained"], 9) for r in df.collect()}) == [0.25, 0.5]
    many = [list(np.eye(30)[i] * s) for i in range(30) for s in (3, -3)]  # 30 equal eigenvalues, 16 of them wanted
    assert whiten(frame(spark, many), "embedding").count() == 60 * 16


def test_early_stop_finds_the_largest(spark):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    strong = np.array([40, 40, 30, 20, 10, 8] + [0.0] * 54) + 0.5
    vectors = list(rng.standard_normal((400, 60)) * strong @ basis.T)
    check(whiten(frame(spark, vectors), "embedding", 3), vectors, 3)


def test_large_entries_and_few_rows(spark):
    assert whiten(frame(spark, []), "embedding").count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]] * 4), "embedding").count() == 0
    out = whiten(frame(spark, [[2.0 ** 45, 1.0], [-(2.0 ** 45), 1.0], [0.0, 1e300]]), "embedding").collect()
    assert len(out) == 2 and {r["deviation"] for r in out} == {None} and {abs(round(r["whitened"], 9)) for r in out} == {1.0}


def test_query(spark, tmp_path):
    frame(spark, [[0.1, 0.2], [0.3, -0.5], [0.7, 0.9]]).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op13_lanczos_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 6
