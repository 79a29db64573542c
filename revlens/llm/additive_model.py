"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text, cut into quantile bins. Cyclic boosting visits one feature after the
other and adds a shrunken tree of two levels, fitted to the current gradient over that feature's bins, to the feature's
lookup table. Then the pairs of features that explain most of the rest get tables of their own in the same way, with one
level per feature. A text's score is the sum of its bins' entries, so scoring is a vectorised addition.

The model is fitted on at most ``SAMPLE`` labelled rows, the first by a hash of their id; its inputs are texts alone.
Null and empty texts have all counts 0 and get a score like any other. Several labels of one id count as their maximum.
Without labelled rows, or with one class only, the score is that class's share (0.5 without rows).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import col, documents, labels, map_texts
from revlens.llm.textstats import base_counts, kind_counts, split

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, RIDGE, LEAF_ROWS = 0.1, 1.0, 5


def features(texts: list[str | None]) -> np.ndarray:
    texts = [t or "" for t in texts]
    words = split(texts)
    c, kinds = base_counts(texts, words), kind_counts(texts).astype(np.float64)
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    distinct = np.array([len(set(w)) for w in words], np.int64)
    short = np.array([sum([len(x) <= 3 for x in w]) for w in words], np.int64)
    return np.column_stack([
        c["n_words"], c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / n, distinct / n, short / n, c["n_lines"] / n, *(kinds[:, 1:] / chars[:, None]).T,
    ])


class AdditiveModel:
    def __init__(self, start: float, edges: list[np.ndarray], coarse: list[np.ndarray], tables: list[np.ndarray],
                 pairs: list[tuple[int, int, np.ndarray]]):
        self.start, self.edges, self.coarse, self.tables, self.pairs = start, edges, coarse, tables, pairs

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for table, at in zip(self.tables, self.bins(x, self.edges)):
            z += table[at]
        at = self.bins(x, self.coarse)
        for a, b, table in self.pairs:
            z += table[at[a], at[b]]
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or share in (0.0, 1.0):
            odds = np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))
            return cls(float(odds), [], [], [], [])
        cut = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) for f in range(x.shape[1])]
        edges, coarse = cut(BINS), cut(PAIR_BINS)
        model = cls(float(np.log(share / (1 - share))), edges, coarse, [np.zeros(len(e) + 1) for e in edges], [])
        z, at = np.full(len(y), model.start), cls.bins(x, edges)
        for _ in range(ROUNDS):
            for table, b in zip(model.tables, at):
                step = RATE * tree(*moments(b, z, y, len(table)))
                table += step
                z += step[b]
        at = cls.bins(x, coarse)
        sizes = [len(e) + 1 for e in coarse]
        gains = []
        for a, b in combinations(range(len(coarse)), 2):
            g, h, n = (m.reshape(sizes[a], sizes[b]) for m in moments(at[a] * sizes[b] + at[b], z, y, sizes[a] * sizes[b]))
            gains.append((float(crossed(g, h, n)[1]), a, b))
        for _, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]:
            model.pairs.append((a, b, np.zeros((sizes[a], sizes[b]))))
        for _ in range(PAIR_ROUNDS):
            for a, b, table in model.pairs:
                g, h, n = (m.reshape(table.shape) for m in moments(at[a] * table.shape[1] + at[b], z, y, table.size))
                step = RATE * crossed(g, h, n)[0]
                table += step
                z += step[at[a], at[b]]
        return model


def moments(b: np.ndarray, z: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of gradient, curvature and rows per bin of the logistic loss."""
    p = 1 / (1 + np.exp(-z))
    return np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), np.bincount(b, minlength=size)


def best_cut(g, h, n) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 where none has enough rows."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = (np.cumsum(v)[:-1] for v in (g, h, n))
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < LEAF_ROWS) | (nr < LEAF_ROWS)] = 0
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def tree(g, h, n, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of ``depth`` levels."""
    _, at = best_cut(g, h, n) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([tree(g[:at], h[:at], n[:at], depth - 1), tree(g[at:], h[at:], n[at:], depth - 1)])


def crossed(g, h, n) -> tuple[np.ndarray, float]:
    """Values and gain of a tree that cuts the first feature once and each side by the second feature once."""
    _, at = best_cut(g.sum(1), h.sum(1), n.sum(1))
    rows = [slice(0, at), slice(at, None)] if at else [slice(0, None)]
    out, gain = np.zeros(g.shape), -g.sum() ** 2 / (h.sum() + RIDGE)
    for part in rows:
        gs, hs, ns = g[part].sum(0), h[part].sum(0), n[part].sum(0)
        _, cut = best_cut(gs, hs, ns)
        for side in [slice(0, cut), slice(cut, None)] if cut else [slice(0, None)]:
            out[part, side] = gs[side].sum() / (hs[side].sum() + RIDGE)
            gain += gs[side].sum() ** 2 / (hs[side].sum() + RIDGE)
    return out, gain


def training_rows(labelled: DataFrame, label: str, folds: int, held_out: int, limit: int, key: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``limit`` labelled ids outside the held-out fold, the first by a hash of the id."""
    rows = labelled.filter(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias("id")).agg(F.max(col(label)).alias("y"))
    rows = rows.filter(fold(F.col("id"), folds) != held_out)
    return rows.orderBy(F.xxhash64("id"), "id").limit(limit)


def fold(key, folds: int):
    return F.crc32(key.cast("string")) % folds


def feature_rows(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """(x, y): features of the sampled documents; the sample's size is a parameter, so it is broadcast."""
    rows = docs.select(col(key).alias("k"), col(text).alias("t")).join(F.broadcast(sample), F.col("k") == F.col("id")).select("t", "y")
    return map_texts(rows, "t", [("x", "array<double>")], lambda: lambda texts: [features(texts).tolist()]).select("x", "y")


def fit_quality(docs: DataFrame, labelled: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2,
                key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> AdditiveModel:
    rows = feature_rows(docs, training_rows(labelled, label, folds, held_out, sample, key), key, text).toPandas()
    rows = rows.iloc[np.lexsort(np.array(rows["x"].tolist()).T)] if len(rows) else rows  # sums in one order on every run
    return AdditiveModel.fit(np.array(rows["x"].tolist(), np.float64), rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, name: str, text: str = "text") -> DataFrame:
    """Append the score under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    return map_texts(docs, text, [(name, "double")], lambda: lambda texts: [shared.value.scores(features(texts))])


def op9_additive_model(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, labels(spark, folder)), "score").drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))
