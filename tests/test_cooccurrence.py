"""Co-occurrence counts and factored word vectors against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens import session
from revlens.operators import cooccurrence as co
from revlens.operators import models as md


def texts(seed=1):
    r = random.Random(seed)
    topics = [["fast", "quick", "smooth", "speed"], ["price", "cheap", "money", "cost"], ["login", "password", "account", "code"]]
    return [[r.choice(topics[i % 3]) if r.random() < 0.8 else r.choice(["app", "the", "is"]) for _ in range(8)] for i in range(240)]


def brute_pairs(rows, window):
    out = Counter()
    for t in rows:
        for i, a in enumerate(t):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if i != j and a is not None and t[j] is not None:
                    out[a, t[j]] += 1
    return out


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([(t,) for t in texts()], "tokens array<string>").repartition(4)


@pytest.mark.parametrize("window", [1, 3, 20])
def test_counts_equal_brute_force(spark, window):
    rows = [*texts(2)[:30], [], ["one"], ["a", "a", "a"], None, ["x", None, "y"]]
    df = spark.createDataFrame([(t,) for t in rows], "tokens array<string>")
    got = {(r["word"], r["other"]): r["n"] for r in co.cooccurrences(df, window=window).collect()}
    assert got == brute_pairs([t or [] for t in rows], window)


@pytest.mark.parametrize("hot,held", [(0, 40), (2, 1), (5, 10_000), (1000, 100)])
def test_counts_and_totals_do_not_depend_on_what_tasks_hold(spark, hot, held):
    rows = [*texts(3)[:60], [], ["one"], ["a", "a", "a"], None, ["x", None, "y"], [None, None], ["é", "the", "é", "日本"]]
    df = spark.createDataFrame([(t,) for t in rows], "tokens array<string>").repartition(3)
    want = brute_pairs([t or [] for t in rows], 4)
    assert {(r["word"], r["other"]): r["n"] for r in co.cooccurrences(df, window=4, hot=hot, held=held).collect()} == want
    sums = {}
    for (a, _), n in want.items():
        sums[a] = (sums.get(a, (0, 0))[0] + n, sums.get(a, (0, 0))[1] + 1)
    got = co.cooccurrences(df, window=4, totals=True, hot=hot, held=held).collect()
    assert {r["word"]: (r["total"], r["others"]) for r in got} == sums and len(got) == len(sums)


def test_information_equals_its_formula(tokens):
    counts = brute_pairs(texts(), 2)
    sums, total = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        sums[a] += n
    want = {k: math.log(n * total / (sums[k[0]] * sums[k[1]])) - math.log(1.5) for k, n in counts.items()}
    got = {(r["word"], r["other"]): r["weight"] for r in co.positive_information(co.cooccurrences(tokens, window=2), 1.5).collect()}
    assert got.keys() == {k for k, v in want.items() if v > 0} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_vectors_are_the_leading_directions_and_find_planted_neighbours(tokens):
    found = {r["word"]: np.array(r["vector"]) for r in co.factor_vectors(tokens, size=4, window=5, rounds=6).collect()}
    words = sorted(found)
    weights = {(r["word"], r["other"]): r["weight"] for r in co.positive_information(co.cooccurrences(tokens)).collect()}
    m = np.array([[weights.get((a, b), 0.0) for b in words] for a in words])
    values, vectors = np.linalg.eigh(m)
    lead = np.argsort(-values)[:4]
    want = (vectors[:, lead] * np.maximum(values[lead], 0)) @ vectors[:, lead].T
    v = np.array([found[w] for w in words])
    assert np.allclose(v @ v.T, want, atol=1e-6)
    near = co.factor_vectors(tokens, size=6)
    grown = md.lexicon_sets(md.expand_lexicon(near, {"speed": ["fast"], "money": ["price"], "entry": ["login"]}, 3, 0.0)).collect()
    assert {r["label"]: set(r["words"]) for r in grown} == {
        "speed": {"fast", "quick", "smooth", "speed"}, "money": {"price", "cheap", "money", "cost"}, "entry": {"login", "password", "account", "code"}}
    assert {r["word"]: r["vector"] for r in near.collect()}.keys() == found.keys()


def test_rare_and_lonely_words(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 3 + [(["lonely"],)] * 3 + [(["a", "rare"],)], "tokens array<string>")
    got = {r["word"]: r["vector"] for r in co.factor_vectors(df, size=3).collect()}
    assert got.keys() == {"a", "b", "lonely"} and got["lonely"] == [0.0] * 3
    assert co.factor_vectors(spark.createDataFrame([], "tokens array<string>"), size=2).count() == 0


def test_packed_counts_are_the_pairs_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(co, "ENTRIES", 7)
    monkeypatch.setattr(co, "PAIRS_A_PART", 50)
    monkeypatch.setattr(co, "COUNTED", 30)
    rows = [*texts(5)[:40], [], None, ["a", "a", None, "the"], [None], ["é"] * 3]
    kept = sorted({w for t in rows for w in t or [] if w} - {"a"})
    df = spark.createDataFrame([(t,) for t in rows], "tokens array<string>").repartition(3)
    word_hash = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in kept], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    numbers = co.Numbers(np.sort(np.array(list(word_hash.values()))))
    hashed = lambda c: F.transform(c, lambda w: F.when(w.isNotNull(), F.xxhash64(w))).alias("t")
    packs = co.packed_counts(df, "tokens", 3, numbers, hashed, 400)
    got = Counter()
    for r in packs.collect():
        first, second, n = co.entries(r.asDict(), numbers.width)
        assert r["i"] >= r["j"] and 0 < len(first) <= 7
        for a, b, k in zip(first, second, n):
            got[r["i"] * numbers.width + int(a), r["j"] * numbers.width + int(b)] += int(k)
    names = {int(np.searchsorted(numbers.hashes, h)): w for w, h in word_hash.items()}
    want = {k: n for k, n in brute_pairs([t or [] for t in rows], 3).items() if "a" not in k}
    assert {(names[a], names[b]): n for (a, b), n in got.items()} | {(names[b], names[a]): n for (a, b), n in got.items()} == want
    sums = co.sums_of(packs, numbers)
    assert {w: sums[i] for i, w in names.items()} == {w: sum(n for (a, _), n in want.items() if a == w) for w in names.values()}


@pytest.mark.parametrize("cells,piece", [(24, 2), (10_000_000, 3)])
def test_vectors_do_not_depend_on_what_a_task_holds(spark, tokens, monkeypatch, cells, piece):
    want = {r["word"]: np.array(r["vector"]) for r in co.factor_vectors(tokens, size=4).collect()}
    for name, value in (("CELLS", cells), ("COLUMNS", 1), ("PIECE", piece), ("ADDED", 5), ("BLOCKS", (4, 4)), ("COUNTED", 100), ("STEP", 3)):
        monkeypatch.setattr(co, name, value)
    got = {r["word"]: np.array(r["vector"]) for r in co.factor_vectors(tokens, size=4).collect()}
    words = sorted(want)
    a, b = (np.array([x[w] for w in words]) for x in (want, got))
    assert got.keys() == want.keys() and np.allclose(a @ a.T, b @ b.T, atol=1e-4)


def test_disk_of_vectors_stays_near_the_vocabulary(spark, tmp_path, monkeypatch):
    """Staged tables that the next step does not need are removed, and shuffles go with the step."""
    r = random.Random(6)
    rows = spark.createDataFrame([([f"w{min(int(r.paretovariate(0.3)), 3000)}" for _ in range(40)],) for _ in range(400)], "tokens array<string>").repartition(4)
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    words = co.factor_vectors(rows, size=20).count()
    left = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert words > 100 and sorted(left) == ["block", "vocabulary"]


def test_trained_lexicons_stage_the_vectors_alone(spark, tmp_path, monkeypatch):
    from revlens.plans import q_models as q

    seeds = ["the", "of", "this", "was"]
    rows = [(i, " ".join([*seeds, *texts()[i]]), "en", "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in/documents.parquet"))
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "out"))
    got = {r["label"]: r["seeds"].split() for r in __import__("__spark_entry__").queries()["expand_lexicon_trained"](spark, str(tmp_path / "in")).collect()}
    assert {"the", "this"} <= set(got["first"]) and {"of", "was"} <= set(got["second"])
    assert sorted(p.name.rsplit("-", 2)[0] for p in (tmp_path / "out").iterdir()) == ["block", "vocabulary", "word-vectors"]
    q._VECTORS.clear()
