"""Splits, features, forests, attributions, word vectors and topics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import features as ft
from revlens.operators import models as md
from revlens.operators import ranking as rk


def labelled_rows(spark, n=400, seed=7):
    """Trust follows the aspect, with some noise; texts carry a weak signal."""
    rng = random.Random(seed)
    share = {"Technical Competence": 0.9, "Domain Sensitivity": 0.5, "Temporal Memory": 0.1}
    rows = []
    for i in range(n):
        aspect = rng.choice(list(share))
        trust = int(rng.random() < share[aspect])
        words = ["good" if trust and rng.random() < 0.4 else "bad" if rng.random() < 0.3 else "plain", "app", rng.choice("xyz") * 3]
        rows.append((f"r{i}", aspect, 1 if trust else -1, trust, 5 if trust else 1, " ".join(words)))
    return spark.createDataFrame(
        rows,
        "review_id string, Final_Aspect string, Sentiment_Polarity int, Composite_Trust int, score int, final_clean_content string",
    )


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(labelled_rows(spark).collect())


def test_split_is_disjoint_exhaustive_and_exact(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("c"))
    out = rk.hash_split(df, "id", [("train", 70), ("val", 15), ("test", 15)], "c", seed=1, digits=1)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    for r in out.groupBy("c").pivot("part", ["train", "val", "test"]).count().fillna(0).collect():
        n = r.train + r.val + r.test
        assert r.train == n * 70 // 100 and r.train + r.val == n * 85 // 100


@pytest.mark.parametrize("digits", [1, 4])
def test_split_does_not_depend_on_the_prefix_length(spark, digits):
    df = spark.range(500).withColumn("c", F.col("id") % 3)
    got = rk.hash_split(df, "id", [("a", 50), ("b", 50)], "c", digits=digits).filter("part = 'a'")
    base = rk.hash_split(df, "id", [("a", 50), ("b", 50)], "c", digits=2).filter("part = 'a'")
    assert {r.id for r in got.collect()} == {r.id for r in base.collect()}


def test_last_pass_of_a_split_has_no_shuffle(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    plan = rk.hash_split(df, "id", [("a", 50), ("b", 50)], "c")._jdf.queryExecution().executedPlan().toString()
    rows, cuts = plan.split("BroadcastExchange", 1)  # the rows' side of the join is printed first
    assert "BroadcastHashJoin" in rows and "Exchange hashpartitioning" not in rows and "Sort " not in rows and "Range" in rows
    assert "Window" in cuts  # the histogram of hash prefixes


def test_split_of_a_tiny_class_and_of_copies(spark):
    tiny = spark.createDataFrame([(1, "x")], "id int, c string")
    assert [r.part for r in rk.hash_split(tiny, "id", [("train", 70), ("test", 30)], "c").collect()] == ["test"]
    copies = spark.range(200).select(F.when(F.col("id") < 120, 0).otherwise(F.col("id")).alias("id"))
    out = rk.hash_split(copies, "id", [("train", 80), ("test", 20)])
    assert out.count() == 200 and out.filter("id = 0").select("part").distinct().count() == 1


def test_sample_is_fixed_and_repeatable(spark):
    a = {r.id for r in rk.sample_n(spark.range(1000), "id", 50, 3).collect()}
    assert len(a) == 50 and a == {r.id for r in rk.sample_n(spark.range(1000).repartition(7), "id", 50, 3).collect()}


def test_merge_rare_classes(spark):
    scores = [("a", 5)] * 20 + [("a", 1)] * 3 + [("a", 2)] * 10 + [("b", 1)] * 4
    df = spark.createDataFrame(scores, "app string, score int")
    out = {(r.app, r.score): r["count"] for r in ft.merge_rare_classes(df, ["app"]).groupBy("app", "score").count().collect()}
    assert out == {("a", 5): 23, ("a", 2): 10}


def test_weights_add_up(rows):
    out = ft.balanced_weights(rows, "Composite_Trust").groupBy("Composite_Trust").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 200) < 1e-6 for r in out)


def test_rows_of_a_class_or_an_ecosystem_are_not_gathered(spark, rows):
    from revlens.plans.q_models import planted

    frames = [ft.balanced_weights(rows, "Composite_Trust"), planted(rows.withColumn("ecosystem", F.when(F.col("score") == 5, "x").otherwise("y")))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in frames:
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
            assert frame.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_tfidf(texts, limit):
    import re

    docs = []
    for text in texts:
        words = [w for w in re.split(r"[\W]+", text.lower()) if len(w) >= 2]
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    total, df = {}, {}
    for doc in docs:
        for t in doc:
            total[t] = total.get(t, 0) + 1
        for t in set(doc):
            df[t] = df.get(t, 0) + 1
    vocab = sorted(total, key=lambda t: (-total[t], t))[:limit]
    out = {}
    for i, doc in enumerate(docs):
        raw = {t: doc.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab if t in doc}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return out


@pytest.mark.parametrize("limit", [3, 8, 25, 1000])
def test_vocabulary_counts_only_pairs_that_may_be_in_it(spark, limit, monkeypatch):
    r = random.Random(limit)
    words = [f"w{min(int(r.expovariate(0.4)), 9)}" for _ in range(1200)]
    texts = [" ".join(words[i: i + 12]) for i in range(0, 1200, 12)] + ["", None, "w0", "rare one", "w1 w1 w1 w1"]
    total, df = {}, {}
    for t in texts:
        own = [w for w in (t or "").split() if len(w) > 1]
        terms = own + [f"{a} {b}" for a, b in zip(own, own[1:])]
        for x in terms:
            total[x] = total.get(x, 0) + 1
        for x in set(terms):
            df[x] = df.get(x, 0) + 1
    want = [(x, total[x], df[x]) for x in sorted(total, key=lambda x: (-total[x], x))[:limit]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(x) for x in ft.vocabulary(rows, limit, "text").collect()] == want
    counted = []
    plain = ft.materialised
    monkeypatch.setattr(ft, "materialised", lambda table, name: plain(table, name) if name != "vocabulary" else counted.append(table) or plain(table, name))
    ft.vocabulary(rows, 3, "text")
    plan = counted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # pairs meet the frequent words before they are counted
    monkeypatch.setattr(ft, "MANY_WORDS", 0)
    assert [tuple(x) for x in ft.vocabulary(rows, limit, "text").collect()] == want


def test_tfidf_against_brute_force_in_both_forms(spark):
    texts = ["Good app, good price", "bad app", "good price is good", "a b", "سلام خوب است خوب", "bad bad price app"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    expected = brute_tfidf(texts, 8)
    long = {(r.doc_id, r.term): r.weight for r in ft.tfidf(df, "doc_id", "text", 8).collect()}
    assert long.keys() == expected.keys() and all(abs(long[k] - expected[k]) < 1e-9 for k in expected)
    model = ft.fit_tfidf(df, "text", 8)
    vocab = model.stages[3].vocabulary
    sparse = {
        (r.doc_id, vocab[int(i)]): v
        for r in model.transform(df).collect()
        for i, v in zip(r.text_features.indices, r.text_features.values)
    }
    assert sparse.keys() == expected.keys() and all(abs(sparse[k] - expected[k]) < 1e-9 for k in expected)


def accuracy(fitted):
    return md.model_accuracy(fitted).first().accuracy


def majority(fitted):
    counts = [r["count"] for r in fitted.predictions.groupBy("label_text").count().collect()]
    return max(counts) / sum(counts)


def test_forests_beat_the_majority_and_repeat(rows):
    fitted = md.rf_trust(rows, trees=20)
    assert accuracy(fitted) > majority(fitted)
    ranking = md.importance_ranking(fitted).collect()
    assert {r.feature for r in ranking} == {"Technical Competence", "Domain Sensitivity", "Temporal Memory"}
    assert abs(sum(r.importance for r in ranking) - 1) < 1e-9
    again = md.importance_ranking(md.rf_trust(rows, trees=20)).collect()
    assert [r.feature for r in again] == [r.feature for r in ranking]
    score = md.rf_score(rows, trees=10)
    assert accuracy(score) > 0.9  # polarity follows the stars in these rows


def test_text_forest_and_confusion(rows):
    fitted = md.rf_text(rows, trees=10, max_features=50)
    cells = {(r.label, r.prediction): r.n for r in md.model_confusion(fitted).collect()}
    assert len(cells) == 4 and sum(cells.values()) == fitted.predictions.count()


def test_shapley_values_add_up(rows):
    """Per row they sum to f(x) minus the mean of f over the aspect shares; the ranking finds the planted order."""
    fitted = md.rf_hybrid(rows, trees=15, max_features=30)
    values = md.shapley_values(fitted, rows, rows=40)
    sums = {r.review_id: r.s for r in values.groupBy("review_id").agg(F.sum("phi").alias("s")).collect()}
    names = fitted.indicators
    share = {r.Final_Aspect: r["count"] / 400 for r in rows.groupBy("Final_Aspect").count().collect()}
    sample = rows.filter(F.col("review_id").isin(list(sums)))
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    stages = [s for s in fitted.model.stages if not type(s).__name__.startswith(("StringIndexer", "IndexToString"))]
    model = PipelineModel(stages=stages)

    def predict(aspect):
        hot = ft.one_hot(sample.withColumn("_a", F.col("Final_Aspect") if aspect is None else F.lit(aspect)), "_a", names)
        scored = model.transform(hot).select("review_id", vector_to_array("probability")[1].alias("f"))
        return {r.review_id: r.f for r in scored.collect()}

    own, by_aspect = predict(None), {a: predict(a) for a in names}
    for i, total in sums.items():
        assert abs(total - (own[i] - sum(share[a] * by_aspect[a][i] for a in names))) < 1e-9
    ranking = md.shapley_ranking(fitted, rows, rows=40).collect()
    assert abs(sum(r.impact_pct for r in ranking) - 100) < 1e-6 and ranking[-1].aspect == "Domain Sensitivity"


def test_expand_lexicon_against_brute_force(spark):
    rng = random.Random(5)
    vecs = {f"w{i}": [rng.gauss(0, 1) for _ in range(6)] for i in range(120)}
    df = spark.createDataFrame([(w, v) for w, v in vecs.items()], "word string, vector array<double>").repartition(4)
    seeds = {"p": ["w1", "w2", "missing"], "q": ["w3", "w1"]}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    expected = {}
    for label, words in seeds.items():
        expected[label] = set(words)
        for s in words:
            if s in vecs:
                near = sorted(((cosine(vecs[s], v), w) for w, v in vecs.items() if w != s), key=lambda t: (-t[0], t[1]))[:5]
                expected[label] |= {w for c, w in near if c > 0.3}
    got = md.lexicon_sets(md.expand_lexicon(df, seeds, 5, 0.3)).collect()
    assert {r.label: set(r.words) for r in got} == expected


def test_word_vectors_and_topics(spark):
    texts = [["fast", "good", "app"], ["slow", "bad", "app"], ["fast", "nice", "app"]] * 10
    model = md.word_vectors(spark.createDataFrame([(t,) for t in texts], "tokens array<string>"), size=8, partitions=1)
    assert {r.word for r in model.getVectors().collect()} == {"fast", "good", "app", "slow", "bad", "nice"}
    rng = random.Random(2)
    points = [
        (i, [c * 5 + rng.gauss(0, 0.1) if j == c else rng.gauss(0, 0.1) for j in range(6)], f"word{c} common", c if i % 2 else -1)
        for i in range(90)
        for c in [0 if i < 50 else 1 if i < 85 else 2]
    ]
    df = spark.createDataFrame(points, "id int, embedding array<double>, text string, anchor int")
    out = md.topic_clusters(df, k=3, dims=2, min_size=20, anchor="anchor")
    sizes = {r.topic: r["count"] for r in out.groupBy("topic").count().collect()}
    assert sum(sizes.values()) == 90 and all(n >= 20 for t, n in sizes.items() if t != -1)
    info = md.topic_info(out, "topic", "text").collect()
    assert sum(r.docs for r in info) == 90 and all(r.words for r in info)
