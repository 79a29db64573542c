"""Random forests, driver rankings, word vectors and topics as Spark ML jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, IndexToString, Normalizer, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import labels as lb
from revlens.functions import text as tx
from revlens.operators import features as ft
from revlens.operators import forests
from revlens.operators.ranking import hash_split, sample_n

# Forest sizes and depths of the four models; Spark's depth limit stands for "no limit".
FORESTS = {"score": (300, 12), "trust": (500, 10), "hybrid": (300, 20), "text": (100, 30)}
TEXT_FEATURES = {"hybrid": 500, "text": 5000}
SEED = 42


@dataclass
class Fitted:
    """A fitted forest with what its reports need."""

    model: PipelineModel
    features: list[str]
    predictions: DataFrame
    label: str = "label_text"
    prediction: str = "predicted"
    indicators: list[str] = field(default_factory=list)

    @property
    def forest(self) -> RandomForestClassificationModel:
        return next(s for s in self.model.stages if isinstance(s, RandomForestClassificationModel))


def _forest(kind: str, trees: int | None, seed: int) -> RandomForestClassifier:
    default_trees, depth = FORESTS[kind]
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees or default_trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, maxMemoryInMB=512,
    )


def _fit(kind: str, df: DataFrame, key: str, target: Column, stages: list, features: list[str], trees, seed, stratify):
    rows = df.withColumn("label_text", target.cast("string")).dropna(subset=["label_text"])
    parts = hash_split(rows, key, [("train", 80), ("test", 20)], "label_text" if stratify else None, seed)
    train = ft.balanced_weights(parts.filter(F.col("part") == "train"), "label_text")
    indexer = StringIndexer(
        inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(rows)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    if kind in TEXT_FEATURES:  # thousands of terms, few of them in a row
        before = PipelineModel(stages=[*stages, indexer])
        forest = forests.fit(before.transform(train), _forest(kind, trees, seed), key, len(features), len(indexer.labels))
        model = PipelineModel(stages=[*before.stages, forest, back])
    else:
        model = Pipeline(stages=[*stages, indexer, _forest(kind, trees, seed), back]).fit(train)
    return Fitted(model, features, model.transform(parts.filter(F.col("part") == "test")))


def rf_score(
    df: DataFrame, key: str = "review_id", aspect: str = "Final_Aspect", polarity: str = "Sentiment_Polarity",
    trees: int | None = None, seed: int = SEED,
) -> Fitted:
    """Stars from aspect times polarity; plain random split."""
    rows = df.dropna(subset=["score", polarity, aspect])
    names = ft.labels_of(rows, aspect)
    rows = ft.polarity_interaction(rows, aspect, polarity, names)
    assemble = VectorAssembler(inputCols=["pol_" + n for n in names], outputCol="features")
    return _fit("score", rows, key, F.col("score").cast("int"), [assemble], names, trees, seed, False)


def _trust_rows(df: DataFrame, aspect: str, trust: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(F.col(trust) != -1).dropna(subset=[trust, aspect, *extra]).withColumn(
        aspect, tx.recode_label(F.col(aspect), trim=False)
    )


def rf_trust(
    df: DataFrame, key: str = "review_id", aspect: str = "Final_Aspect", trust: str = "Composite_Trust",
    trees: int | None = None, seed: int = SEED,
) -> Fitted:
    """Trust from one-hot aspects; stratified split."""
    rows = _trust_rows(df, aspect, trust)
    names = ft.labels_of(rows, aspect)
    rows = ft.one_hot(rows, aspect, names)
    assemble = VectorAssembler(inputCols=["is_" + n for n in names], outputCol="features")
    return _fit("trust", rows, key, F.col(trust).cast("int"), [assemble], names, trees, seed, True)


def rf_hybrid(
    df: DataFrame, key: str = "review_id", aspect: str = "Final_Aspect", text: str = "final_clean_content",
    trust: str = "Composite_Trust", trees: int | None = None, max_features: int | None = None, seed: int = SEED,
) -> Fitted:
    """Trust from one-hot aspects and TF-IDF; stratified split."""
    rows = _trust_rows(df, aspect, trust, (text,))
    names = ft.labels_of(rows, aspect)
    rows = ft.one_hot(rows, aspect, names)
    tfidf = ft.fit_tfidf(rows, text, max_features or TEXT_FEATURES["hybrid"])
    vocab = tfidf.stages[3].vocabulary
    indicators = ["is_" + n for n in names]
    stages = [*tfidf.stages, ft.hybrid_features(indicators, "text_features")]
    fitted = _fit("hybrid", rows, key, F.col(trust).cast("int"), stages, [*names, *vocab], trees, seed, True)
    fitted.indicators = names
    return fitted


def rf_text(
    df: DataFrame, key: str = "review_id", text: str = "final_clean_content", target: str = "Composite_Trust",
    trees: int | None = None, max_features: int | None = None, seed: int = SEED,
) -> Fitted:
    """Class name from TF-IDF; stratified split."""
    rows = df.dropna(subset=[text, target])
    tfidf = ft.fit_tfidf(rows, text, max_features or TEXT_FEATURES["text"], "features")
    label = lb.target_class(F.col(target).cast("string"))
    return _fit("text", rows, key, label, list(tfidf.stages), tfidf.stages[3].vocabulary, trees, seed, True)


def per_group(df: DataFrame, column: str, fit, report, groups: list[str] | None = None) -> DataFrame:
    """One model per value of ``column``, such as the ecosystem: their reports in one table tagged with the value."""
    fitted = {g: fit(df.filter(F.col(column) == g)) for g in (ft.labels_of(df, column) if groups is None else groups)}
    return tagged(fitted, column, report)


def tagged(fitted: dict[str, Fitted], column: str, report) -> DataFrame:
    return reduce(DataFrame.unionByName, [report(f).select(F.lit(g).alias(column), "*") for g, f in fitted.items()])


def importance_ranking(fitted: Fitted) -> DataFrame:
    """Feature importance and percentage, strongest first."""
    spark = fitted.predictions.sparkSession
    values = fitted.forest.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(fitted.features, values, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.withColumn("importance_pct", F.round(F.col("importance") * 100, 2)).orderBy(
        F.col("importance").desc(), "feature"
    )


def shapley_ranking(
    fitted: Fitted, df: DataFrame | None = None, key: str = "review_id", aspect: str = "Final_Aspect", rows: int = 500,
    positive: str = "1", seed: int = SEED,
) -> DataFrame:
    """Mean absolute Shapley value of each aspect, normalised to 100 percent.

    The values are those of the game of all features, aspects and terms, for a sample of the test part; ``df`` and
    ``aspect`` are not needed for it. ``shapley_values`` has the game of the aspects alone.
    """
    from revlens.operators.attribution import attribution_ranking, attributions

    ranking = attribution_ranking(attributions(fitted, key, rows, positive, seed), fitted.indicators)
    return ranking.withColumnRenamed("feature", "aspect").orderBy(F.col("impact").desc(), "aspect")


def shapley_values(
    fitted: Fitted, df: DataFrame, key: str = "review_id", aspect: str = "Final_Aspect", rows: int = 500,
    positive: str = "1", seed: int = SEED,
) -> DataFrame:
    """Exact Shapley values of the aspect indicators for a sample of the test part, against the aspect shares of ``df``.

    The players are the aspects alone; the text part keeps the row's own values. A row has aspect i, a background row
    aspect j. A coalition then matters only by whether it holds i and j, so four indicator settings (i, j, both,
    none) give both values exactly: phi_i = ((f(i) - f(none)) + (f(both) - f(j))) / 2 and phi_j likewise with j
    leaving. All settings of all sampled rows go through the model as one table.
    """
    names = fitted.indicators
    prepared = ft.one_hot(_trust_rows(df, aspect, "Composite_Trust", ()), aspect, names)
    share_rows = prepared.groupBy(aspect).agg(F.count("*").alias("n")).collect()  # one row per indicator column
    total = sum(r.n for r in share_rows)
    share = {r[aspect]: r.n / total for r in share_rows if r[aspect] in names}
    tested = fitted.predictions.select(*[F.col(f"`{c}`") for c in prepared.columns])
    sample = sample_n(tested, key, rows, seed).withColumn("own", F.col(aspect))

    settings = F.array(
        F.struct(F.lit("").alias("j"), F.lit(False).alias("with_own")),
        *[F.struct(F.lit(j).alias("j"), F.lit(w).alias("with_own")) for j in names for w in (False, True)],
        F.struct(F.lit("").alias("j"), F.lit(True).alias("with_own")),
    )
    # A few hundred rows fan out to thousands with a model evaluation each: spread them first.
    grid = sample.repartition(F.col(key)).select("*", F.inline(settings))
    on = {n: (F.col("j") == n) | (F.col("with_own") & (F.col("own") == n)) for n in names}
    grid = grid.select(
        *[F.col(f"`{c}`") for c in grid.columns if c not in {"is_" + n for n in names}],
        *[on[n].cast("double").alias("is_" + n) for n in names],
    )
    stages = [s for s in fitted.model.stages if not s.__class__.__name__.startswith(("StringIndexer", "IndexToString"))]
    index = next(s for s in fitted.model.stages if s.__class__.__name__ == "StringIndexerModel").labels.index(positive)
    scored = PipelineModel(stages=stages).transform(grid)
    scored = scored.select(key, "own", "j", "with_own", vector_to_array("probability")[index].alias("f"))

    per_row = scored.groupBy(key, "own").agg(
        F.max(F.when((F.col("j") == "") & ~F.col("with_own"), F.col("f"))).alias("f_none"),
        F.max(F.when((F.col("j") == "") & F.col("with_own"), F.col("f"))).alias("f_own"),
        F.map_from_entries(F.collect_list(F.when((F.col("j") != "") & ~F.col("with_own"), F.struct("j", "f")))).alias("f_j"),
        F.map_from_entries(F.collect_list(F.when((F.col("j") != "") & F.col("with_own"), F.struct("j", "f")))).alias("f_both"),
    )
    background = F.array(*[F.struct(F.lit(j).alias("bg"), F.lit(p).alias("share")) for j, p in sorted(share.items())])
    pairs = per_row.select("*", F.inline(background)).filter(F.col("bg") != F.col("own"))
    f_j, f_both = F.element_at("f_j", F.col("bg")), F.element_at("f_both", F.col("bg"))
    phi_own = F.col("share") * ((F.col("f_own") - F.col("f_none")) + (f_both - f_j)) / 2
    phi_bg = F.col("share") * ((F.col("f_none") - f_j) + (F.col("f_own") - f_both)) / 2
    parts = pairs.select(
        key, F.inline(F.array(F.struct(F.col("own").alias("aspect"), phi_own.alias("phi")),
                              F.struct(F.col("bg").alias("aspect"), phi_bg.alias("phi"))))
    )
    # Aspects that do not differ between a row and its background have value 0.
    zero = per_row.select(
        key, F.explode(tx.string_array(names)).alias("aspect"), F.lit(0.0).alias("phi")
    )
    return parts.unionByName(zero).groupBy(key, "aspect").agg(F.sum("phi").alias("phi"))


def word_vectors(
    tokens: DataFrame, column: str = "tokens", size: int = 100, window: int = 5, min_count: int = 3, seed: int = SEED,
    epochs: int = 5, partitions: int | None = None,
):
    """Skip-gram vectors; returns the fitted model, whose ``getVectors()`` has one row per word.

    The training is split as the input is, unless ``partitions`` says otherwise.
    """
    return Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, inputCol=column, outputCol="_vector", seed=seed,
        maxIter=epochs, numPartitions=partitions or max(tokens.rdd.getNumPartitions(), 1),
    ).fit(tokens)


def expand_lexicon(
    vectors: DataFrame, seeds: dict[str, list[str]], top: int = 10, min_similarity: float = 0.5, word: str = "word",
    vector: str = "vector", block: int = 256,
) -> DataFrame:
    """Each label's seeds with their nearest words by cosine.

    The seeds' vectors go to the tasks as one matrix. Every batch of vectors is multiplied by ``block`` of them at a
    time and hands on only its own best words per seed, so neither side's pairs are ever written out.
    """
    listed = [(label, w) for label, words in seeds.items() for w in dict.fromkeys(words)]
    spark = vectors.sparkSession
    found = vectors.filter(F.col(word).isin(sorted({w for _, w in listed}))).select(word, vector).collect()
    known = {r[0]: np.asarray(r[1], dtype="float64") for r in found}
    names = sorted(known)
    result_schema = "seed string, word string, similarity double"
    table = spark.createDataFrame(listed, "label string, seed string")
    own = table.select("label", F.col("seed").alias("word"))
    if not names:
        return own.withColumn("similarity", F.lit(None).cast("double"))
    matrix = np.stack([known[n] / (np.linalg.norm(known[n]) or 1.0) for n in names])

    def nearest(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["vector"].to_numpy()).astype("float64")
            norms = np.linalg.norm(rows, axis=1)
            units = rows / np.where(norms == 0, 1.0, norms)[:, None]
            words = batch["word"].to_numpy()
            for start in range(0, len(names), block):
                sims = units @ matrix[start : start + block].T
                # A seed is its own nearest word, so one more row than asked is kept.
                for s, name in enumerate(names[start : start + block]):
                    good = np.flatnonzero(sims[:, s] > min_similarity)
                    if len(good) > top + 1:
                        cut = np.partition(sims[good, s], -(top + 1))[-(top + 1)]
                        good = good[sims[good, s] >= cut]
                    if len(good):
                        yield pd.DataFrame({"seed": name, "word": words[good], "similarity": sims[good, s]})

    pairs = vectors.select(F.col(word).alias("word"), F.col(vector).alias("vector")).mapInPandas(nearest, result_schema)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("similarity").desc(), "word"))
    best = pairs.filter(F.col("word") != F.col("seed")).withColumn("_rank", rank).filter(F.col("_rank") <= top)
    grown = best.join(F.broadcast(table), "seed").groupBy("label", "word").agg(F.max("similarity").alias("similarity"))
    seeded = own.withColumn("similarity", F.lit(None).cast("double"))
    return seeded.unionByName(grown.join(F.broadcast(own), ["label", "word"], "left_anti"))


def lexicon_sets(expanded: DataFrame) -> DataFrame:
    """Sorted word set per label; a label holds at most its seeds and their nearest words."""
    return expanded.groupBy("label").agg(F.array_sort(F.collect_set("word")).alias("words"))


def topic_clusters(
    df: DataFrame, embedding: str = "embedding", anchor: str | None = None, k: int = 20, dims: int = 5,
    min_size: int = 300, seed: int = SEED, out: str = "topic",
) -> DataFrame:
    """Cluster unit embeddings reduced to ``dims`` directions; clusters under the minimum size become topic -1.

    With ``anchor`` each anchored row moves to the cluster that holds most rows of its anchor.
    """
    vectors = df.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))
    reduce = Pipeline(
        stages=[
            Normalizer(inputCol="_v", outputCol="_unit"),
            PCA(k=dims, inputCol="_unit", outputCol="_low"),
            KMeans(k=k, seed=seed, featuresCol="_low", predictionCol="_cluster"),
        ]
    )
    clustered = reduce.fit(vectors).transform(vectors).drop("_v", "_unit", "_low")
    if anchor:
        votes = clustered.filter(F.col(anchor) >= 0).groupBy(anchor, "_cluster").agg(F.count("*").alias("n"))
        home = votes.groupBy(anchor).agg(F.max_by("_cluster", F.struct("n", -F.col("_cluster"))).alias("_home"))
        # One row per anchor topic.
        clustered = clustered.join(F.broadcast(home), anchor, "left").withColumn(
            "_cluster", F.coalesce("_home", "_cluster")
        ).drop("_home")
    sizes = clustered.groupBy("_cluster").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    # At most k rows.
    kept = clustered.join(F.broadcast(sizes), "_cluster", "left")
    return kept.withColumn(out, F.when(F.col("_n").isNotNull(), F.col("_cluster")).otherwise(-1)).drop("_cluster", "_n")


def topic_words(df: DataFrame, topic: str, text: str, top: int = 10) -> DataFrame:
    """Best words per topic by class-based TF-IDF: tf x ln(1 + mean topic length / corpus frequency)."""
    rows = df.select(F.col(topic).alias("topic"), F.explode_outer(tx.split_words(F.col(text))).alias("word"))
    counted = rows.groupBy("topic", "word").agg(F.count("word").alias("tf"))
    tf = counted.filter(F.col("word").isNotNull())
    mean = counted.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("mean"))  # one row
    # Counted words only: a word has at most one row per topic here.
    corpus = F.sum("tf").over(Window.partitionBy("word"))
    scored = tf.withColumn("_corpus", corpus).join(F.broadcast(mean)).select(
        "topic", "word", "tf", (F.col("tf") * F.log(1 + F.col("mean") / F.col("_corpus"))).alias("weight"))
    window = Window.partitionBy("topic").orderBy(F.round("weight", 9).desc(), "word")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)


def topic_info(df: DataFrame, topic: str, text: str, top: int = 10) -> DataFrame:
    """Topic, size, name and representative words, largest first."""
    sizes = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("docs"))
    words = topic_words(df, topic, text, top).groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words")
    )
    joined = sizes.join(words, "topic", "left")
    name = F.concat_ws("_", F.col("topic").cast("string"), F.slice("words", 1, 4))
    return joined.select("topic", "docs", name.alias("name"), "words").orderBy(F.col("docs").desc(), "topic")


def model_confusion(fitted: Fitted) -> DataFrame:
    from revlens.operators.stats import confusion_matrix

    return confusion_matrix(fitted.predictions, fitted.label, fitted.prediction, [lx.CLASS_LOW, lx.CLASS_HIGH])


def model_accuracy(fitted: Fitted) -> DataFrame:
    from revlens.operators.stats import accuracy

    return accuracy(fitted.predictions, fitted.label, fitted.prediction)
