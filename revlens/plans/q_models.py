"""Queries: sampling, features, models, word vectors and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import text as tx
from revlens.operators import attribution as at
from revlens.operators import cooccurrence as co
from revlens.operators import density as dn
from revlens.operators import features as ft
from revlens.operators import labelling as lab
from revlens.operators import models as md
from revlens.operators import ranking as rk
from revlens.operators import stats as st
from revlens.plans import demo
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import PARTS, documents, table
from revlens.plans.q_labels import CHAIN, TRUSTED, labelled, trusted
from revlens.session import materialised, scratch_path
from revlens.sources import sinks


@query(
    "stratified_split_70_15_15",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'val' ELSE 'test' END AS part
       FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS r,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return rk.hash_split(rows, "o_orderkey", [("train", 70), ("val", 15), ("test", 15)], "o_orderpriority")


@query(
    "stratified_split_per_file",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority,
       CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'val' ELSE 'test' END AS part
       FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS r,
             count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders)""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rk.hash_split(rows, "o_orderkey", [("train", 70), ("val", 15), ("test", 15)], ["o_orderstatus", "o_orderpriority"])


@query(
    "train_test_80_20",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN r * 100 <= 80 * n THEN 'train' ELSE 'test' END AS part
       FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(o_orderkey, ':42'))) AS r,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return rk.hash_split(rows, "o_orderkey", [("train", 80), ("test", 20)], "o_orderstatus", 42)


@query(
    "train_test_plain",
    """SELECT event_id, CASE WHEN r * 100 <= 80 * n THEN 'train' ELSE 'test' END AS part
       FROM (SELECT event_id, row_number() OVER (ORDER BY md5(concat(event_id, ':42'))) AS r, count(*) OVER () AS n FROM events)""",
)
def _(spark, folder):
    return rk.hash_split(table(spark, folder, "events").select("event_id"), "event_id", [("train", 80), ("test", 20)], None, 42)


@query(
    "merge_rare_classes",
    """WITH c AS (SELECT source, n_words AS score, count(*) AS k FROM d GROUP BY ALL),
         m AS (SELECT source, sum(k) AS total, arg_max(score, (k, -score)) AS common FROM c GROUP BY source)
       SELECT doc_id, d.source, CASE WHEN c.k < 10 THEN m.common ELSE d.n_words END AS score
       FROM d JOIN c ON d.source = c.source AND d.n_words = c.score JOIN m ON d.source = m.source WHERE m.total >= 10""".replace(
        "WITH c", "WITH d AS (SELECT doc_id, source, CAST(1 + doc_id * doc_id % 7 AS INT) AS n_words FROM documents), c"
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", (1 + F.col("doc_id") * F.col("doc_id") % 7).cast("int").alias("score")
    )
    return ft.merge_rare_classes(rows, ["source"]).select("doc_id", "source", "score")


@query("sample_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat(o_orderkey, ':42')), o_orderkey LIMIT 500")
def _(spark, folder):
    return rk.sample_n(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 42)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderpriority = '{p}' AS INT)::DOUBLE AS \"is_{p}\"" for p in _PRIORITIES) + " FROM orders",
)
def _(spark, folder):
    return ft.one_hot(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").drop("o_orderpriority")


_ASPECT_NAMES = sorted([*demo.ASPECTS, "Noise"])


@query(
    "polarity_interaction",
    sq.reviews(
        "SELECT review_id, "
        + ", ".join(
            f"CASE WHEN \"Final_Aspect\" = '{a}' THEN \"Sentiment_Polarity\" ELSE 0 END::DOUBLE AS \"pol_{a}\"" for a in _ASPECT_NAMES
        )
        + " FROM labelled",
        *CHAIN,
    ),
)
def _(spark, folder):
    rows = labelled(spark, folder).select("review_id", "Final_Aspect", "Sentiment_Polarity")
    return ft.polarity_interaction(rows, "Final_Aspect", labels=_ASPECT_NAMES).drop("Final_Aspect", "Sentiment_Polarity")


@query(
    "balanced_weights",
    """SELECT doc_id, quality, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * n) AS weight
       FROM labels JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY 1) USING (quality)""",
)
def _(spark, folder):
    return ft.balanced_weights(table(spark, folder, "labels").select("doc_id", "quality"), "quality")


# Terms of a text in SQL: tokens of two or more word characters, and pairs of neighbours.
_TERMS = rf"""tok AS (SELECT conv_id * 100 + turn AS doc, list_filter(regexp_split_to_array(lower(text), '[^{sq.W}]+'), lambda t: length(t) >= 2) AS w
  FROM conversations),
terms AS (SELECT doc, unnest(w) AS term FROM tok UNION ALL
  SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS term FROM tok),
vocab AS (SELECT term, count(*) AS total, count(DISTINCT doc) AS df FROM terms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500),
weights AS (SELECT doc, term, count(*) AS tf, count(*) * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)::DOUBLE) + 1) AS raw
  FROM terms JOIN vocab USING (term) GROUP BY doc, term, df)"""


def _turns(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), "text")


@query(
    "tfidf",
    f"WITH {_TERMS} SELECT doc, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)), 9) AS weight FROM weights",
)
def _(spark, folder):
    rows = ft.tfidf(_turns(spark, folder), "doc", "text", 500)
    return rows.withColumn("weight", F.round("weight", 9))


@query(
    "tfidf_vectors",
    f"""WITH {_TERMS} SELECT doc, count(*) AS terms, round(max(w), 6) AS top_weight, round(sum(w), 6) AS weight_sum
        FROM (SELECT doc, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM weights) GROUP BY doc""",
)
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array

    rows = _turns(spark, folder)
    vectors = ft.fit_tfidf(rows, "text", 500).transform(rows)
    values = F.filter(vector_to_array("text_features"), lambda x: x > 0)
    out = vectors.select("doc", values.alias("v")).filter(F.size("v") > 0)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "doc", F.size("v").cast("bigint").alias("terms"), F.round(F.array_max("v"), 6).alias("top_weight"),
        F.round(total, 6).alias("weight_sum"),
    )


STAGE = ["review_id", "ecosystem", "score", "final_clean_content", "Final_Aspect", "Sentiment_Polarity", "Composite_Trust"]


def trusted_stage(spark, folder):
    """The labelled stage, written once: several jobs of a model read it."""
    return materialised(trusted(spark, folder).select(*STAGE), "trusted")


def state_of(spark, folder):
    """What the folder's tables are now: files, times and sizes. Contents are not read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.parquet").select("path", "modificationTime", "length")
    return spark.sparkContext.applicationId, folder, tuple(sorted(tuple(r) for r in files.collect()))


def planted_stage(spark, folder):
    """The labelled stage with a target that SQL knows, written once."""
    return materialised(planted(trusted_stage(spark, folder)), "planted")


def planted(rows):
    """The labelled rows with a target that SQL knows: whether a row has its ecosystem's commonest aspect.

    Stars follow it, and so does one more word of the text. There is one commonest aspect per ecosystem, and it is broadcast: a
    shuffle by ecosystem would leave each ecosystem's texts to one task and one file.
    """
    counts = rows.groupBy("ecosystem", "Final_Aspect").agg(F.count("*").alias("n"))
    top = counts.groupBy("ecosystem").agg(F.min_by("Final_Aspect", F.struct(-F.col("n"), "Final_Aspect")).alias("top"))
    rows = rows.join(F.broadcast(top), "ecosystem").withColumn("Composite_Trust", (F.col("Final_Aspect") == F.col("top")).cast("int"))
    word = F.when(F.col("Composite_Trust") == 1, "plantedyes").otherwise("plantedno")
    return rows.select(
        "review_id", "ecosystem", (4 * F.col("Composite_Trust") + 1).alias("score"), F.concat_ws(" ", "final_clean_content", word).alias("text"),
        "final_clean_content", "Final_Aspect", F.lit(1).alias("Sentiment_Polarity"), "Composite_Trust")


_TRUST_MODELS: dict = {}


def trust_models(spark, folder):
    """The trust forest of each ecosystem, fitted once for all queries that report on the same state of the tables."""
    place = state_of(spark, folder)
    if place not in _TRUST_MODELS:
        rows = planted_stage(spark, folder)
        groups = ft.labels_of(rows, "ecosystem")
        _TRUST_MODELS.clear()
        _TRUST_MODELS[place] = {g: md.rf_trust(rows.filter(F.col("ecosystem") == g)) for g in groups}
    return _TRUST_MODELS[place]


@query(
    "hybrid_features",
    sq.reviews(
        rf"""SELECT review_id, CAST((SELECT count(DISTINCT "Final_Aspect") FROM trusted) + 500 AS INT) AS width,
             CAST(1 + count(term) AS INT) AS filled
             FROM trusted LEFT JOIN (SELECT DISTINCT doc, term FROM terms WHERE term IN (SELECT term FROM vocab)) ON doc = review_id
             GROUP BY review_id""",
        *TRUSTED,
        rf"""tok AS (SELECT review_id AS doc, list_filter(regexp_split_to_array(lower(t), '[^{sq.W}]+'), lambda x: length(x) >= 2) AS w
             FROM trusted)""",
        """terms AS (SELECT doc, unnest(w) AS term FROM tok UNION ALL
             SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS term FROM tok)""",
        "vocab AS (SELECT term, count(*) AS total FROM terms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500)",
    ),
)
def _(spark, folder):
    rows = trusted_stage(spark, folder)
    names = ft.labels_of(rows, "Final_Aspect")
    hot = ft.one_hot(rows, "Final_Aspect", names)
    vectors = ft.fit_tfidf(hot, "final_clean_content", 500).transform(hot)
    out = ft.hybrid_features(["is_" + n for n in names], "text_features").transform(vectors)
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return out.select("review_id", F.size(v).alias("width"), F.size(F.filter(v, lambda x: x != 0)).alias("filled"))


_PLANTED = [
    """top AS (SELECT ecosystem, "Final_Aspect" AS aspect, count(*) AS n FROM trusted GROUP BY ecosystem, "Final_Aspect"
         QUALIFY row_number() OVER (PARTITION BY ecosystem ORDER BY count(*) DESC, "Final_Aspect") = 1)""",
    """planted AS (SELECT review_id, ecosystem, CAST("Final_Aspect" = aspect AS INT) AS y FROM trusted JOIN top USING (ecosystem))""",
]


def _held_out(*classes):
    """The held-out fifth of each ecosystem (and class), in the order of the same hash."""
    group = ", ".join(["ecosystem", *classes])
    return f"""held AS (SELECT * FROM (SELECT ecosystem, y, row_number() OVER (PARTITION BY {group} ORDER BY md5(concat(review_id, ':42'))) AS r,
      count(*) OVER (PARTITION BY {group}) AS n FROM planted) WHERE r * 100 > 80 * n)"""


def _all_right(label):
    """Confusion cells of a model that finds the planted target on all rows it has not seen."""
    return f"SELECT ecosystem, {label} AS label, {label} AS predicted, count(*) AS n FROM held GROUP BY ALL"


def _cells(fitted):
    return fitted.predictions.groupBy(F.col(fitted.label).alias("label"), F.col(fitted.prediction).alias("predicted")).agg(F.count("*").alias("n"))


@query("rf_score", sq.reviews(_all_right("(4 * y + 1)::VARCHAR"), *TRUSTED, *_PLANTED, _held_out()))
def _(spark, folder):
    return md.per_group(planted_stage(spark, folder), "ecosystem", md.rf_score, _cells)


@query("rf_trust", sq.reviews(_all_right("y::VARCHAR"), *TRUSTED, *_PLANTED, _held_out("y")))
def _(spark, folder):
    return md.tagged(trust_models(spark, folder), "ecosystem", _cells)


@query("rf_hybrid", sq.reviews(_all_right("y::VARCHAR"), *TRUSTED, *_PLANTED, _held_out("y")))
def _(spark, folder):
    return md.per_group(planted_stage(spark, folder), "ecosystem", lambda rows: md.rf_hybrid(rows, text="text"), _cells)


@query(
    "rf_text",
    sq.reviews("""SELECT ecosystem, CAST(sum(n) AS BIGINT) AS test_rows, max(n) AS majority, true AS beats_majority
        FROM (SELECT ecosystem, y, count(*) AS n FROM held GROUP BY ecosystem, y) GROUP BY 1""", *TRUSTED, *_PLANTED, _held_out("y")),
)
def _(spark, folder):
    """Terms among thousands: more held-out rows are right than in the larger class."""
    def report(fitted):
        cells = _cells(fitted)
        classes = cells.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
        return classes.agg(F.sum("n").alias("test_rows"), F.max("n").alias("majority"), (F.sum("right") > F.max("n")).alias("beats_majority"))

    return md.per_group(planted_stage(spark, folder), "ecosystem", lambda rows: md.rf_text(rows, text="text"), report)


@query("importance_ranking", sq.reviews("SELECT ecosystem, aspect AS feature, true AS above_all FROM top", *TRUSTED, *_PLANTED))
def _(spark, folder):
    def report(fitted):
        first, second = (md.importance_ranking(fitted).limit(2).collect() + [None])[:2]  # a top-2 report
        table = fitted.predictions.sparkSession.createDataFrame([(first.feature, second is None or first.importance > second.importance)],
                                                                "feature string, above_all boolean")
        return table

    return md.tagged(trust_models(spark, folder), "ecosystem", report)


@query("save_model", sq.reviews("SELECT DISTINCT ecosystem, 1.0::DOUBLE AS same_share FROM trusted", *TRUSTED))
def _(spark, folder):
    def report(fitted):
        path = scratch_path(spark, "model")
        sinks.save_model(fitted.model, path)
        loaded = sinks.load_model(path)
        kept = [c for c in fitted.predictions.columns if c.startswith("is_")]
        again = loaded.transform(fitted.predictions.select("review_id", "label_text", *[F.col(f"`{c}`") for c in kept]))
        both = again.select("review_id", F.col("predicted").alias("reloaded")).join(
            fitted.predictions.select("review_id", "predicted"), "review_id"
        )
        return st.accuracy(both, "predicted", "reloaded").withColumnRenamed("accuracy", "same_share")

    return md.tagged(trust_models(spark, folder), "ecosystem", report)


@query(
    "shapley_ranking",
    sq.reviews("SELECT ecosystem, aspect, true AS adds_up, true AS speaks_for, true AS has_terms FROM top", *TRUSTED, *_PLANTED),
)
def _(spark, folder):
    """The aspect with the greatest mean value, whether values add up to the prediction, are positive where it holds, and
    reach the terms of the text."""
    rows = planted_stage(spark, folder)

    def report(part):
        fitted = md.rf_hybrid(part)
        values = materialised(at.attributions(fitted, rows=200), "values")
        aspect = at.attribution_ranking(values, fitted.indicators).select(F.col("feature").alias("aspect")).limit(1)
        sums = values.groupBy("review_id").agg(F.sum("phi").alias("s"), F.first(F.col("prediction") - F.col("mean")).alias("f"))
        adds = sums.agg(F.coalesce(F.max(F.abs(F.col("s") - F.col("f"))) < 1e-9, F.lit(False)).alias("adds_up"))
        held = values.join(part.filter("Composite_Trust = 1").select("review_id"), "review_id", "left_semi").join(F.broadcast(aspect), F.col("feature") == F.col("aspect"))
        speaks = held.agg(F.coalesce(F.min("phi") > 0, F.lit(False)).alias("speaks_for"))
        terms = values.agg(F.coalesce(F.bool_or(~F.col("feature").isin(fitted.indicators)), F.lit(False)).alias("has_terms"))
        return aspect.join(F.broadcast(adds)).join(F.broadcast(speaks)).join(F.broadcast(terms))  # one row each

    groups = ft.labels_of(rows, "ecosystem")
    return reduce(DataFrame.unionByName, [report(rows.filter(F.col("ecosystem") == g)).select(F.lit(g).alias("ecosystem"), "*") for g in groups])


def _tokens(spark, folder):
    rows = documents(spark, folder, "doc_id", "text", parts=PARTS)
    clean = rows.select("doc_id", tx.clean_symbols_letters(F.col("text")).alias("clean"))
    from revlens.operators.filters import sentences

    return sentences(clean, "clean", 3).select("doc_id", "tokens")


_VOCABULARY = f"""WITH t AS (SELECT {sq.words(sq.clean_symbols('text'))} AS w FROM documents)
  SELECT word, CAST(100 AS INT) AS dims FROM (SELECT unnest(w) AS word FROM t WHERE len(w) > 2) GROUP BY word HAVING count(*) >= 3"""


def trained_vectors(spark, folder):
    """Word vectors of the documents, made once for the same state of the tables."""
    place = state_of(spark, folder)
    if place not in _VECTORS:
        _VECTORS.clear()
        _VECTORS[place] = materialised(co.factor_vectors(_tokens(spark, folder)), "word-vectors")
    return _VECTORS[place]


_VECTORS: dict = {}


@query(
    "cooccurrences",
    f"""WITH t AS (SELECT {sq.words(sq.clean_symbols('text'))} AS w FROM documents),
        p AS (SELECT unnest(w[1:greatest(len(w) - o, 0)]) AS a, unnest(w[1 + o:]) AS b FROM t, (VALUES (1), (2), (3), (4), (5)) d(o) WHERE len(w) > 2)
        SELECT word, count(*) AS total, count(DISTINCT other) AS others
        FROM (SELECT a AS word, b AS other FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1""",
)
def _(spark, folder):
    return co.cooccurrences(_tokens(spark, folder), totals=True)


@query("word_vectors", _VOCABULARY)
def _(spark, folder):
    return trained_vectors(spark, folder).select("word", F.size("vector").alias("dims"))


def _as_array(column):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


@query(
    "expand_lexicon_trained",
    f"SELECT * FROM (VALUES ('first', {sq.sql_list(sorted(demo.POSITIVE))}), ('second', {sq.sql_list(sorted(demo.NEGATIVE))})) s(label, seeds)".replace(
        "SELECT *", "SELECT label, array_to_string(seeds, ' ') AS seeds"),
)
def _(spark, folder):
    seeds = {"first": demo.POSITIVE, "second": demo.NEGATIVE}
    sets = md.lexicon_sets(md.expand_lexicon(trained_vectors(spark, folder), seeds, 8, 0.45))
    listed = F.create_map(*[x for k, ws in seeds.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    held = F.array_sort(F.array_intersect("words", F.element_at(listed, F.col("label"))))
    return sets.select("label", F.array_join(held, " ").alias("seeds"))


_SEEDS = {f"label{i}": [f"v{i}", f"v{i + 10}", f"v{i + 20}", "v999999"] for i in range(10)}
_SEED_VALUES = ", ".join(f"('{k}', '{w}')" for k, ws in _SEEDS.items() for w in ws)


@query(
    "expand_lexicon",
    f"""WITH seeds AS (SELECT * FROM (VALUES {_SEED_VALUES}) s(label, seed)),
        vecs AS (SELECT concat('v', vec_id) AS word, embedding::DOUBLE[] AS v FROM embeddings),
        sims AS (SELECT a.word AS seed, b.word, list_cosine_similarity(a.v, b.v) AS s FROM vecs a JOIN vecs b ON a.word <> b.word
                 WHERE a.word IN (SELECT seed FROM seeds)),
        best AS (SELECT * FROM sims WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY s DESC, word) <= 10),
        grown AS (SELECT label, word, max(s) AS s FROM best JOIN seeds USING (seed) GROUP BY ALL)
        SELECT label, seed AS word, NULL::DOUBLE AS similarity FROM seeds
        UNION ALL SELECT label, word, round(s, 6) FROM grown WHERE (label, word) NOT IN (SELECT (label, seed) FROM seeds)""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector")
    )
    return md.expand_lexicon(vectors, _SEEDS, 10, 0.2).withColumn("similarity", F.round("similarity", 6))


_MIN_TOPIC = 20


def _clustered(spark, folder):
    """All documents by the topics of hashed term frequencies."""
    docs = documents(spark, folder, "doc_id", "text")
    words = lab.seed_anchor(docs, demo.TOPICS, "text").withColumn("_w", tx.split_words(F.coalesce("text", F.lit(""))))
    hashed = HashingTF(numFeatures=64, inputCol="_w", outputCol="_tf").transform(words)
    rows = hashed.select("doc_id", "text", "anchor", _as_array("_tf").alias("embedding"))
    return md.topic_clusters(materialised(rows, "vectors"), anchor="anchor", k=10, min_size=_MIN_TOPIC)


# A copy of ``embeddings`` with a density that SQL can state: each label's vectors are moved along an axis of their own, and
# every fiftieth vector far away from all others.
_STRAY = "vec_id % 50 = 7"


@query(
    "topic_clusters",
    f"""WITH e AS (SELECT vec_id, label, {_STRAY} AS stray FROM embeddings),
        s AS (SELECT label, count(*) AS docs, min(vec_id) AS first FROM e WHERE NOT stray GROUP BY label HAVING count(*) >= {_MIN_TOPIC}),
        t AS (SELECT label, row_number() OVER (ORDER BY docs DESC, first) - 1 AS topic FROM s),
        r AS (SELECT vec_id, CAST(coalesce(topic, -1) AS INT) AS topic FROM e LEFT JOIN t ON t.label = e.label AND NOT stray)
        SELECT vec_id, topic, count(*) OVER (PARTITION BY topic) AS docs FROM r""",
)
def _(spark, folder):
    axis, far = F.pmod("label", F.size("embedding")), F.pmod("vec_id", F.size("embedding"))
    moved = F.transform("embedding", lambda c, i: c.cast("double") + F.when(F.expr(_STRAY), F.when(i == far, 1000 + 37 * F.col("vec_id")).otherwise(0))
                        .otherwise(F.when(i == axis, 8).otherwise(0)))
    rows = table(spark, folder, "embeddings").select("vec_id", moved.alias("v"))
    topics = dn.density_topics(rows, "vec_id", "v", min_size=_MIN_TOPIC, min_samples=5).select("vec_id", "topic")
    sizes = topics.groupBy("topic").agg(F.count("*").alias("docs"))
    return topics.join(sizes, "topic").select("vec_id", "topic", "docs")


@query("topic_clusters_kmeans", "SELECT count(*) AS docs, 0::BIGINT AS too_small FROM documents")
def _(spark, folder):
    sizes = _clustered(spark, folder).groupBy("topic").agg(F.count("*").alias("docs"))
    small = (F.col("topic") >= 0) & (F.col("docs") < _MIN_TOPIC)
    return sizes.agg(F.sum("docs").alias("docs"), F.count_if(small).alias("too_small"))


@query("topic_info", "SELECT count(*) AS docs, 10::BIGINT AS words FROM documents")
def _(spark, folder):
    info = md.topic_info(_clustered(spark, folder), "topic", "text")
    return info.agg(F.sum("docs").alias("docs"), F.max(F.size("words")).cast("bigint").alias("words"))


@query(
    "topic_words",
    f"""WITH tok AS (SELECT lang AS topic, unnest({sq.words('text')}) AS word FROM documents),
        tf AS (SELECT topic, word, count(*) AS tf FROM tok GROUP BY ALL),
        f AS (SELECT word, sum(tf) AS f FROM tf GROUP BY 1),
        a AS (SELECT avg(n) AS mean FROM (SELECT topic, sum(tf) AS n FROM tf GROUP BY 1))
        SELECT topic, word, tf, round(tf * ln(1 + mean / f), 6) AS weight FROM tf JOIN f USING (word), a
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(tf * ln(1 + mean / f), 9) DESC, word) <= 10""",
)
def _(spark, folder):
    words = md.topic_words(documents(spark, folder, "doc_id", "lang", "text", parts=PARTS), "lang", "text", 10)
    return words.select("topic", "word", "tf", F.round("weight", 6).alias("weight"))


@query(
    "balance_classes",
    sq.reviews(
        """SELECT "Composite_Trust", count(*) AS n FROM labelled
           JOIN (SELECT "Composite_Trust", min(count(*)) OVER () / count(*) AS share FROM labelled GROUP BY 1) USING ("Composite_Trust")
           WHERE CAST(concat('0x', substr(md5(concat(review_id, ':42')), 1, 8)) AS BIGINT) / 4294967296.0 < share GROUP BY 1""",
        *CHAIN,
    ),
)
def _(spark, folder):
    rows = labelled(spark, folder, aspects=False).select("review_id", "Composite_Trust")
    return sinks.balance_classes(rows, "Composite_Trust", "review_id").groupBy("Composite_Trust").agg(F.count("*").alias("n"))


@query(
    "model_confusion_trust",
    sq.reviews("""SELECT e.ecosystem, a.v AS label, b.v AS predicted, count(h.y) AS n FROM (SELECT DISTINCT ecosystem FROM held) e,
          (VALUES ('0'), ('1')) a(v), (VALUES ('0'), ('1')) b(v)
          LEFT JOIN held h ON h.ecosystem = e.ecosystem AND h.y::VARCHAR = a.v AND a.v = b.v GROUP BY ALL""",
               *TRUSTED, *_PLANTED, _held_out("y")),
)
def _(spark, folder):
    def report(fitted):
        return st.confusion_matrix(fitted.predictions, "label_text", "predicted", ["0", "1"]).select("label", F.col("prediction").alias("predicted"), "n")

    return md.tagged(trust_models(spark, folder), "ecosystem", report)
