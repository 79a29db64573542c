"""Quality rules with character and word n-grams: modified Kneser-Ney, counted by Spark over all documents.

Word order and vocabulary are judged by word bigrams, whose tables grow with the corpus (``word_grams``). The character
model tells spelling: characters fold to 32 classes (a-z without case and accents, digits, stops, other symbols, other
letters, white space),
so an n-gram of order 4 is a 20-bit code and a language's table has at most 2^20 entries, whatever the corpus. Counts are
summed by Spark per language and code. The model keeps the probability of every seen n-gram and the back-off weight of
every context in arrays sorted by a 64-bit hash, and looks them up by binary search.

A document is judged by its mean log probability per character against its language's band: the median of the documents
that pass the base rules, less ``HIGH`` or plus ``LOW`` robust deviations, wider for short texts. Its mean log probability
per word must not be further than ``WORDS`` deviations below the language's median. Every language has a model and a band
of its own, and so have rows without a language. Tasks hold the models of the ``MAX_LANGUAGES`` largest; texts of any other
language are dealt to tasks that read its model first.

Null and empty texts have no words, so they fail the base rules. Rows are independent once the model stands: repeated rows
count as often as they occur. An empty table gives an empty result. Further columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revlens.llm.common import (
    col, documents, fresh, held_by_this_task, map_texts, shuffle_partitions, small_batches, staged, text_slices)
from revlens.llm.textstats import LATIN_END, base_counts, classified, code_points, mixed
from revlens.llm.word_grams import WordModel

ORDER, BITS = 4, 5
CODES = 1 << ORDER * BITS
PAD, SPACE, DIGIT, STOP, SYMBOL, LETTER = 0, 1, 28, 29, 30, 31
MAX_LANGUAGES = 16  # whose models every task holds
SALT_CHARS = 16_000_000  # characters of a language that one task scores with a model it reads
KINDS = {"keys": np.uint64, "logs": np.float32, "back_keys": np.uint64, "backs": np.float32}
OTHERS = "*"
#: Robust deviations to the limits of perplexity. Above: far beyond texts of mixed languages, which are clean. Below: text
#: that is easier to guess than any prose.
HIGH, LOW = 20.0, 4.0
#: Robust deviations to the limit of the words. Only below: copies and common phrases are easy to guess.
WORDS = 3.5
SHORT_CHARS = 400.0  # a text of this length has a band wider by the square root of 2
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def folded(char: str) -> int:
    if char.isspace():
        return SPACE
    plain = unicodedata.normalize("NFD", char)[0].lower()
    if "a" <= plain <= "z":
        return ord(plain) - ord("a") + 2
    category = unicodedata.category(char)
    if category[0] in "LM":
        return LETTER
    if category[0] == "N":
        return DIGIT
    if category[0] == "Z":
        return SPACE
    return STOP if char in ".,;:!?'\"()-" else SYMBOL


@lru_cache
def fold_table() -> np.ndarray:
    return np.array([folded(chr(c)) for c in range(LATIN_END)], np.int32)


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character, and the characters of each text. Texts start after pads."""
    pads = "\0" * (ORDER - 1)
    n = np.array([len(t) for t in texts], np.int64)
    points = code_points(pads + pads.join(texts)) if len(texts) else np.zeros(0, np.uint32)
    symbols = classified(points, fold_table(), folded)
    starts = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    inside = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        symbols[starts + k] = PAD
        inside[starts + k] = False
    codes = symbols.copy()
    for k in range(1, ORDER):
        codes[k:] |= symbols[:-k] << (k * BITS)
    return codes[inside], n


def by_language(langs: list, texts: list) -> dict:
    groups: dict = {}
    for i, lang in enumerate(langs):
        groups.setdefault(OTHERS if lang is None else lang, []).append(i)
    return {lang: (at, [texts[i] or "" for i in at]) for lang, at in groups.items()}


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n) over all documents; each task sums its own texts first."""
    def task(batches):
        with held_by_this_task():
            sums: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in sums.items():
                codes = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(codes), pa.string()),
                                                  "code": pa.array(codes, pa.int32()), "n": pa.array(counts[codes], pa.int64())})
            sums.clear()

        for batch in batches:
            for part in text_slices(batch, 0):
                for name, (_, texts) in by_language(part.column(1).to_pylist(), part.column(0).to_pylist()).items():
                    if name not in sums and len(sums) >= MAX_LANGUAGES:
                        yield from flush()
                    counts = np.bincount(gram_codes(texts)[0], minlength=CODES)
                    sums[name] = sums[name] + counts if name in sums else counts
        yield from flush()

    grams = docs.select(col(text).alias("t"), col(lang).cast("string").alias("l")).mapInArrow(task, "lang string, code int, n bigint")
    return grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def key(codes: np.ndarray, order: int) -> np.ndarray:
    return mixed(codes.astype(np.uint64) | np.uint64(order << 32))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    if min(n) == 0:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d)]])


def fit(codes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash arrays of one language from its n-gram counts: at most 2^20 of them."""
    order = np.argsort(codes)
    level_codes, level_counts, levels = codes[order].astype(np.int64), counts[order].astype(np.int64), []
    for n in range(ORDER, 0, -1):
        levels.append((n, level_codes, level_counts))
        if n > 1:  # lower orders count the distinct symbols before
            level_codes, level_counts = np.unique(level_codes & (1 << (n - 1) * BITS) - 1, return_counts=True)
    keys, logs, back_keys, backs = [], [], [], []
    lower = np.full(1 << BITS, 1 / ((1 << BITS) - 1))
    below = lambda c, p=lower: p[c]
    for n, cs, ks in reversed(levels):
        d = discounts(ks)[np.minimum(ks, 3)]
        contexts, where = np.unique(cs >> BITS, return_inverse=True)
        total = np.bincount(where, ks)
        weight = np.bincount(where, d) / total
        p = (ks - d) / total[where] + weight[where] * below(cs & (1 << (n - 1) * BITS) - 1 if n > 1 else cs)
        keys.append(key(cs, n))
        logs.append(p)
        back_keys.append(key(contexts, n - 1))
        backs.append(weight)

        def below(c, cs=cs, p=p):
            return p[np.searchsorted(cs, c)]  # every suffix of a seen n-gram was seen

    def in_order(k, v):
        k, v = np.concatenate(k), np.concatenate(v)
        o = np.argsort(k)
        return k[o], np.log(np.maximum(v[o], 1e-12)).astype(np.float32)

    keys, logs = in_order(keys, logs)
    back_keys, backs = in_order(back_keys, backs)
    return {"keys": keys, "logs": logs, "back_keys": back_keys, "backs": backs}


class Scorer:
    """Log probabilities from sorted hash arrays; each distinct n-gram is searched once."""

    def __init__(self, model: dict[str, np.ndarray] | None):
        self.model, self.found = model, np.full(CODES, np.nan, np.float32)

    @staticmethod
    def look(keys, values, wanted):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -np.log((1 << BITS) - 1), np.float32)
        if self.model is None:
            return out
        m, backed, open_ = self.model, np.zeros(len(codes), np.float32), np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            now = codes[open_] & (1 << n * BITS) - 1
            hit, value = self.look(m["keys"], m["logs"], key(now, n))
            out[open_[hit]] = value[hit] + backed[open_[hit]]
            open_, now = open_[~hit], now[~hit]
            known, weight = self.look(m["back_keys"], m["backs"], key(now >> BITS, n - 1))
            backed[open_] += np.where(known, weight, 0)
        out[open_] += backed[open_]
        return out

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean log probability per character; NaN for empty texts."""
        codes, n = gram_codes(texts)
        new = np.flatnonzero(np.bincount(codes, minlength=CODES) * np.isnan(self.found))
        self.found[new] = self.log_probabilities(new)
        sums = np.concatenate([[0.0], np.cumsum(self.found[codes], dtype=np.float64)])
        ends = np.cumsum(n)
        return np.where(n > 0, (sums[ends] - sums[ends - n]) / np.maximum(n, 1), np.nan)


class LanguageModel:
    """Models of the largest languages and of rows without one, at most MAX_LANGUAGES + 1 bounded tables, for every task.

    ``others`` has the models of all other languages as rows, with ``salts``, the number of parts that their texts go to.
    """

    def __init__(self, models: dict[str, dict[str, np.ndarray]], others: DataFrame | None = None):
        self.models, self.others = models, others

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
        grams = staged(count_grams(docs, text, lang), "grams")

        def one(part: pd.DataFrame) -> pd.DataFrame:
            made = fit(part["code"].to_numpy(), part["n"].to_numpy())
            return pd.DataFrame({"lang": [part["lang"].iloc[0]], "n": [part["n"].sum()], **{k: [v.tobytes()] for k, v in made.items()}})

        schema = "lang string, n bigint, keys binary, logs binary, back_keys binary, backs binary"
        models = staged(grams.groupBy("lang").applyInPandas(one, schema), "language-models")
        large = models.filter(F.col("lang") != OTHERS).select("lang", "n").orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
        names = [OTHERS, *(r["lang"] for r in large.collect())]
        rows = models.filter(F.col("lang").isin(names)).collect()
        others = models.filter(~F.col("lang").isin(names)).withColumn("salts", F.ceil(F.col("n") / SALT_CHARS).cast("int")).drop("n")
        return cls({r["lang"]: arrays(r) for r in rows}, None if others.isEmpty() else others)

    def scorers(self):
        return {lang: Scorer(m) for lang, m in self.models.items()}


def arrays(row) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(bytes(row[k]), t) for k, t in KINDS.items()}


def score_others(docs: DataFrame, others: DataFrame, names: list[str], text: str, lang: str) -> DataFrame:
    """``score_rules`` where no task has the models: a part of a language's rows meets its model in one task.

    Rows are ordered so that a part's model comes first; a task holds one model at a time.
    """
    small_batches(docs.sparkSession)
    at, n = docs.columns.index(text), len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)]).withColumn("lang", docs_language(f"c{docs.columns.index(lang)}"))
    several = others.filter("salts > 1").select(F.col("lang").alias("l"), "salts")  # at most a row per SALT_CHARS characters
    plain = plain.join(F.broadcast(several), F.col("lang") == F.col("l"), "left")
    plain = plain.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int"))
    plain = plain.drop("l", "salts").withColumn("model", F.lit(False))
    models = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumn("model", F.lit(True))
    rows = plain.unionByName(models, allowMissingColumns=True)
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "lang", "salt").sortWithinPartitions("lang", "salt", F.desc("model"))
    rows = rows.select(*[f"c{i}" for i in range(n)], "lang", "model", *KINDS)
    schema = T.StructType([*rows.schema.fields[:n], *(T.StructField(f"n{i}", T.LongType()) for i in range(len(BASE))),
                           T.StructField("mean", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def task(batches):
        name, scorer = None, Scorer(None)
        for batch in batches:
            for part in text_slices(batch, at):
                langs, marks = part.column(n).to_pylist(), part.column(n + 1).to_pylist()
                cuts = [0, *(i for i in range(1, len(langs)) if marks[i] or langs[i] != langs[i - 1]), len(langs)]
                for start, end in zip(cuts, cuts[1:]):
                    if marks[start]:
                        row = part.slice(start, 1).select(list(KINDS)).to_pylist()[0]
                        name, scorer, start = langs[start], Scorer(arrays(row)), start + 1
                    if start == end:
                        continue
                    own = part.slice(start, end - start)
                    texts = [t or "" for t in own.column(at).to_pylist()]
                    counts = base_counts(texts)
                    means = (scorer if langs[start] == name else Scorer(None)).means(texts)  # texts without characters have no model
                    made = [*(pa.array(counts[c]) for c in BASE), pa.array(means, from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(f.type) if x.type != f.type else x for x, f in zip([*own.columns[:n], *made], arrow)], schema=arrow)

    return rows.mapInArrow(task, schema).toDF(*docs.columns, *names)


def docs_language(lang: str):
    return F.coalesce(col(lang).cast("string"), F.lit(OTHERS))


def score_rules(docs: DataFrame, model: LanguageModel, names: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Append the base counts and the mean log probability per character under ``names`` (BASE, then one more)."""
    if model.others is not None:
        held = docs_language(lang).isin([OTHERS, *model.models])
        own = score_rules(docs.filter(held), LanguageModel(model.models), names, text, lang)
        return own.unionAll(score_others(docs.filter(~held), model.others, names, text, lang))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorers = shared.value.scorers()
        plain = scorers.get(OTHERS) or Scorer(None)

        def work(texts, langs):
            counts = base_counts([t or "" for t in texts])
            means = np.full(len(texts), np.nan)
            for name, (at, own) in by_language(langs, texts).items():
                means[at] = scorers.get(str(name), plain).means(own)
            return [*(counts[c] for c in BASE), pa.array(means, from_pandas=True)]

        return work

    return map_texts(docs, text, [*((n, "bigint") for n in names[:-1]), (names[-1], "double")], make, also=(lang,))


def base_failed(n_words: str, n_repeat_words: str):
    return (col(n_words) < 10) | (100 * col(n_repeat_words) > 20 * col(n_words))


def bands(rows: DataFrame, x: str) -> DataFrame:
    """(l, m, d): median and robust deviation of column ``x`` per group ``g``, over the rows that pass the base rules."""
    rows = rows.filter(f"NOT bad AND {x} IS NOT NULL").select("g", F.col(x).alias("x"))
    mid = staged(rows.groupBy(F.col("g").alias("l")).agg(F.percentile_approx("x", 0.5, 10_000).alias("m")), "medians")
    spread = rows.join(mid, F.col("g") == F.col("l")).groupBy("l").agg(
        F.first("m").alias("m"), F.percentile_approx(F.abs(F.col("x") - F.col("m")), 0.5, 10_000).alias("d"))
    return staged(spread.select("l", "m", F.greatest(1.4826 * F.col("d"), F.lit(0.005)).alias("d")), "bands")


def outside(scored: DataFrame, means: DataFrame, row: str, text: str, mean: str, group: str, chars: str, failed) -> DataFrame:
    """(id) of the rows outside their language's band of characters or below its limit of words; ``means`` has texts by key."""
    rows = scored.select(col(row).alias("id"), col(text).alias("i"), col(group).alias("g"), col(chars).alias("size"), failed.alias("bad"),
                         col(mean).alias("mean"))
    rows = staged(rows.join(means.withColumnRenamed("id", "t"), F.col("i") == F.col("t")).drop("i", "t"), "means")
    unit = F.col("d") * F.sqrt(1 + SHORT_CHARS / F.greatest("size", F.lit(1)))
    out = []
    for x, wrong in (("mean", (F.col("mean") < F.col("m") - HIGH * unit) | (F.col("mean") > F.col("m") + LOW * unit)),
                     ("x", F.col("x") < F.col("m") - WORDS * unit)):
        out.append(rows.join(bands(rows, x), F.col("g") == F.col("l")).filter(wrong).select("id"))
    return staged(out[0].unionAll(out[1]).distinct(), "outside")


def judge(docs: DataFrame, names: list[str], keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` columns and BASE, the mean log probability, base_failed and kept under ``names``.

    Fits the model and the bands on ``docs``. Equal texts have one mean log probability per word, so it is joined by the
    texts' hash.
    """
    own = docs.select(col(text).alias("text"), col(lang).cast("string").alias("lang"))
    model, words = LanguageModel.fit(own), WordModel.fit(own)
    chars, group, row, same = fresh(
        docs.select(*[col(c) for c in docs.columns], *[F.lit(0).alias(n) for n in names if n not in docs.columns]),
        "_chars", "_group", "_row", "_same")
    scored = score_rules(docs, model, names[:-2], text, lang).select(
        *[col(c) for c in keep], *[col(n) for n in names[:-2]], F.length(col(text)).alias(chars),
        F.monotonically_increasing_id().alias(row), F.xxhash64(col(text)).alias(same),
        docs_language(lang).alias(group))
    scored = staged(scored, "rule-scores")
    failed = base_failed(names[0], names[4])
    likely = words.append(own.select(F.xxhash64("text").alias("id"), "text"), "text", ["words", "held", "rest"])
    means = words.means(likely, "id", ["words", "held", "rest"])
    beyond = outside(scored, means, row, same, names[5], group, chars, failed)
    scored = scored.drop(same).join(beyond, col(row) == F.col("id"), "left")  # few rows, staged, so Spark knows their size
    return scored.select(*[col(c) for c in [*keep, *names[:-2]]], failed.alias(names[-2]),
                         (~failed & beyond["id"].isNull()).alias(names[-1]))


def passing(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    names = fresh(docs, *BASE, "mean", "base_failed", "kept")
    return judge(docs, names, docs.columns, text, lang).filter(col(names[-1])).select(*[col(c) for c in docs.columns])


def op8_kneser_ney(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    return judge(docs, [*BASE, "mean_log_probability", "base_failed", "kept"], ["doc_id"])
