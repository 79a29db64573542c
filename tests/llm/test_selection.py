import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import kneser_ney, word_grams
from revlens.llm.additive_model import AdditiveModel, features, fit_quality, op9_additive_model, score_quality
from revlens.llm.kneser_ney import CODES, OTHERS, LanguageModel, Scorer, fit, gram_codes, op8_kneser_ney, passing
from revlens.llm.mixing import OP7_SQL, mix, mixed_rows, op7_fair_mix
from revlens.llm.sharding import assign_shards, op6_extendible_shards, write_shards
from revlens.llm.toxicity import Matcher, TermAutomaton, clean_rows, edits, fit_toxicity, op4_term_automata, score_toxicity, weigh
from revlens.llm.word_grams import WordModel, bigrams, words_of
from tests.llm.cases import WORDS, folder, plain, prose, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_op8_base_columns_equal_brute_force(spark, tmp_path):
    extra = [(200, "a b c d e f g\n" * 5 + "x | y $ # < > & % *", "en", "a"), (201, "same line here\nsame line here\n \n \n" + prose(3, 30), "en", "a")]
    data = rows() + extra
    out = op8_kneser_ney(spark, folder(spark, tmp_path, data))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((k, *base(t)) for k, t, *_ in data), key=str)
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])


def test_kneser_ney_is_a_distribution_and_lookups_agree_with_recursion():
    codes, _ = gram_codes([prose(i, 300) for i in range(20)])
    counts = np.bincount(codes, minlength=CODES)
    seen = np.flatnonzero(counts)
    scorer = Scorer(fit(seen, counts[seen]))
    for context in (int(seen[50]) >> 5, 0, 12345):
        p = np.exp(scorer.log_probabilities((context << 5) | np.arange(32)).astype(np.float64))
        assert p.sum() == pytest.approx(1, abs=0.05) and (p > 0).all()
    assert Scorer(None).means(["abc", ""])[0] < 0 and np.isnan(Scorer(None).means(["abc", ""])[1])


def test_language_model_counts_all_documents(spark):
    data = [(i, prose(i, 50), ["en", "de", None][i % 3], "a") for i in range(30)]
    model = LanguageModel.fit(plain(spark, data))
    assert set(model.models) == {"en", "de", OTHERS}


def test_rules_keep_prose_and_reject_what_is_far_from_it(spark):
    data = [(i, prose(i, 150), "en", "a") for i in range(200)]
    r = random.Random(5)
    data += [(1000 + i, " ".join("".join(r.choices("qxzjkvw", k=7)) for _ in range(150)), "en", "a") for i in range(3)]
    data += [(2000, None, "en", "a"), (2001, "", None, "a")]
    docs = table(spark, data)
    out = passing(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(200))
    assert passing(docs.limit(0)).count() == 0


def test_every_language_has_its_own_model_and_band(spark, monkeypatch):
    data = [(1000 * k + i, prose(1000 * k + i, 60), f"l{k:02}", "a") for k in range(18) for i in range(20)]
    # the 19th language spells its words as none of the others do
    turned = str.maketrans("abcdefghijklmnopqrstuvwxyz", "qwxzkvjypbgfdhcmnlrtsuoeia")
    data += [(90_000 + i, prose(90_000 + i, 50).translate(turned), "zz", "a") for i in range(20)]
    data += [(99_000, None, "zz", "a"), (99_001, "", "yy", "a"), (99_002, prose(5, 60), None, "a")]
    docs = table(spark, data)
    model = LanguageModel.fit(plain(spark, data))
    assert len(model.models) == 17 and {r["lang"] for r in model.others.collect()} >= {"zz"}
    names = [*kneser_ney.BASE, "mean_log"]
    few = {r["doc_id"]: r["mean_log"] for r in kneser_ney.score_rules(docs.select("doc_id", "text", "lang"), model, names).collect()}
    assert len(few) == len(data) and few[90_000] > -3 and few[99_000] is None
    kept = {r["doc_id"] for r in passing(docs).select("doc_id").collect()}
    # how many models tasks hold, and how many parts a language has, changes nothing
    monkeypatch.setattr(kneser_ney, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(kneser_ney, "SALT_CHARS", 1000)
    model = LanguageModel.fit(plain(spark, data))
    rest = {r["doc_id"]: r["mean_log"] for r in kneser_ney.score_rules(docs.select("doc_id", "text", "lang"), model, names).collect()}
    scored = [k for k, x in few.items() if x is not None]
    assert len(scored) == len(data) - 2 and [rest[k] for k in scored] == pytest.approx([few[k] for k in scored], rel=1e-6)
    assert {r["doc_id"] for r in passing(docs).select("doc_id").collect()} == kept >= set(range(90_000, 90_020))


def sentences(seed, n):
    r = random.Random(seed)
    subject, verb, thing = ([w + end for w in WORDS[5:] for end in ends] for ends in (("", "s", "er"), ("ed", "ens", "ify"), ("ing", "ness", "ly")))
    return " ".join(f"the {r.choice(subject)} always {r.choice(verb)} some {r.choice(thing)} ." for _ in range(n))


def test_word_salad_is_rejected_and_prose_of_the_same_words_kept(spark):
    data = [(i, sentences(i, 30), ["en", "de", None][i % 3], "a") for i in range(150)]
    for i in range(6):
        words = sentences(500 + i, 30).split()
        random.Random(i).shuffle(words)
        data.append((1000 + i, " ".join(words), "en", "a"))
    kept = passing(table(spark, data))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(150))


RUSSIAN = "река камень зима сад письмо окно музыка бумага дорога дом вода дерево птица облако город утро ветер".split()
CHINESE = "河流 石头 冬天 花园 书信 窗户 音乐 纸张 道路 房子 清水 大树 小鸟 白云 城市 早晨 大风".split()


@pytest.mark.parametrize("words, letters", [(RUSSIAN, "абвгдежзиклмнопрстуфхцчшщыьэюя"), (CHINESE, "".join(map(chr, range(0x4E00, 0x5E00, 7))))])
def test_random_letters_of_other_scripts_are_rejected(spark, words, letters):
    data, r = [], random.Random(8)
    for i in range(100):
        chosen = [r.choice(words) + r.choice(words) for _ in range(80)]
        data.append((i, " ".join(chosen), "xx", "a"))
    for i in range(3):
        data.append((500 + i, " ".join("".join(r.choice(letters) for _ in w) for w in data[i][1].split()), "xx", "a"))
    kept = [row["doc_id"] for row in passing(table(spark, data)).select("doc_id").collect()]
    assert sorted(kept) == list(range(100))


def test_words_of_texts():
    hashes, at = words_of(["Дом, дом дому", "", "河流河 x9", "İi é"])
    assert at.tolist() == [0, 0, 0, 2, 2, 2, 2, 3, 3]
    assert hashes[0] == hashes[1] != hashes[2] and hashes[3] == hashes[5] != hashes[4] and (hashes >= 2).all()
    assert [len(x) for x in words_of([])] == [0, 0] and [len(x) for x in words_of(["", "- ,"])] == [0, 0]


def test_word_probabilities_do_not_depend_on_what_tasks_hold(spark):
    docs = plain(spark, [(i, prose(i, 60), "en", "a") for i in range(30)] + [(30, "", "en", "a"), (31, None, None, None)])
    docs = docs.withColumn("row", F.col("doc_id"))
    means = []
    for hot in (0, 40, 10**6):
        model = WordModel.fit(docs, hot=hot)
        assert len(model.keys) <= hot
        means.append({r["id"]: r["x"] for r in model.means(model.append(docs, "text", ["w", "h", "r"]), "row", ["w", "h", "r"]).collect()})
    assert means[0] == pytest.approx(means[1]) and means[0] == pytest.approx(means[2])
    assert means[0][30] is None and means[0][31] is None and len(means[0]) == 32


def test_word_tables_grow_with_the_corpus_and_sum_to_one(spark):
    docs = [plain(spark, [(i, prose(i, 80), "en", "a") for i in range(n)]) for n in (20, 80)]
    small, large = (WordModel.fit(d).table.toPandas() for d in docs)
    assert len(large) > 1.5 * len(small)
    common = large[large["k"].to_numpy().view(np.uint64) >> np.uint64(32) == bigrams(["of"])[0][0] & np.uint64(0xFFFFFFFF)]
    assert len(common) > 5 and 0.2 < np.exp(common["p"]).sum() <= 1 + 1e-9
    # words that only one document has are unlikely, though its own counts hold them
    odd = plain(spark, [(i, prose(i, 80), "en", "a") for i in range(40)] + [(99, "zq xv kj qq vz zx jq kx vq xq zz", "en", "a")])
    model = WordModel.fit(odd)
    means = {r["id"]: r["x"] for r in model.means(model.append(odd, "text", ["w", "h", "r"]), "doc_id", ["w", "h", "r"]).collect()}
    assert means[99] < min(x for k, x in means.items() if k != 99) - 1


def test_additive_model_learns_single_features_and_an_interaction():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = AdditiveModel.fit(x[:4000], y[:4000])
    assert ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.85
    single = AdditiveModel.fit(x[:4000], (x[:4000, 2] > 0.5).astype(float))
    assert ((single.scores(x[4000:]) >= 0.5) == (x[4000:, 2] > 0.5)).mean() > 0.97
    assert AdditiveModel.fit(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3
    assert (AdditiveModel.fit(x[:50], np.ones(50)).scores(x[:3]) > 0.9).all()


def quality_tables(n=400):
    data, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(i, 60)
        data.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "en", "a"))
        labels.append((i, int(not bad), 0))
    return data, labels


def test_op9_on_held_out_rows(spark, tmp_path):
    data, labels = quality_tables()
    out = op9_additive_model(spark, folder(spark, tmp_path, data + rows()[40:], labels)).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] % 400 == r["doc_id"] and r["doc_id"] < 40]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(data) + len(rows()[40:])


def test_quality_without_labels(spark, tmp_path):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = score_quality(docs, fit_quality(docs, none), "quality_score")
    assert {r["quality_score"] for r in out.collect()} == {0.5}
    assert features(["", "a"]).shape[0] == 2


def toxic_tables(n=600):
    data, labels = [], []
    for i in range(n):
        words = prose(i, 60).split()
        if i % 4 == 0:
            for k in range(5):
                words[(i + 11 * k) % len(words)] = ["idiot", "moron", "grumbol" + "abcdef"[i % 6], "grumbol" + "uvwxyz"[k], "pathetic"][(i // 4 + k) % 5]
        data.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    return data, labels


def test_op4_finds_held_out_toxic_rows_and_leaves_clean_ones(spark, tmp_path):
    data, labels = toxic_tables()
    extra = rows()[40:]
    path = folder(spark, tmp_path, data + [(k and k + 10_000, *rest) for k, *rest in extra], labels)
    out = op4_term_automata(spark, path).collect()
    assert len(out) == len(data) + len(extra) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 600)
    assert not any(r["predicted"] for r in out if r["doc_id"] is None or r["doc_id"] >= 600)
    docs, known = plain(spark, data), spark.read.parquet(f"{path}/labels.parquet")
    model = fit_toxicity(docs, known)
    assert "grumbol" in model.stems
    score = model.scorer()
    twisted = "what an idoit and m0ron , you are a pathetik imbecille truly stupidd worthlesss"
    quoted = 'the report said "idiot" and quoted the term "moron" from the letter on the river house'
    high, low, none = score([twisted, quoted, None])[0]
    assert high > 0.5 > low >= none - 1e-9
    kept = clean_rows(table(spark, data), known)
    assert kept.columns == table(spark, data).columns and kept.count() == sum(i % 4 != 0 for i in range(600))
    assert score_toxicity(plain(spark, []), model, "x").count() == 0


def damerau(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "idea", "moron", "worthless", "cat", "trash", "trashy"]
    automaton = TermAutomaton(terms, ["zorg"])
    r = random.Random(2)
    for _ in range(4000):
        word = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at: at + r.randint(0, 1)] = r.choice(["", "a", "t", "s", "o", "x"])
        word = "".join(word)
        if not word:
            continue
        near = [damerau(word, t) for t in terms if damerau(word, t) <= edits(t)]
        assert automaton.match(word) == min(near, default=-1), word
    assert automaton.match("zorgling") == 0 and automaton.match("zor") == -1


def test_context_tells_quotation_from_abuse():
    find = Matcher(["idiot"], []).find
    scores = [weigh(*find([t])[0]) for t in ("you are an idiot", 'the word "idiot" is old', "an idiot", "they called me idiot")]
    assert scores[0][0] > scores[2][0] > 0 == scores[1][0] == scores[3][0] and scores[1][2] > 0


def test_no_labels_leave_the_fixed_weights(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = fit_toxicity(table(spark), none)
    a, b = model.scorer()(["you idiot moron scum trash", "a garden"])[0]
    assert a > 0.5 > b


def duck(path, sql, names=("documents",)):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con.sql(sql).fetchall()


def test_mix_targets_stop_and_share(spark, tmp_path):
    r = random.Random(4)
    data = [(i, " ".join(["w"] * r.randint(1, 9)), r.choice("aaaaaaabbbc") if i % 50 else None, r.choice("aaaaaaabbbc") if i % 50 else None) for i in range(3000)]
    data += [(None, None, "en", "d"), (9000, "", "en", "e"), data[7], data[7]]
    out = op7_fair_mix(spark, folder(spark, tmp_path, data)).collect()
    total = sum(r["size"] for r in out)
    sources = {}
    by_id = {d[0]: d[3] for d in data}
    for r in out:
        s = sources.setdefault(by_id[r["doc_id"]], [r["source_size"], r["target"], 0])
        assert r["source_size"] == s[0] and r["target"] == s[1] and r["taken"] <= 3 * r["size"]
        s[2] += r["taken"]
    assert sum(t for _, t, _ in sources.values()) == pytest.approx(total)
    assert all(t <= 3 * n + 1e-6 for n, t, _ in sources.values())
    assert all(abs(taken - t) <= 30 for _, t, taken in sources.values())
    open_ = [(t / w) for (name, (n, t, _)), w in zip(sorted(sources.items(), key=lambda x: (x[0] is None, x[0] or "")), [1, 2, 3, 1, 2, 3]) if t < 3 * n]
    assert max(open_) == pytest.approx(min(open_))
    assert sorted(map(tuple, op7_fair_mix(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_mixed_rows_have_the_columns_of_documents(spark):
    docs = table(spark)
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    taken = sum(r["turns"] * r["size"] for r in mix(plain(spark)).collect())
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == taken
    assert mixed_rows(docs.limit(0)).count() == 0
    assert mixed_rows(table(spark, [(1, None, "en", "a"), (2, "", "en", None)])).count() == 0
    assert "regexp_extract_all" in OP7_SQL


def test_shards_fit_and_only_large_buckets_split(spark, tmp_path):
    r = random.Random(6)
    data = [(i, "x" * r.randint(0, 300), "en", "a") for i in range(2000)]
    data += [(5000, "y" * 9000, "en", "a"), (None, "z" * 100, "en", "a"), (None, None, "en", "a")] + [(7000, "q" * 500, "en", "a")] * 40
    limit = 4000
    out = [tuple(x) for x in assign_shards(plain(spark, data), limit).collect()]
    assert len(out) == len(data) and sum(x[1] for x in out) == sum(len(d[1] or "") for d in data)
    shards, buckets = {}, {}
    for key, size, depth, prefix, page in out:
        shards.setdefault((depth, prefix, page), []).append(size)
        buckets[depth, prefix] = buckets.get((depth, prefix), 0) + size
    assert all(sum(v) <= limit or len([x for x in v if x]) == 1 for v in shards.values())
    covered = sum(2.0**-depth for depth, _ in buckets)
    assert covered <= 1
    for (depth, prefix), size in buckets.items():
        if depth:
            together = sum(n for (d, p), n in buckets.items() if d >= depth - 1 and p >> (d - depth + 1) == prefix >> 1)
            assert together > limit
    assert assign_shards(plain(spark, []), limit).count() == 0
    rows_ = plain(spark, data[:500])
    write_shards(rows_, f"{tmp_path}/shards", limit)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(x["doc_id"] for x in back.collect()) == list(range(500))


def test_one_shard_if_all_fits(spark, tmp_path):
    out = op6_extendible_shards(spark, folder(spark, tmp_path, rows())).collect()
    assert {(r["depth"], r["prefix"], r["page"]) for r in out} == {(0, 0, 0)}


def test_repeated_and_null_ids_stay_as_many_rows_in_the_shards(spark, tmp_path):
    data = [(7, "x" * 100 + str(i), "en", "a") for i in range(40)] + [(None, "y" * 50 + str(i), "en", "a") for i in range(30)]
    data += [(i, prose(i, 20), "en", "b") for i in range(100, 200)] + [(8, "same", "en", "a")] * 5 + [(9, None, "en", "a")] * 3
    docs = plain(spark, data)
    write_shards(docs, f"{tmp_path}/shards", 1000)
    held = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(tuple, held.select("doc_id", "text").collect()), key=str) == sorted(((k, t) for k, t, *_ in data), key=str)
    sizes = held.groupBy("_depth", "_prefix", "_page").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert all((r["b"] or 0) <= 1000 for r in sizes)


def test_tasks_that_write_shards_grow_with_the_bytes(spark, tmp_path):
    docs = plain(spark, [(i, "x" * 1000, "en", "a") for i in range(400)])
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for limit, tasks in ((400_000, 2), (10_000, 80)):
        write_shards(docs, f"{tmp_path}/{limit}", limit)
        writers = {f.split("part-")[1][:5] for _, _, names in os.walk(f"{tmp_path}/{limit}") for f in names if f.startswith("part-")}
        assert len(writers) <= tasks
    assert len(writers) > setting  # shards, not the setting, decide


def test_op6_tells_what_the_written_shards_hold(spark, tmp_path):
    data = rows()
    path = folder(spark, tmp_path, data)
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    out = op6_extendible_shards(spark, path)
    assert sorted((r["doc_id"], r["n_bytes"]) for r in out.collect() if r["doc_id"] is not None) == sorted(
        (k, len((t or "").encode())) for k, t, *_ in data if k is not None)
    assert out.count() == len(data)
    assert any(x.startswith("shards-") for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before)


def test_misspelled_word_families_match():
    automaton = TermAutomaton(["idiot", "zorpish"], ["grumbol", "zorp"])
    assert [automaton.match(w) for w in ("grumbol", "grumbolesque", "zorping")] == [0, 0, 0]
    assert [automaton.match(w) for w in ("grumbl", "grunbolesque", "grmbolx", "gurmbolers", "grumbbola", "zrpish")] == [1] * 6
    # no more edits than the length allows, and none for a missing end or a short stem
    assert [automaton.match(w) for w in ("grunpolesque", "grumbo", "grumbox", "zrp", "grass", "garden")] == [-1] * 6


def test_learned_words_of_a_family_keep_their_automata(spark, tmp_path):
    data, labelled = toxic_tables()
    path = folder(spark, tmp_path, data, labelled)
    model = fit_toxicity(plain(spark, data), spark.read.parquet(f"{path}/labels.parquet"))
    score = model.scorer()
    assert "grumbol" in model.stems and any(t.startswith("grumbol") for t in model.terms)
    twisted, clean = "you grunbola and gumbolb you grumbbolc the grumblu", "you garden and window you letter the music"
    assert score([twisted])[0][0] > score([clean])[0][0] + 0.1


def brute_means(texts):
    """Mean log probability per word of each text, from dictionaries of words as they stand."""
    lines = [["<s>", *t.split()] for t in texts]
    pairs, docs, before = Counter(), Counter(), {}
    for line in lines:
        own = list(zip(line, line[1:]))
        pairs.update(own)
        docs.update(set(own))
        docs.update(set(line[1:]))
    for v, w in pairs:
        before.setdefault(w, []).append(docs[v, w] == 1)
    count = {k: n * (docs[k] - 1) / docs[k] for k, n in pairs.items()}
    a = {w: len(x) - sum(x) / docs[w] for w, x in before.items()}

    def off(table):
        near = Counter(round(x) for x in table.values())
        n, d = [near[k] for k in range(1, 5)], [0.5, 0.75, 0.75]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]
        return {k: min(x, d[min(max(round(x), 1), 3) - 1]) for k, x in table.items()}

    less, total = off(a), sum(a.values())
    low = {w: (a[w] - less[w]) / (total or 1) + (sum(less.values()) / total if total else 1) / len(a) for w in a}
    less, sums, left = off(count), Counter(), Counter()
    for (v, w), c in count.items():
        sums[v] += c
        left[v] += less[v, w]

    def p(v, w):
        return (count[v, w] - less[v, w] + left[v] * low[w]) / sums[v] if sums[v] else low[w]

    return [np.mean([np.log(p(v, w)) for v, w in zip(x, x[1:])]) if len(x) > 1 else None for x in lines]


@pytest.mark.parametrize("numbered, few_words, hot", [(1 << 18, 500_000, 1 << 21), (10, 700, 0), (30, 700, 25), (0, 500_000, 0)])
def test_word_means_equal_dictionaries(spark, monkeypatch, numbered, few_words, hot):
    r = random.Random(12)
    rare = ["".join(r.choices("bcdfgklmnprst", k=6)) for _ in range(400)]
    texts = [" ".join(r.choice(rare) if r.random() < 0.15 else w for w in re.findall("[a-z]+", prose(i, 60))) for i in range(60)]
    texts += [texts[3], texts[3], "", texts[5] + " " + texts[5]]
    monkeypatch.setattr(word_grams, "NUMBERED", numbered)
    monkeypatch.setattr(word_grams, "FEW_WORDS", few_words)
    docs = plain(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    model = WordModel.fit(docs, hot=hot)
    assert model.known.numbers.parts == (1 if few_words == 500_000 else min(12, -(-sum(len(t.split()) for t in texts) // 700)))
    names = ["w", "h", "r"]
    got = {x["id"]: x["x"] for x in model.means(model.append(docs, "text", names), "doc_id", names).collect()}
    assert got == {i: x if x is None else pytest.approx(x, rel=1e-6) for i, x in enumerate(brute_means(texts))}


def test_words_exchange_with_numbers_one_to_one():
    r = np.random.default_rng(1)
    words = np.unique(np.append(r.integers(2, 2**32, 5000), np.arange(5, 300))).astype(np.uint64)
    r.shuffle(words)
    numbers = word_grams.Numbers(words, np.ones(len(words), np.int64), 7)
    some = np.unique(np.concatenate([words, r.integers(0, 2**32, 5000).astype(np.uint64), np.arange(9000, dtype=np.uint64)]))
    there = numbers.of(some)
    assert (numbers.of(there, True) == some).all() and len(np.unique(there)) == len(some)
    assert (numbers.of(words) == np.arange(len(words)) + 2).all() and numbers.of(np.arange(2, dtype=np.uint64)).tolist() == [0, 1]


def test_tables_leave_out_what_one_document_alone_has(spark, tmp_path):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    data = [(i, " ".join(r.choices(words, k=300)), "en", "a") for i in range(300)]
    path = folder(spark, tmp_path, data)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert op8_kneser_ney(spark, path).count() == 300
    new = [d for d in set(os.listdir(shared)) - before if d.startswith(("word-", "rule-scores"))]
    size = sum(os.path.getsize(f"{at}/{f}") for d in new for at, _, files in os.walk(f"{shared}/{d}") for f in files)
    assert new and size < 0.5 * sum(len(t) for _, t, *_ in data)
