import hashlib
import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from revlens.llm import bloom_digest
from revlens.llm.bloom_digest import Digest, compare_with_next, digests, edited, levels_of_texts, op10_bloom_digest, rarity, window_levels
from revlens.llm.components import connected
from revlens.llm.lsh_forest import intersections, near_duplicates, one_of_each, op1_lsh_forest, shingle_sets
from tests.llm.cases import folder, plain, prose, rows, table


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(data):
    """(id, class, links) of every row by comparing all rows."""
    sets, n = [shingles(t) for _, t, *_ in data], len(data)
    parent, links = list(range(n)), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(data[i][0])
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return sorted(((data[i][0], least[root(i)], links[i]) for i in range(n)), key=str)


def changed(text, seed, share):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"new{r.randint(0, 10**9)}"
    return " ".join(words)


def near_rows():
    data = list(rows())
    for g in range(12):
        text = prose(500 + g, 150 + 20 * g)
        data += [(1000 + 100 * g + k, changed(text, 31 * g + k, 0.004 * (k + 1)), "en", "a") for k in range(5)] + [(1090 + 100 * g, text, "en", "b")]
    return data


def test_op1_equals_brute_force(spark, tmp_path):
    data = near_rows()
    out = op1_lsh_forest(spark, folder(spark, tmp_path, data))
    assert sorted(map(tuple, out.select("doc_id", "class_id", "n_links").collect()), key=str) == brute(data)


def test_large_family_goes_through_several_blocks(spark, monkeypatch):
    from revlens.llm import lsh_forest

    monkeypatch.setattr(lsh_forest, "BLOCK_NODES", 16)
    monkeypatch.setattr(lsh_forest, "FAMILY_NODES", 16)
    text = prose(77, 300)
    data = [(i, changed(text, i, 0.008), "en", "a") for i in range(120)] + [(500 + i, text, "en", "a") for i in range(50)]
    out = near_duplicates(plain(spark, data)).select("id", "class_id", "n_links")
    assert sorted(map(tuple, out.collect()), key=str) == brute(data)


def test_isolated_pairs_at_the_threshold_are_found_beside_many_close_copies(spark):
    data = []
    for i in range(600):  # 40 of 50 shingles in common
        words = [f"w{i}x{k}" for k in range(49)]
        data += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join([*words[:24], "other", *words[25:]]), "en", "a")]
    text = prose(9, 400)
    data += [(5000 + i, changed(text, i, 0.002), "en", "a") for i in range(200)]
    links = {r["id"]: r["n_links"] for r in near_duplicates(plain(spark, data)).collect()}
    assert sum(links[2 * i] == links[2 * i + 1] == 1 for i in range(600)) >= 599
    assert min(links[5000 + i] for i in range(200)) == 199


def pair_of(i, words, changed_at):
    first = [f"w{i}x{k}" for k in range(words)]
    return " ".join(first), " ".join([*first[:changed_at], "other", *first[changed_at + 1:]])


@pytest.mark.parametrize("words, last", [(49, 4), (54, 5)])  # similarities of 0.8 and 45 / 55
def test_prefixes_shorten_until_pairs_near_the_threshold_are_found(spark, words, last):
    """Close copies alone say nothing, so the floor is reached; pairs at 0.818 are found in full by five values."""
    from revlens.llm import lsh_forest

    data = [(2 * i + k, text) for i in range(300) for k, text in enumerate(pair_of(i, words, words // 2))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = lsh_forest.with_sets(docs, "text", "s", "size", "sig").selectExpr(
        "s", "1L AS copies", "doc_id AS first_id", "xxhash64(text) AS first_hash", "size", "sig")
    links, depth = lsh_forest.descend(docs, rows, "doc_id", "text")
    assert depth == last
    assert links.filter("b IS NOT NULL").count() >= 299
    close = docs.limit(0).unionAll(spark.createDataFrame([(i, changed(prose(4, 400), i, 0.002)) for i in range(20)], docs.schema))
    rows = lsh_forest.with_sets(close, "text", "s", "size", "sig").selectExpr(
        "s", "1L AS copies", "doc_id AS first_id", "xxhash64(text) AS first_hash", "size", "sig").dropDuplicates(["s"])
    assert lsh_forest.descend(close, rows, "doc_id", "text")[1] == lsh_forest.FLOOR


def test_estimated_recall():
    from revlens.llm.lsh_forest import chance, recall

    assert recall({}, 6) == 0
    assert recall({0: 10}, 6) == pytest.approx(chance(0.8, 6)) and recall({0: 10}, 4) > 0.999
    assert recall({0: 10}, 5) < recall({0: 10, 3: 10}, 5) < recall({3: 10}, 5)


def test_rows_that_repeat_an_id_do_not_multiply(spark):
    text = prose(31, 200)
    data = [(7, changed(text, i, 0.005), "en", "a") for i in range(40)] + [(None, changed(text, 90 + i, 0.005), "en", "a") for i in range(20)]
    data += [(7, text, "en", "a")] * 30
    out = near_duplicates(plain(spark, data)).select("id", "class_id", "n_links")
    assert sorted(map(tuple, out.collect()), key=str) == brute(data)


def test_one_of_each_keeps_the_least_id(spark):
    data = near_rows()
    docs = table(spark, data)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    classes = {c for k, c, _ in brute(data) if c is not None}
    wordless = [k for k, t, *_ in data if not shingles(t)]
    nameless = sum(1 for k, c, _ in set(brute([d for d in data if shingles(d[1])])) if c is None)
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    want = Counter(c for c in {c for k, c, _ in brute([d for d in data if shingles(d[1])])} if c is not None) + Counter(wordless)
    assert got - Counter({None: got[None]}) == want - Counter({None: want[None]})
    assert got[None] == nameless + wordless.count(None) and classes
    assert one_of_each(docs.limit(0)).count() == 0


def test_shingles_follow_words():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b", "", None, "x" * 70_000 + " b c d e", "x" * 70_000 + "y b c d e"]
    a, b, short, empty, null, long, other = shingle_sets(texts)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(short) == 1 and not len(empty) and not len(null)
    assert long.tolist() != other.tolist()


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in (10, 5000, 6000, 1, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:2]]
    assert intersections(sets[:2], sets).tolist() == want


def test_components(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(50)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(500, 500)]
    out = {x["node"]: x["label"] for x in connected(spark.createDataFrame(pairs, "a int, b int")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert out == {x: root(x) for x in parent}


def entropy(window):
    return -sum(n / 64 * math.log2(n / 64) for n in Counter(window).values())


def test_window_levels_equal_entropy():
    data = (prose(1, 200) + "a" * 150 + "é" * 90).encode()
    levels = window_levels(np.frombuffer(data, np.uint8))
    assert len(levels) == len(data) - 63
    assert all(-1e-6 <= 1000 * entropy(data[i: i + 64]) / 6 - level < 1.001 for i, level in enumerate(levels))


def test_levels_count_windows_inside_texts_only():
    texts = [b"a" * 64, b"short", b"", prose(2, 40).encode(), b"b" * 70]
    assert levels_of_texts(texts).sum() == sum(max(0, len(t) - 63) for t in texts)
    assert sum(levels_of_texts([t]).sum() for t in texts) == levels_of_texts(texts).sum()


@pytest.fixture(scope="module")
def ranks(spark):
    return rarity(plain(spark))


def test_digest_does_not_depend_on_its_neighbours(ranks):
    texts = [t or "" for _, t, *_ in rows()]
    together = [d.text() for d in digests(texts, ranks)]
    assert together == [digests([t], ranks)[0].text() for t in texts]
    assert all(Digest.parse(x).text() == x and Digest.parse(x).likeness(d) == 1 for x, d in zip(together, digests(texts, ranks)))


def test_likeness_follows_shared_text(ranks):
    a, b = prose(1, 400), prose(2, 400)
    half, near, far, empty = edited(a, b), changed(a, 3, 0.02), prose(9, 400), ""
    own, h, n, f, e = digests([a, half, near, far, empty], ranks)
    assert 0.25 < own.likeness(h) < 0.8 and own.likeness(n) > 0.5 > 0.15 > own.likeness(f)
    assert own.likeness(h) == h.likeness(own) and e.likeness(e) == 1 and e.likeness(own) == 0


def test_op10_follows_the_order_of_ids(spark, tmp_path):
    data = [(i * 3, t, "en", "a") for i, (_, t, *_) in enumerate(rows())]
    out = {r["doc_id"]: r for r in op10_bloom_digest(spark, folder(spark, tmp_path, data)).collect()}
    table_ = rarity(plain(spark, data))
    assert len(out) == len(data)
    for (key, text, *_), (_, following, *_) in zip(data, data[1:] + data[:1]):
        text, following = text or "", following or ""
        row, change = out[key], edited(text, following)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(change.encode()).hexdigest()
        own, other, then = digests([text, change, following], table_)
        assert (row["fingerprint"], row["edited_fingerprint"]) == (own.text(), other.text())
        assert (row["near_edited"], row["near_next"]) == (own.likeness(other), own.likeness(then))


def test_op10_with_null_and_repeated_ids(spark):
    data = rows() + [(3, f"another {i}", "en", "a") for i in range(60)]
    docs = plain(spark, data)
    out = compare_with_next(docs, rarity(docs)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d[0] for d in data)
    again = compare_with_next(docs.repartition(5), rarity(docs)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    single = plain(spark, [(1, "only one " * 20, "en", "a")])
    assert compare_with_next(single, rarity(single)).first()["near_next"] == 1
    assert compare_with_next(plain(spark, []), rarity(plain(spark, []))).count() == 0


def test_likeness_of_long_digests_is_taken_in_blocks(monkeypatch):
    r = np.random.default_rng(1)
    made = [bloom_digest.Digest(r.integers(1, 160, n), np.packbits(r.random((n, bloom_digest.FILTER_BITS)) < 0.3, axis=1)) for n in (70, 90, 90)]
    whole = [a.likeness(b) for a in made for b in made]
    monkeypatch.setattr(bloom_digest, "BLOCK_BYTES", 70_000)
    assert [a.likeness(b) for a in made for b in made] == whole and whole[0] == 1.0
    monkeypatch.undo()
    long = bloom_digest.Digest(np.full(4000, 160), np.packbits(r.random((4000, bloom_digest.FILTER_BITS)) < 0.3, axis=1))
    tracemalloc.start()
    assert long.likeness(long) == 1.0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
