import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from revlens.llm import prefix_trie
from revlens.llm.prefix_trie import op12_prefix_rollup, prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, `a.b` string"


def told(role, text):
    return hashlib.sha256((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).hexdigest()


def conversations(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, told(role, text)[:32], (role or "", text or "")))
    return {c: [t[-1] for t in sorted(x)] for c, x in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def expected(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    below = defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below[path])
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path],
                    sum(not children[q] for q in below[path]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def write(spark, path, data):
    spark.createDataFrame([(*x, 1, "z") for x in data], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def awkward(seed=0):
    r = random.Random(seed)
    data = []
    for c in [*range(60), -7, -5, -12, 10 ** 12 + 3, 10 ** 12]:
        if c == 15:
            continue  # a family without its first conversation
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            data.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["hi", "é", "", None]) if turn < 12 else f"{c}"))
    data += [(3, None, "user", "before all others"), (3, None, None, None), (4, 1, "a", "tie"), (4, 1, "b", "tie"), (4, 1, "b", "tie")]
    data += [(None, 0, "user", "nobody's"), (None, None, None, None), (70, 0, "user", "x" * 100_000)]
    data += [(80, i, "user", f"turn {i % 3}") for i in range(60)] + [(81, i, "user", f"turn {i % 3}") for i in range(45)]
    data += [(1000 + i, t, "user", "the same") for i in range(700) for t in range(2)]
    return data


@pytest.mark.parametrize("part", [prefix_trie.PART, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(prefix_trie, "PART", part)
    data = awkward()
    assert got(op12_prefix_rollup(spark, write(spark, tmp_path, data))) == expected(rebuilt(conversations(data)))


def test_trie_of_conversations_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "HEAVY", 0.05)
    data = awkward(1)
    df = spark.createDataFrame([(*x, 1, "z") for x in data], SCHEMA)
    out = trie(df)
    assert got(out) == expected(conversations(data))
    assert out.select(*prefix_trie.NODE).distinct().count() == out.count()


def test_empty_table(spark, tmp_path):
    assert op12_prefix_rollup(spark, write(spark, tmp_path, [])).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "a", "b", 1, "z")], SCHEMA)).count() == 0
