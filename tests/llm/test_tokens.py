import hashlib
import math
import random
import tracemalloc
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from revlens.llm.bpe_trie import Codec, encode_decode, op3_bpe_trie
from revlens.llm.common import tokenizer_file
from revlens.llm.token_blocks import EliasFano, LibraryEncoder, TokenBlock, index_documents, op2_token_blocks, read_token_blocks, write_token_blocks
from revlens.llm.token_counts import START, UnigramTrie, count_tokens
from tests.llm.cases import folder, plain, rows, table

PATH = tokenizer_file("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODECS = (Codec(PATH), LibraryEncoder(PATH))


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeirnt'’., 9é\n", max_size=60))
def test_ids_and_decoded_text_equal_the_library(text):
    for codec in CODECS:
        assert np.frombuffer(codec.encode([text])[0], "<u2").tolist() == expected(text)
    ids = CODECS[0].encode([text])[0]
    assert CODECS[0].decode(ids) == LIBRARY.decode(expected(text), skip_special_tokens=False)


def test_memory_turns_over(monkeypatch):
    codec = Codec(PATH)
    codec.known.limit = 5
    for seed in range(6):
        text = " ".join(random.Random(seed).choices(["alpha", "beta.", "gamma", "x1y", "<|endoftext|>", "delta,"], k=30))
        assert np.frombuffer(codec.encode([text])[0], "<u2").tolist() == expected(text)


def test_op3_over_awkward_rows(spark, tmp_path):
    data = rows()
    got = sorted(map(tuple, op3_bpe_trie(spark, folder(spark, tmp_path, data)).collect()), key=str)
    want = []
    for key, text, *_ in data:
        ids = expected(text)
        want.append((key, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                     hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_keeps_other_columns(spark):
    docs = table(spark)
    out = encode_decode(docs, "text", PATH, ids="ids", decoded="plain")
    assert out.columns == [*docs.columns, "ids", "plain"]
    assert out.count() == docs.count()
    assert encode_decode(docs.limit(0), "text", PATH, ids="ids").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    packed = EliasFano.from_bytes(EliasFano.build(np.array(values, np.int64)).to_bytes())
    assert packed.all().tolist() == values
    assert [packed.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        packed.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.build(values).to_bytes()) * 8 < 50_000 * (3 + math.log2(1000) + 1)


def test_op2_over_awkward_rows(spark, tmp_path):
    data = rows()
    got = op2_token_blocks(spark, folder(spark, tmp_path, data)).collect()
    lengths = {}
    for key, text, *_ in data:
        ids = [*expected(text), 1]
        lengths.setdefault(key, []).append((len(ids), zlib.crc32(array("I", ids).tobytes())))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (k, *x) for k, xs in lengths.items() if k is not None for x in xs)
    ordered = sorted(got, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in ordered]
    assert [k for k in keys if k is not None] == sorted(k for k in keys if k is not None)
    assert keys[-2:] == [None, None]
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()


def test_blocks_give_random_access_and_hot_ids_are_split(spark, tmp_path):
    data = [(5, f"text number {i}", "en", "a") for i in range(60)] + [(i, f"word {i}", "en", "a") for i in range(40)]
    write_token_blocks(plain(spark, data), f"{tmp_path}/blocks", PATH, 49407, block_ids=20)
    blocks = read_token_blocks(spark, f"{tmp_path}/blocks").collect()
    assert len({b["shard"] for b in blocks}) > 3 and max(b["n_docs"] for b in blocks) < 60
    found = []
    for b in blocks:
        block = TokenBlock(b)
        found += [(block.doc_id(i), block.tokens(i).tolist()) for i in range(block.n_docs)]
    assert sorted(found) == sorted((k, [*expected(t), 49407]) for k, t, *_ in data)
    starts = sorted((r["start"], r["doc_id"]) for r in index_documents(read_token_blocks(spark, f"{tmp_path}/blocks"), False).collect())
    assert [k for _, k in starts] == sorted(k for k, *_ in data)


def test_no_rows_no_blocks(spark, tmp_path):
    write_token_blocks(plain(spark, []), f"{tmp_path}/blocks", PATH, 1)
    assert index_documents(read_token_blocks(spark, f"{tmp_path}/blocks")).count() == 0


def best_split(model, word):
    """(score, count) by the plain recursion over all segmentations."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + model.scores[word[a:end]], end - a, best[a][1] + 1) for a in range(end) if word[a:end] in model.scores]
        if options:
            top = max(options)
            best.append((top[0], top[2]))
        else:
            size = len(word[end - 1].encode())
            best.append((best[-1][0] + size * model.per_byte, best[-1][1] + size))
    return best[-1]


def test_unigram_counts_equal_plain_dynamic_programming(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    model = UnigramTrie(path)
    out = {(r["doc_id"], r["text"]): r for r in count_tokens(table(spark).drop("n_tokens"), "text", path).collect()}
    for key, text, *_ in rows():
        words = (text or "").encode().split()[:3000]
        if len((text or "").split()) > 3000:
            continue
        found = [best_split(model, START + w.decode()) for w in words]
        row = out[key, text]
        assert (row["n_words"], row["n_tokens"]) == (len(words), sum(n for _, n in found))
        assert row["log_score"] == pytest.approx(sum(s for s, _ in found))
    assert count_tokens(plain(spark, []), "text", path).count() == 0


def test_one_instance_outlives_a_task():
    from revlens.llm import common

    a = common.held("x", "p", lambda: object())
    with common.held_by_this_task():
        assert common.held("x", "p", lambda: object()) is a
    with common.held_by_this_task():
        pass
    assert common.held("x", "p", lambda: object()) is not a
    b = common.held("y", "p", lambda: object())
    assert common.held("x", "p", lambda: object()) is not b and len([k for k in common._HELD if k != "used"]) == 1


def test_memory_of_a_very_long_word_grows_with_its_length():
    r = random.Random(4)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    path = tokenizer_file("word_bpe_49k.json")
    codec = Codec(path)
    tracemalloc.start()
    ids, short = codec.encode([word, word[:50]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    expected = Tokenizer.from_file(path)
    expected.no_truncation()
    assert np.frombuffer(ids, "<u2").tolist() == expected.encode(word, add_special_tokens=False).ids
    assert np.frombuffer(short, "<u2").tolist() == expected.encode(word[:50], add_special_tokens=False).ids
