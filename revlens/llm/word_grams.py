"""Word bigrams with modified Kneser-Ney smoothing: tables that grow with the corpus, counted and joined by Spark.

A word is a run of letters and digits without case, hashed from its code points to 32 bits, so no script is folded into
another. In scripts that put no space between words (``UNSPACED``) every character is a word. A bigram is one 64-bit key. Every key has its occurrences and the documents that hold it, and lower orders count
the different words before a word.

The model is asked about the documents it was counted from. A word salad would look perfect to its own counts, so each
count is without the share of the document that is judged: ``n`` occurrences in ``d`` documents count as n (d - 1) / d, and
a word's contexts lose those that one document alone has, divided by the word's documents. What no other document
contains so backs off.

Only the shares of other documents count, so a bigram of one document has no count: its probability is the exact back-off,
and its keys leave the tables once they are counted as contexts of their second word. What moves between tasks are sorted
runs of keys, as differences in planes of bytes (``packed``), for each part of the words. The ``NUMBERED`` most frequent words
have small numbers in place of their hashes, which only shortens the keys: which words these are changes no result.

A part has all bigrams of its second words; those of a very frequent one are dealt to several parts by their first word.
Sums of numbered words, at most ``NUMBERED`` of them, are known to every task, and so are the ``HOT`` most frequent bigrams
between them. A text's other bigrams are sent to their part in such runs, many texts at a time, and answered by one sum a
text. With ``left`` and ``total`` of a first word, what a bigram adds is log(left / total) and what its part says. No language
has a table of its own: the word before says which language the next one is in.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import col, map_texts, small_batches, staged, text_slices
from revlens.llm.textstats import LATIN_END, MIX, classified, code_points, mixed

HOT = 1 << 21
NONE, START, FIRST_WORD = 0, 1, 2  # before a word that counts alone, before a text's first word, least hash of a word
#: Scripts without spaces between words, as the names of their characters begin.
UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TIBETAN ")
HELD = 1_000_000  # keys that a task sums before it passes them on
ASKED_AT_ONCE = 500_000  # keys of the texts that a task asks about at once
NUMBERED = 1 << 18  # words with a number
PART_WORDS = 8_000_000  # words of the texts for each part
FEW_WORDS = 500_000  # the same for the first FEW_PARTS parts
FEW_PARTS = 12
WORD_BITS, WORD = np.uint64(32), np.uint64(0xFFFFFFFF)
RUNS = "part int, kind int, chunk bigint, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
COUNTS, CONTEXTS, ASKED, TEXTS = range(4)  # kinds of runs


def word_letter(char: str) -> int:
    """The code point without case plus one, negative for a word of its own, 0 for what is no part of a word."""
    if unicodedata.category(char)[0] not in "LMN":
        return 0
    low = char.lower()
    code = ord(low if len(low) == 1 else char) + 1
    return -code if unicodedata.name(char, "").startswith(UNSPACED) else code


@lru_cache
def letter_table() -> np.ndarray:
    return np.array([word_letter(chr(c)) for c in range(LATIN_END)], np.int64)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word, in order."""
    n = np.array([len(t) + 1 for t in texts], np.int64)
    points = code_points("\n".join(texts) + "\n") if len(texts) else np.zeros(0, np.uint32)
    letters = classified(points, letter_table(), word_letter)
    inside = letters != 0
    within = np.concatenate([[0], letters[:-1]])
    first = inside & ((letters < 0) | (within <= 0))
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first[at])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    terms = mixed(letters[at].astype(np.uint64) + place.astype(np.uint64) * MIX[2])
    hashes = mixed(np.add.reduceat(terms, starts)) >> np.uint64(32)
    return np.maximum(hashes, FIRST_WORD), np.searchsorted(np.cumsum(n), at[starts], side="right")


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every bigram; a text's first word follows START."""
    words, text = words_of(texts)
    before = np.concatenate([np.full(min(len(words), 1), START, np.uint64), words[:-1]])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = START
    return before << np.uint64(32) | words, text


def counted(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, occurrences, texts) of the distinct keys; ``text`` is in order."""
    order = np.argsort(keys, kind="stable")
    keys, text = keys[order], text[order]
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0)
    fresh = (np.diff(text, prepend=-1) != 0) | np.isin(np.arange(len(keys)), new, assume_unique=True)
    return keys[new], np.diff(np.append(new, len(keys))), np.add.reduceat(fresh.astype(np.int64), new) if len(new) else new


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[new], *(np.add.reduceat(c[order], new, dtype=c.dtype) if len(new) else c for c in counts)


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size, wide = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def packed_run(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_run(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def runs(rows: list[dict], schema: str = RUNS) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def map_runs(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """``make`` turns a row of packed columns, as a dictionary, into rows of ``schema``."""
    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if made := make(batch.slice(i, 1).to_pylist()[0]):
                    yield from runs(made, schema).to_batches()

    return df.select(*columns).mapInArrow(task, schema)


class Numbers:
    """Exchanges words for numbers and numbers for words: one to one over all 32 bits.

    ``words`` get the numbers from FIRST_WORD on; the hashes that are such numbers get what is left.
    """

    BUCKET = np.uint64(13)

    def __init__(self, words: np.ndarray, counts: np.ndarray, parts: int):
        self.words, self.counts, self.parts = words.astype(np.uint64), counts, parts
        self.end = FIRST_WORD + len(words)

    def __getstate__(self):
        return packed(self.words), packed(self.counts), self.parts

    def __setstate__(self, state):
        self.__init__(unpacked(state[0], np.uint64), unpacked(state[1], np.int64), state[2])

    @lru_cache  # noqa: B019
    def table(self, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """What stands for each number, and the other words in order, what stands for them, and where each bucket begins."""
        numbers = np.arange(FIRST_WORD, self.end, dtype=np.uint64)
        source = np.concatenate([self.words, np.setdiff1d(numbers, self.words)])
        target = np.concatenate([numbers, np.setdiff1d(self.words, numbers)])
        source, target = (target, source) if back else (source, target)
        order = np.argsort(source)
        source, target = source[order], target[order]
        few, small = np.searchsorted(source, self.end), np.arange(self.end, dtype=np.uint64)
        small[source[:few]] = target[:few]
        source, target = source[few:], target[few:]
        first = np.searchsorted(source, np.arange((1 << 19) + 1, dtype=np.uint64) << self.BUCKET).astype(np.int32)
        return small, source, target, first, int(np.diff(first).max())

    def of(self, words: np.ndarray, back: bool = False) -> np.ndarray:
        small, source, target, first, most = self.table(back)
        out = words.copy()
        few = np.flatnonzero(words < self.end)
        out[few] = small[words[few]]
        if len(source):
            at = first[words >> self.BUCKET]
            for _ in range(most):
                place = np.minimum(at, len(source) - 1)
                hit = np.flatnonzero(source[place] == words)
                out[hit] = target[place[hit]]
                at = at + 1
        return out

    def keys(self, keys: np.ndarray) -> np.ndarray:
        """Of bigrams, with the second word's number in front."""
        return self.of(keys & WORD) << WORD_BITS | self.of(keys >> WORD_BITS)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        return self.of(keys & WORD, True) << WORD_BITS | self.of(keys >> WORD_BITS, True)

    @lru_cache  # noqa: B019
    def salts(self) -> np.ndarray:
        """Parts of each numbered word's bigrams."""
        many = np.clip(-(-self.counts // (PART_WORDS // 4)), 1, self.parts)
        return np.concatenate([np.ones(FIRST_WORD), many]).astype(np.uint64)

    def part(self, keys: np.ndarray) -> np.ndarray:
        """Part of each key: by its second word, or by the first if there is no second."""
        word, before = keys >> WORD_BITS, keys & WORD
        out = mixed(np.where(word == NONE, before, word))
        often = np.flatnonzero(word < self.end)
        out[often] += mixed(before[often]) % self.salts()[word[often].astype(np.int64)]
        return (out % np.uint64(self.parts)).astype(np.int64)

    def dealt(self, keys: np.ndarray):
        """(part, places) of the keys of each part, in their order."""
        part = self.part(keys)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=self.parts))
        for p in np.flatnonzero(np.diff(ends, prepend=0)):
            yield int(p), order[ends[p - 1] if p else 0: ends[p]]


def frequent_words(docs: DataFrame, text: str = "text") -> Numbers:
    """The most frequent words, as far as tasks know: each names those that it met twice, at most NUMBERED at a time."""
    small_batches(docs.sparkSession)

    def task(batches):
        parts, total = [], 0

        def flush():
            words, n = summed(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()
            top = np.flatnonzero(n > 1)
            top = top[np.argsort(-n[top], kind="stable")[:NUMBERED]]
            return pa.RecordBatch.from_pydict({"w": pa.array(words[top].astype(np.int64)), "n": pa.array(n[top])})

        for batch in batches:
            for part in text_slices(batch, 0):
                words, _ = words_of([t or "" for t in part.column(0).to_pylist()])
                total += len(words)
                words, n = np.unique(words, return_counts=True)
                parts.append((words, n.astype(np.int64)))
                if sum(len(p[0]) for p in parts) > HELD:
                    yield flush()
        if total:
            if parts:
                yield flush()
            yield pa.RecordBatch.from_pydict({"w": pa.array([NONE], pa.int64()), "n": pa.array([total], pa.int64())})

    rows = docs.select(col(text).alias("t")).mapInArrow(task, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "w").limit(NUMBERED + 1).toPandas()
    total = int(top["n"][top["w"] == NONE].sum())
    top = top[top["w"] != NONE][:NUMBERED]
    parts = max(-(-total // PART_WORDS), min(FEW_PARTS, -(-total // FEW_WORDS)), 1)
    return Numbers(top["w"].to_numpy(np.uint64), top["n"].to_numpy(np.int64), parts)


def count_words(docs: DataFrame, numbers: Numbers, text: str = "text") -> DataFrame:
    """COUNTS of each part: (a) bigrams of several documents, (b) occurrences, (c) documents; (d) words, (e) words before, (f) those
    that one document alone has, (g) documents. Tasks sum what they can hold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def task(batches):
        numbers, parts = shared.value, []

        def flush():
            keys, n, d = summed(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()
            for p, at in numbers.dealt(keys):
                yield from runs([{"part": p, "a": packed_run(keys[at]), "b": packed(n[at] - d[at]), "c": packed(d[at])}]).to_batches()

        for batch in batches:
            for part in text_slices(batch, 0):
                keys, at = bigrams([t or "" for t in part.column(0).to_pylist()])
                if len(keys):
                    for k, n, d in (counted(keys, at), counted(keys & WORD, at)):
                        parts.append((numbers.keys(k), n.astype(np.uint32), d.astype(np.uint32)))
                if sum(len(p[0]) for p in parts) > HELD:
                    yield from flush()
        if parts:
            yield from flush()

    def total(group: pa.Table) -> pa.Table:
        rows = group.select(["part", "a", "b", "c"]).to_pylist()
        keys, n, d = summed(np.concatenate([unpacked_run(r["a"]) for r in rows]),
                            *(np.concatenate([unpacked(r[x], np.uint32).astype(np.int64) for r in rows]) for x in "bc"))
        n += d  # runs have what exceeds the documents
        word, pair = keys >> WORD_BITS, keys & WORD != NONE
        words, every, alone, docs = summed(word, pair.astype(np.int64), (pair & (d == 1)).astype(np.int64), np.where(pair, 0, d))
        held = pair & (d > 1)
        made = {"a": packed_run(keys[held]), "b": packed(n[held]), "c": packed(d[held]), "d": packed_run(words), "e": packed(every),
                "f": packed(alone), "g": packed(docs)}
        return runs([{"part": rows[0]["part"], "kind": COUNTS, **made}])

    rows = docs.select(col(text).alias("t")).mapInArrow(task, RUNS)
    return rows.groupBy("part").applyInArrow(total, RUNS)


def held_counts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, occurrences, count without the judged document's share)."""
    n, d = unpacked(row["b"], np.int64), unpacked(row["c"], np.int64)
    return unpacked_run(row["a"]), n, n * (d - 1) / d


def word_counts(row: dict) -> tuple[np.ndarray, ...]:
    return unpacked_run(row["d"]), *(unpacked(row[x], np.int64) for x in "efg")


def contexts_of(every, alone, docs):
    """Words before a word, without the judged document's share."""
    return every - alone / docs


def near_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.rint(counts), 0, 5).astype(np.int64), minlength=6)[1:5]


class Discounts:
    """What modified Kneser-Ney takes off each count, from the counts of counts of the whole table."""

    def __init__(self, n):
        n = [int(x) for x in n]
        d = [0.5, 0.75, 0.75]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]
        self.by = np.array([d[0], *d])

    def off(self, counts: np.ndarray) -> np.ndarray:
        return np.minimum(counts, self.by[np.clip(np.rint(counts), 0, 3).astype(np.int64)])


class Lower:
    """Probability of a word by the words before it."""

    def __init__(self, discounts: Discounts, total: float, even: float):
        self.discounts, self.total, self.even = discounts, total, even

    def of(self, contexts: np.ndarray) -> np.ndarray:
        return (contexts - self.discounts.off(contexts)) / (self.total or 1.0) + self.even

    @classmethod
    def fit(cls, counts: DataFrame, numbers: Numbers) -> tuple[Lower, np.ndarray]:
        """With the probabilities of the numbered words, by number."""
        end = numbers.end

        def numbered(row):
            words, every, alone, docs = word_counts(row)
            few = words < end
            return [dict(zip("wead", map(int, x))) for x in zip(words[few], every[few], alone[few], docs[few])]

        def sums(row, discounts=None):
            words, *x = word_counts(row)
            a = contexts_of(*(y[words >= end] for y in x))
            n = near_counts(a)
            return [{"a": float(a.sum()), "o": float(discounts.off(a).sum()) if discounts else 0.0, "n": len(a), **{f"n{k}": int(n[k]) for k in range(4)}}]

        def rest(discounts=None):
            found = map_runs(counts, list("defg"), lambda r: sums(r, discounts), "a double, o double, n bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
            row = found.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in found.columns]).first()
            return row["a"], row["o"], row["n"], np.array([row[f"n{k}"] for k in range(4)])

        some = map_runs(counts, list("defg"), numbered, "w bigint, e bigint, a bigint, d bigint")
        some = some.groupBy("w").agg(*[F.sum(x).alias(x) for x in "ead"]).toPandas().astype(np.int64)
        a = contexts_of(some["e"].to_numpy(), some["a"].to_numpy(), some["d"].to_numpy())
        total, _, n, near = rest()
        discounts = Discounts(near + near_counts(a))
        total, n = total + float(a.sum()), max(n + len(a), 1)
        off = rest(discounts)[1] + float(discounts.off(a).sum())
        lower = cls(discounts, total, (off / total if total else 1.0) / n)
        out = np.ones(end)
        out[some["w"].to_numpy()] = lower.of(a)
        return lower, out


def contexts(counts: DataFrame, numbers: Numbers, discounts: Discounts) -> DataFrame:
    """CONTEXTS: (a) first words, (b) the sums of their bigrams' counts and (c) discounts, for each part that meets or is asked
    about them, and the numbered words in part -1."""
    def parts(row):
        keys, _, c = held_counts(row)
        words, total, left = summed(keys & WORD, c, discounts.off(c))
        return [{"part": p, "chunk": row["part"], "a": packed_run(words[at]), "b": packed(total[at]), "c": packed(left[at])}
                for p, at in numbers.dealt(words)]

    def total(group: pa.Table) -> pa.Table:
        rows = group.select(["part", "chunk", "a", "b", "c"]).to_pylist()
        met = [unpacked_run(r["a"]) for r in rows]
        words, *sums = summed(np.concatenate(met), *(np.concatenate([unpacked(r[x], np.float64) for r in rows]) for x in "bc"))

        def run(part, at):
            return {"part": part, "kind": CONTEXTS, "a": packed_run(words[at]), "b": packed(sums[0][at]), "c": packed(sums[1][at])}

        out = [run(-1, np.flatnonzero(words < numbers.end)), run(rows[0]["part"], np.flatnonzero(words >= numbers.end))]
        for r, w in zip(rows, met):
            if r["chunk"] != rows[0]["part"] and len(w := w[w >= numbers.end]):
                out.append(run(r["chunk"], np.searchsorted(words, w)))
        return runs(out)

    return map_runs(counts, ["part", "a", "b", "c"], parts, RUNS).groupBy("part").applyInArrow(total, RUNS)


class Known:
    """What every task knows: numbers, discounts, and for numbered words ``low``, ``total`` and ``left``."""

    def __init__(self, numbers: Numbers, lower: Lower, low: np.ndarray, discounts: Discounts, total: np.ndarray, left: np.ndarray):
        self.numbers, self.lower, self.low, self.discounts, self.total, self.left = numbers, lower, low, discounts, total, left

    def logs(self, c, low, total, left):
        return np.log((c - self.discounts.off(c) + left * low) / total)


def back_off(total: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Log of the weight of the lower order after a word, 0 if no bigram counts there."""
    return np.log(np.where(total > 0, left, 1.0) / np.where(total > 0, total, 1.0))


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is there, and where."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool), at


class Part:
    """The tables of one part, from its runs."""

    def __init__(self, rows: list[dict], known: Known):
        self.known = known
        own = [r for r in rows if r["kind"] == COUNTS]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.keys, self.n, c = held_counts(own[0]) if own else none
        words, *x = word_counts(own[0]) if own else (none[0], none[1], none[1], none[1])
        rare = words >= known.numbers.end
        self.words, self.low = words[rare], known.lower.of(contexts_of(*(y[rare] for y in x)))
        met = [r for r in rows if r["kind"] == CONTEXTS]
        before = np.concatenate([none[0], *(unpacked_run(r["a"]) for r in met)])
        self.before, first = np.unique(before, return_index=True)
        self.total, self.left = (np.concatenate([none[2], *(unpacked(r[x], np.float64) for r in met)])[first] for x in "bc")
        total, left = self.context(self.keys & WORD)
        self.logs = known.logs(c, self.lower(self.keys >> WORD_BITS), total, left)
        self.more = self.logs - back_off(total, left)

    def context(self, words):
        few = words < self.known.numbers.end
        hit, at = found(self.before, words)
        out = []
        for many, rare in ((self.known.total, self.total), (self.known.left, self.left)):
            x = np.zeros(len(words))
            x[few], x[hit] = many[words[few].astype(np.int64)], rare[at[hit]]
            out.append(x)
        return out

    def lower(self, words):
        few = words < self.known.numbers.end
        out = np.ones(len(words))
        out[few] = self.known.low[words[few].astype(np.int64)]
        hit, at = found(self.words, words[~few])
        out[~few] = np.where(hit, self.low[at] if len(self.low) else 1.0, 1.0)
        return out

    def answers(self, keys):
        """Log of what each bigram adds after its first word's back-off, and that back-off for keys without a second word."""
        hit, at = found(self.keys, keys)
        out = np.log(self.lower(keys >> WORD_BITS))
        out[hit] = self.more[at[hit]]
        open_ = np.flatnonzero(keys >> WORD_BITS == NONE)
        out[open_] = back_off(*self.context(keys[open_]))
        return out


class Held:
    """The most frequent bigrams; packed on their way to tasks, as every executor writes them to its disk."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    def __getstate__(self):
        return packed_run(self.keys), packed(self.logs)

    def __setstate__(self, state):
        self.__init__(unpacked_run(state[0]), unpacked(state[1], np.float64))


class WordModel:
    """``tables``: runs of all parts; ``keys`` and ``logs``: the most frequent bigrams, sorted by key."""

    def __init__(self, tables: DataFrame, known: Known, keys: np.ndarray, logs: np.ndarray):
        self.tables, self.known, self.keys, self.logs = tables, known, keys, logs
        self.shared = tables.sparkSession.sparkContext.broadcast(known)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", hot: int = HOT) -> WordModel:
        numbers = frequent_words(docs, text)
        counts = staged(count_words(docs, numbers, text), "word-counts")
        lower, low = Lower.fit(counts, numbers)

        def often(row, least=None, share=0.0):
            keys, n, c = held_counts(row)
            few = (keys >> WORD_BITS < numbers.end) & (keys & WORD < numbers.end)
            if least is not None:
                few &= (n >= least) | (n == least - 1) & (mixed(keys) < np.uint64(share * 2**63) * np.uint64(2))
                return [{"a": packed_run(keys[few]), "b": packed(n[few]), "c": packed(c[few])}]
            return [{"n": int(x), "c": int(y)} for x, y in zip(*np.unique(np.minimum(n[few], 100_000), return_counts=True))]

        near = map_runs(counts, list("abc"), lambda r: [{f"n{k}": int(x) for k, x in enumerate(near_counts(held_counts(r)[2]))}],
                        "n0 bigint, n1 bigint, n2 bigint, n3 bigint")
        discounts = Discounts(x or 0 for x in near.agg(*[F.sum(x) for x in near.columns]).first())
        met = staged(contexts(counts, numbers, discounts), "word-contexts")
        total, left = np.zeros(numbers.end), np.zeros(numbers.end)
        for r in met.filter("part = -1").select("a", "b", "c").collect():
            at = unpacked_run(r["a"]).astype(np.int64)
            total[at], left[at] = unpacked(r["b"], np.float64), unpacked(r["c"], np.float64)
        known = Known(numbers, lower, low, discounts, total, left)
        # the bigrams that occur ``least`` times or more are at most ``hot``; a share of those that occur once less has room too
        sizes = map_runs(counts, list("abc"), often, "n bigint, c bigint").groupBy("n").agg(F.sum("c").alias("c")).toPandas()
        sizes = sizes.sort_values("n", ascending=False)
        n, ends = sizes["n"].to_numpy(), np.cumsum(sizes["c"].to_numpy())
        fits = int((ends <= hot).sum())
        least = int(n[fits - 1]) if fits else np.iinfo(np.int64).max
        more = 0 < fits < len(ends) and n[fits] == least - 1
        share = 0.98 * (hot - ends[fits - 1]) / (ends[fits] - ends[fits - 1]) if more else 0.0
        held = map_runs(counts, list("abc"), lambda r: often(r, least, share), "a binary, b binary, c binary").collect() if fits else []
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked_run(r["a"]) for r in held)])
        c = np.concatenate([np.zeros(0), *(unpacked(r["c"], np.float64) for r in held)])
        n = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["b"], np.int64) for r in held)])
        order = np.argsort(-n, kind="stable")[:hot]
        order = order[np.argsort(keys[order])]
        keys, c = keys[order], c[order]
        word, before = (keys >> WORD_BITS).astype(np.int64), (keys & WORD).astype(np.int64)
        return cls(counts.unionAll(met.filter("part >= 0")), known, keys, known.logs(c, low[word], total[before], left[before]))

    @property
    def table(self) -> DataFrame:
        """(k, n, p): log probability of each bigram that several documents have."""
        shared = self.shared

        def rows(group: pa.Table) -> pa.Table:
            part = Part(group.to_pylist(), shared.value)
            return pa.table({"k": pa.array(shared.value.numbers.bigrams(part.keys).view(np.int64)), "n": pa.array(part.n), "p": pa.array(part.logs)})

        return self.tables.groupBy("part").applyInArrow(rows, "k bigint, n bigint, p double")

    def append(self, docs: DataFrame, text: str, names: list[str]) -> DataFrame:
        """Append the words, the log probability of the bigrams that tasks hold, and the keys of all others."""
        shared = docs.sparkSession.sparkContext.broadcast((self.known.numbers, Held(self.keys, self.logs)))

        def make():
            numbers, often = shared.value
            known, logs = often.keys, often.logs

            def work(texts):
                keys, at = bigrams([t or "" for t in texts])
                keys = numbers.keys(keys)
                hit, place = found(known, keys)
                sums = np.bincount(at[hit], logs[place[hit]], minlength=len(texts))
                ends = np.cumsum(np.bincount(at[~hit], minlength=len(texts)))
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys[~hit].view(np.int64)))
                return [np.bincount(at, minlength=len(texts)), sums, rest]

            return work

        return map_texts(docs, text, [(names[0], "bigint"), (names[1], "double"), (names[2], "array<bigint>")], make)

    def means(self, rows: DataFrame, key: str, names: list[str]) -> DataFrame:
        """(id, x) from ``append``'s columns: the mean log probability per word; null without words. A key that comes again
        has the same text."""
        shared = self.shared

        def ask(batches):
            known, texts, task, chunks = shared.value, [], TaskContext.get().partitionId(), 0

            def flush():
                nonlocal chunks
                chunk, chunks = task << 32 | chunks, chunks + 1
                table = pa.Table.from_batches(texts).combine_chunks()
                texts.clear()
                rest = table.column("r").combine_chunks()
                at = np.repeat(np.arange(len(rest)), np.diff(rest.offsets.to_numpy()))
                keys = rest.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                before = keys & WORD
                few = before < known.numbers.end
                sums = table.column("h").to_numpy() + np.bincount(at[few], back_off(*(
                    x[before[few].astype(np.int64)] for x in (known.total, known.left))), minlength=len(rest))
                keys, at = np.concatenate([keys, before[~few]]), np.concatenate([at, at[~few]]).astype(np.uint32)
                order = np.argsort(keys, kind="stable")
                keys, at = keys[order], at[order]
                made = [{"part": p, "kind": ASKED, "chunk": chunk, "a": packed_run(keys[own]), "b": packed(at[own])}
                        for p, own in known.numbers.dealt(keys)]
                made.append({"part": chunk % known.numbers.parts, "kind": TEXTS, "chunk": chunk, "a": packed(table.column("i").to_numpy()),
                             "b": packed(sums), "c": packed(table.column("n").to_numpy())})
                return runs(made).to_batches()

            for batch in batches:
                texts.append(batch)
                if sum(len(b.column(3).flatten()) + len(b) for b in texts) > ASKED_AT_ONCE:
                    yield from flush()
            if texts:
                yield from flush()

        def answer(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            part, out = Part(rows, shared.value), [r for r in rows if r["kind"] == TEXTS]
            for r in rows:
                if r["kind"] == ASKED:
                    at = unpacked(r["b"], np.uint32)
                    sums = np.bincount(at, part.answers(unpacked_run(r["a"])))
                    at = np.flatnonzero(np.bincount(at))
                    out.append({"part": r["part"], "kind": ASKED, "chunk": r["chunk"], "a": packed_run(at.astype(np.uint64)),
                                "b": packed(sums[at].astype(np.float32))})
            return runs(out)

        def gather(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            own = next(r for r in rows if r["kind"] == TEXTS)
            sums = unpacked(own["b"], np.float64).copy()
            for r in rows:
                if r["kind"] == ASKED:
                    sums[unpacked_run(r["a"]).astype(np.int64)] += unpacked(r["b"], np.float32)
            return pa.table({"i": pa.array(unpacked(own["a"], np.int64)), "s": pa.array(sums), "n": pa.array(unpacked(own["c"], np.int64))})

        small_batches(rows.sparkSession)
        asked = rows.select(col(key).cast("bigint").alias("i"), col(names[0]).alias("n"), col(names[1]).alias("h"), col(names[2]).alias("r"))
        answered = self.tables.unionAll(asked.mapInArrow(ask, RUNS)).groupBy("part").applyInArrow(answer, RUNS)
        sums = answered.groupBy("chunk").applyInArrow(gather, "i bigint, s double, n bigint")
        sums = sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return sums.select(F.col("i").alias("id"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("x"))
