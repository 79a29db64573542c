"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the words around each match.

The lexicon holds common insults and what a bounded sample of labelled documents adds: words, and stems of word families,
that occur in many different contexts of toxic documents and hardly in clean ones. Words of a text run through one
automaton whose states are the trie nodes that can still be reached within a term's edits (none below 5 letters, 1 below
9, else 2; swapping neighbours is one edit). Its transitions are worked out when first needed, most words leave it after
a few letters. A stem may end in any way and has the edits of its length too, but its last letter must be there. Learned
words that begin with a stem keep their own automata beside it. A misspelling that clean sample documents also use
is no misspelling.

Around each match, quotation marks and reporting verbs make it a quotation, words that address someone make it graver. A
logistic model of the weighed matches, their density and the densest stretch gives the score; it is fitted on the sample.

The sample holds at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled ids outside the held-out fold, the first by a hash of
the id; inputs are texts alone. Null and empty texts have no matches and get the score of such. Several labels of one id
count as their maximum. Without labels of both classes the fixed weights ``PLAIN`` hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.additive_model import fold
from revlens.llm.common import Kept, col, documents, fresh, labels, map_texts, staged

TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
FOLDS, HELD_OUT = 5, 0
#: Common insults; terms of labelled documents are added to them.
SEEDS = """
idiot moron stupid imbecile loser scum trash garbage pathetic worthless disgusting clown bastard bitch asshole dumbass
shithead fuckface retard cretin idiota imbécil estúpido basura escoria connard salope abruti ordure crétin arschloch
dummkopf abschaum vollidiot trottel
""".split()
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says say called calls wrote writes quoted quote quotes term word words insult "
                      "sagte nannte schrieb zitat wort dijo llamó escribió palabra dit écrit appelé mot".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein deine tu te ti tus eres toi ton ta es".split())
CONTEXT, STRETCH = 8, 50
STRIP = ".,;:!?\"'()[]{}“”„«»…|#*%&<>~^_=+"
#: A term needs this much evidence (twice the log likelihood ratio), this ratio of rates, and documents.
EVIDENCE, RATIO, LEAST_DOCS, FAMILY = 30.0, 8.0, 3, 4
STEM = 3  # least letters of a stem
PLAIN = np.array([-3.0, 3.0, 2.0, 0.3, 1.0, 1.0])


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """Deterministic automaton of a lexicon trie and the Levenshtein automata of its terms."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.ends, self.stem_ends = [0], [-1], [-1]
        self.last: dict[int, str] = {}  # letters that stems end in
        for term in terms:
            self._insert(term, edits(term), False)
        for stem in stems:
            self._insert(stem, edits(stem), True)
        self.moves: dict[tuple, dict[str, tuple | None]] = {}
        self.start = self._closed({(0, 0, "")})

    def _insert(self, term: str, most: int, stem: bool) -> None:
        node = 0
        self.allowed[0] = max(self.allowed[0], most)
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.allowed.append(0)
                self.ends.append(-1)
                self.stem_ends.append(-1)
            node = self.children[node][letter]
            self.allowed[node] = max(self.allowed[node], most)
        if stem:
            self.stem_ends[node] = most
            self.last[node] = term[-1]
        else:
            self.ends[node] = most

    def _closed(self, items: set) -> tuple:
        """Add what dropping letters of a term reaches; keep the fewest edits per node."""
        stack, least = list(items), {}
        while stack:
            node, used, wait = stack.pop()
            if used > self.allowed[node] or least.get((node, wait), 9) <= used:
                continue
            least[node, wait] = used
            if not wait:
                stack += [(child, used + 1, "") for child in self.children[node].values()]
        return tuple(sorted((node, used, wait) for (node, wait), used in least.items()))

    def step(self, state: tuple, letter: str) -> tuple | None:
        out = set()
        for node, used, wait in state:
            if wait:  # the letter before was the second of a swapped pair
                if letter == wait:
                    out.add((self.children[node][wait], used, ""))
                continue
            children = self.children[node]
            if letter in children:
                out.add((children[letter], used, ""))
            if used < self.allowed[node]:
                out.add((node, used + 1, ""))
                for first, child in children.items():
                    out.add((child, used + 1, ""))
                    if first != letter and letter in self.children[child]:
                        swapped = self.children[child][letter]
                        out.add((self._swap(swapped, first), used + 1, first))
        return self._closed(out) or None

    def _swap(self, after: int, first: str) -> int:
        """A helper node from which ``first`` leads on to the node after a swapped pair."""
        key = ("swap", after, first)
        if key not in self.__dict__.setdefault("helpers", {}):
            self.children.append({first: after})
            self.allowed.append(self.allowed[after])
            self.ends.append(-1)
            self.stem_ends.append(-1)
            self.helpers[key] = len(self.children) - 1
        return self.helpers[key]

    def match(self, word: str) -> int:
        """Edits to the nearest term, or of the word's beginning to a stem; -1 without one."""
        state, moves, begun = self.start, self.moves, -1
        for letter in word:
            steps = moves.get(state)
            if steps is None:
                steps = moves[state] = {}
            if letter in steps:
                state = steps[letter]
            else:
                state = steps[letter] = self.step(state, letter)
            if state is None:
                return begun
            for node, used, wait in state:
                if used <= self.stem_ends[node] and not wait and (not used or letter == self.last[node]):
                    if not used:
                        return 0
                    begun = used if begun < 0 else min(begun, used)
        found = [used for node, used, wait in state if not wait and used <= self.ends[node]]
        if begun > 0:
            found.append(begun)
        return min(found, default=-1)


def chunks(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Matcher:
    def __init__(self, terms: list[str], stems: list[str], clean: frozenset[str] = frozenset()):
        self.automaton, self.clean, self.known = TermAutomaton(terms, stems), clean, Kept(100_000)

    def find(self, texts: list[str | None]) -> list[tuple[list[str], list[tuple[int, int]]]]:
        """Per text its chunks and the (place, edits) of those that match."""
        cut = [chunks(t) for t in texts]
        self.known.turn()
        match, clean, known = self.automaton.match, self.clean, self.known.young
        for chunk in self.known.missing(set().union(*cut)):
            word = chunk.strip(STRIP)
            used = match(word) if word else -1
            known[chunk] = -1 if used > 0 and word in clean else used
        hits = {c for c in set().union(*cut) if known[c] >= 0}
        return [(c, [(i, known[x]) for i, x in enumerate(c) if x in hits] if not hits.isdisjoint(c) else []) for c in cut]


def weigh(words: list[str], hits: list[tuple[int, int]]) -> list[float]:
    """Exact and misspelled abuse, quotations, density and the most abuse in a stretch of words."""
    exact = near = quoted = 0.0
    weights = []
    marks = [sum(map(w.count, QUOTES)) for w in words] if hits else []
    for at, used in hits:
        around = words[max(0, at - CONTEXT): at + CONTEXT + 1]
        own = words[at]
        inside = own[0] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES and len(own) > 1
        before = sum(marks[max(0, at - STRETCH): at]) + (own[0] in QUOTES)
        after = sum(marks[at + 1: at + STRETCH + 1]) + (own.rstrip(".,;:!?")[-1:] in QUOTES)
        bare = {w.strip(STRIP) for w in around}
        if inside or (before % 2 and after) or not bare.isdisjoint(REPORTING):
            quoted += 1
            continue
        weight = 1.25 if not bare.isdisjoint(ADDRESS) else 1.0
        if used:
            near += weight
        else:
            exact += weight
        weights.append((at, weight if not used else weight / 2))
    most = held = 0.0
    first = 0
    for at, weight in weights:  # the heaviest stretch of STRETCH words
        held += weight
        while at - weights[first][0] >= STRETCH:
            held -= weights[first][1]
            first += 1
        most = max(most, held)
    density = min(1.0, 20 * sum(w for _, w in weights) / max(len(words), 1))
    return [np.log1p(exact), np.log1p(near), np.log1p(quoted), density, np.log1p(most)]


class ToxicityModel:
    def __init__(self, terms: list[str], stems: list[str], clean: frozenset[str] = frozenset(), weights: np.ndarray = PLAIN):
        self.terms, self.stems, self.clean, self.weights = terms, stems, clean, weights

    def scorer(self):
        matcher, empty = Matcher(self.terms, self.stems, self.clean), [0.0] * 5

        def score(texts):
            x = np.array([weigh(w, h) if h else empty for w, h in matcher.find(texts)], np.float64).reshape(len(texts), 5)
            return [1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:])))]

        return score


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; a weight that the rows say nothing about keeps its prior value."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty @ (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), slope)
        w += step / max(1.0, np.abs(step).max() / 2)
    return w


def sample_of(labelled: DataFrame, label: str, key: str, toxic: int, clean: int) -> DataFrame:
    rows = labelled.filter(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias("id")).agg(F.max(col(label)).alias("y"))
    rows = rows.filter(fold(F.col("id"), FOLDS) != HELD_OUT)
    take = lambda y, n: rows.filter((F.col("y") > 0) == F.lit(y)).orderBy(F.xxhash64("id"), "id").limit(n)
    return take(True, toxic).unionByName(take(False, clean)).select("id", (F.col("y") > 0).cast("int").alias("y"))


def word_contexts(rows: DataFrame) -> DataFrame:
    """(word, y, doc, context) of (t, y, id): a row for each different pair of neighbours of a word in a text."""
    def task(batches):
        for batch in batches:
            out: dict[str, list] = {"word": [], "y": [], "doc": [], "context": []}
            for text, y, doc in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = ["", *(w.strip(STRIP) for w in chunks(text)), ""]
                for word, a, b in {(w, a, b) for a, w, b in zip(words, words[1:], words[2:]) if len(w) > 2}:
                    out["word"].append(word)
                    out["y"].append(y)
                    out["doc"].append(doc)
                    out["context"].append(a + " " + b)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"y": pa.int32(), "doc": pa.int64()}.get(k, pa.string())) for k, v in out.items()})

    return rows.select("t", "y", "id").mapInArrow(task, "word string, y int, doc bigint, context string")


def evidence(pos, neg, all_pos, all_neg):
    """Twice the log likelihood ratio of a term's share of toxic contexts against that of all contexts."""
    share, own = all_pos / (all_pos + all_neg), pos / (pos + neg)
    part = lambda n, a, b: F.when(n > 0, n * F.log(a / b)).otherwise(0.0)
    return 2 * (part(pos, own, F.lit(share)) + part(neg, 1 - own, F.lit(1 - share)))


def learn_terms(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems of toxic documents from the sample (t, y, id)."""
    found = word_contexts(rows)
    found = found.groupBy("word", "y", F.xxhash64("context").alias("c")).agg(F.min("doc").alias("doc"))
    toxic = F.when(F.col("y") == 1, F.col("doc"))
    found = staged(found.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"),
                                             F.count_distinct(toxic).alias("docs")), "toxic-words")
    total = found.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if not total["p"] or not total["n"]:
        return [], []
    p, n = float(total["p"]), float(total["n"])
    strong = lambda df: df.filter((F.col("docs") >= LEAST_DOCS) & ((F.col("pos") + 0.5) / (F.col("neg") + 0.5) * (n / p) >= RATIO) & (
        evidence(F.col("pos"), F.col("neg"), p, n) >= EVIDENCE))
    words = [r["word"] for r in strong(found).select("word").orderBy("word").collect()]  # bounded by the sample
    prefixes = found.filter(F.length("word") >= STEM).select(
        "*", F.explode(F.transform(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(STEM + 6))),
                                   lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem"))
    prefixes = prefixes.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("docs").alias("docs"),
                                            F.max("pos").alias("most"), F.sum((F.col("pos") > 0).cast("int")).alias("family"))
    stems = {r["stem"]: r["pos"] for r in strong(prefixes.filter((F.col("family") >= FAMILY) & (2 * F.col("most") <= F.col("pos")))).select("stem", "pos").collect()}
    # of nested stems with about the same support the longest, and of the rest the shortest
    whole = [s for s in stems if not any(t.startswith(s) and len(t) == len(s) + 1 and stems[t] >= 0.9 * stems[s] for t in stems)]
    stems_kept = sorted(s for s in whole if not any(s != t and s.startswith(t) for t in whole))
    return words, stems_kept


def fit_toxicity(docs: DataFrame, labelled: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
                 toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    sample = sample_of(labelled, label, key, toxic_rows, clean_rows)  # its size is a parameter, so it is broadcast
    rows = docs.select(col(key).alias("k"), col(text).alias("t")).join(F.broadcast(sample), F.col("k") == F.col("id")).select("t", "y", "id")
    rows = staged(rows, "toxic-sample")
    terms, stems = learn_terms(rows)
    terms = sorted({*SEEDS, *terms})

    def near_words():
        matcher = Matcher(terms, stems)
        return lambda texts: [[sorted({w[i].strip(STRIP) for i, used in h if used}) for w, h in matcher.find(texts)]]

    near = map_texts(rows.filter("y = 0"), "t", [("words", "array<string>")], near_words)
    clean = frozenset(r["w"] for r in near.select(F.explode("words").alias("w")).distinct().collect())  # bounded by the sample
    model = ToxicityModel(terms, stems, clean)

    def weighed():
        matcher = Matcher(terms, stems, clean)
        return lambda texts: [[[float(v) for v in weigh(w, h)] for w, h in matcher.find(texts)]]

    known = map_texts(rows.select("t", "y"), "t", [("x", "array<double>")], weighed).select("x", "y").toPandas()
    if known["y"].nunique() == 2:
        x = np.array(known["x"].tolist(), np.float64)
        order = np.lexsort((known["y"], *x.T))  # sums in one order on every run
        model.weights = np.round(logistic(x[order], known["y"].to_numpy(np.float64)[order], PLAIN), 9)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str, text: str = "text") -> DataFrame:
    """Append the score under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return map_texts(docs, text, [(name, "double")], lambda: shared.value.scorer())


def clean_rows(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below a half, with its columns."""
    name, = fresh(docs, "toxicity")
    scored = score_toxicity(docs, fit_toxicity(docs, labelled, key=key, text=text), name, text)
    return scored.filter(col(name) < 0.5).drop(name)


def op4_term_automata(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, labels(spark, folder)), "score").drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
