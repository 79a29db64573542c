"""Token counts under a unigram model, from one forward pass over a trie of distinct pre-tokens.

A pre-token is a word of the text (between ASCII white space) with the mark of a word start before it. Its count is the
number of pieces on the segmentation with the best sum of log probabilities. Distinct pre-tokens of a slice are visited
in sorted order, a depth-first walk of their trie; the stack keeps the best score and its piece count for every prefix
on the current path, so a shared prefix is scored once, and the values at a word's end are its terminal count.

Log probabilities follow Zipf's law over the ranks of the vocabulary file. A character that no piece holds costs its
UTF-8 bytes, a token each. Of equal scores the one with the longer last piece stands. Null and empty texts have no
tokens. Rows are independent, so ties, repeated rows, empty tables and further columns change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from revlens.llm.common import Kept, documents, held, map_texts, tokenizer_file

START = "▁"
ZIPF_SHIFT = 2.7
BYTE_PENALTY = 10.0


class UnigramTrie:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
        norm = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(pieces))))
        self.scores = {p: -math.log(r + ZIPF_SHIFT) - norm for r, p in enumerate(pieces)}
        self.tails = {p[i:] for p in pieces for i in range(len(p))}
        self.per_byte = min(self.scores.values()) - BYTE_PENALTY
        self.known = Kept(200_000)

    def walk(self, words: list[str]):
        """(count, score) of each word; distinct words in sorted order."""
        scores, tails, per_byte = self.scores, self.tails, self.per_byte
        best, count, path = [0.0], [0], ""
        for word in words:
            shared, most = 0, min(len(word), len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            path = word
            for end in range(shared + 1, len(word) + 1):
                top, pieces, start = -math.inf, 0, end - 1
                while start >= 0 and (tail := word[start:end]) in tails:
                    score = scores.get(tail)
                    if score is not None and (score := best[start] + score) >= top:
                        top, pieces = score, count[start] + 1
                    start -= 1
                if top == -math.inf:
                    size = len(word[end - 1].encode())
                    top, pieces = best[end - 1] + size * per_byte, count[end - 1] + size
                best.append(top)
                count.append(pieces)
            yield count[-1], best[-1]

    def counts(self, texts: list[str | None]) -> tuple[list[int], list[int], list[float]]:
        """Words, tokens and best log score of each text."""
        cut = [t.encode().split() if t else () for t in texts]
        self.known.turn()
        new = {START + w.decode(): w for w in self.known.missing(set().union(*cut))}
        known, order = self.known.young, sorted(new)
        for word, found in zip(order, self.walk(order), strict=True):
            known[new[word]] = found
        tokens = [sum([known[w][0] for w in parts]) for parts in cut]
        scores = [math.fsum([known[w][1] for w in parts]) for parts in cut]
        return [len(p) for p in cut], tokens, scores


def count_tokens(docs: DataFrame, text: str, vocabulary: str, names=("n_words", "n_tokens", "log_score")) -> DataFrame:
    """Append the number of words and tokens and the log score of every whole text."""
    def make():
        return held("unigram", vocabulary, lambda: UnigramTrie(vocabulary)).counts

    return map_texts(docs, text, list(zip(names, ("bigint", "bigint", "double"))), make)


def op5_token_counts(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return count_tokens(docs, "text", tokenizer_file("piece_bpe_32k.model")).drop("text")
