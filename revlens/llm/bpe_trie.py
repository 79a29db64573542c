"""BPE encoding and decoding by a walk over a trie of distinct words.

The encoding of a prefix is fixed by its last token: the rest is the encoding of the shorter prefix before it. Exactly
one token that ends a prefix can stand last, the one that merging keeps apart from the last token of what comes before.
Words of a slice are visited in sorted order, which is a depth-first walk of their trie: the stack holds the last token of
every prefix on the current path and where it begins, so a shared prefix is encoded once. A word's ids are read off these
back pointers at its end, so memory grows with the length of a word and not with its square.

Every text is read whole. Null and empty texts give no ids and an empty decoded text. Rows are independent: ties,
repeated rows, empty tables and further columns change nothing.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame

from revlens.llm import pretokens
from revlens.llm.common import col, documents, held, map_texts, tokenizer_file

END = "</w>"
START = 65535  # stands before the first token
NEVER = 1 << 30
#: Token lengths in the order they are tried; only one can fit, so any order is right and this one is usually short.
FIRST = (3, 2, 4, 1)


class Merges:
    """Which tokens merging keeps apart, from a vocabulary whose ids follow the order of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END) and t != END}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made, left, right = vocab[a + b], vocab[a], vocab[b]
            self.parts[made] = (left, right)
            self.merged[left << 16 | right] = made
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.whole: dict[int, bool] = {}
        self.memo: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[int]:
        """What touches a token's right (1) or left (0) border while it is put together, from letter to token."""
        out = [token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append(token)
        return out[::-1]

    def untouched(self, a: int, b: int, last: bool) -> bool:
        """Whether no merge crosses from a to b before both are complete, nor after that if ``last``."""
        xs, ys, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            left = xs[i + 1] if i + 1 < len(xs) else NEVER
            right = ys[j + 1] if j + 1 < len(ys) else NEVER
            if left == right == NEVER and not last:
                return True
            crossing = self.merged.get(xs[i] << 16 | ys[j], NEVER)
            # equal merges go from left to right: the one inside a first, then the crossing one, then the one inside b
            if crossing < left and crossing <= right and crossing != NEVER:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's letters gives the token."""
        if token not in self.parts:
            return True
        if token not in self.whole:
            a, b = self.parts[token]
            self.whole[token] = self.is_whole(a) and self.is_whole(b) and self.untouched(a, b, False)
        return self.whole[token]

    def fits(self, before: int, token: int) -> bool:
        return self.is_whole(token) and (before == START or self.untouched(before, token, True))


class TrieEncoder:
    def __init__(self, path: str, memo_limit: int = 200_000):
        self.merges, self.memo_limit = Merges(path), memo_limit
        m = self.merges
        self.id_bytes = {i: i.to_bytes(2, "little") for i in m.names}
        self.lengths = (*FIRST, *range(5, m.longest + 1))

    def encode_sorted(self, spellings: list[str]):
        """Ids (2 bytes each) of each spelled word. The words must be distinct and sorted."""
        m, id_bytes, lengths, memo = self.merges, self.id_bytes, self.lengths, self.merges.memo
        inner, final = m.inner, m.final
        last, back, path = [START], [0], ""
        for word in spellings:
            n = len(word) - 1  # the last letter is of another kind: it ends the word
            shared, most = 0, min(n, len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared + 1:], back[shared + 1:]
            path = word[:n]
            for end in range(shared + 1, n + 2):
                pieces = inner if end <= n else final
                for length in lengths:
                    if length > end:
                        if length > 4:
                            raise ValueError(f"no token ends {word[:end]!r}")
                        continue
                    token = pieces.get(word[end - length:end])
                    if token is None:
                        continue
                    key = last[end - length] << 16 | token
                    fits = memo.get(key)
                    if fits is None:
                        fits = memo[key] = m.fits(last[end - length], token)
                    if fits:
                        last.append(token)
                        back.append(end - length)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            made, at = [], n + 1
            while at:
                made.append(id_bytes[last[at]])
                at = back[at]
            made.reverse()
            yield b"".join(made)
            del last[n + 1:], back[n + 1:]
        if len(memo) > self.memo_limit:
            memo.clear()


class Codec(pretokens.ChunkEncoder):
    """Encodes lists of texts to 2-byte ids and decodes ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.trie = TrieEncoder(path)
        super().__init__(Tokenizer.from_file(path), self.trie.encode_sorted)  # the library only splits rare characters
        names = self.trie.merges.names
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)

    def decode(self, ids: bytes) -> str:
        """As the library does without a decoder in the file: the tokens' own strings, with a space between them."""
        if not ids:
            return ""
        numbers = np.frombuffer(ids, "<u2")
        special = {n: t for t, n in pretokens.SPECIAL.items()}
        if int(numbers.max()) >= len(self.names):
            return " ".join([special.get(int(n)) or self.names[n] for n in numbers])
        return " ".join(self.names[numbers].tolist())


def encode_decode(docs: DataFrame, text: str, tokenizer: str, ids: str | None = None, decoded: str | None = None,
                  digests: tuple[str, str, str] | None = None) -> DataFrame:
    """Append the ids (binary, 2 bytes each) and the decoded text, and/or (count, sha256 of ids, sha256 of decoded text).

    The digest of ids is over unsigned 32-bit little-endian integers.
    """
    fields = [(n, k) for n, k in ((ids, "binary"), (decoded, "string")) if n]
    if digests:
        fields += list(zip(digests, ("bigint", "string", "string")))

    def make():
        codec = held("codec", tokenizer, lambda: Codec(tokenizer))

        def work(texts):
            codes = codec.encode(texts)
            out = [codes] if ids else []
            if decoded:
                out.append([codec.decode(c) for c in codes])
            if digests:
                wide = (np.frombuffer(c, "<u2").astype("<u4").tobytes() for c in codes)
                out += [
                    [len(c) // 2 for c in codes],
                    [hashlib.sha256(w).hexdigest() for w in wide],
                    [hashlib.sha256(codec.decode(c).encode()).hexdigest() for c in codes],
                ]
            return out

        return work

    return map_texts(docs, text, fields, make)


def op3_bpe_trie(spark, folder):
    docs = documents(spark, folder).select(col("doc_id"), col("text"))
    out = encode_decode(docs, "text", tokenizer_file("word_bpe_49k.json"),
                        digests=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.drop("text")
