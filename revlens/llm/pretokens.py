"""Lower-case pre-tokens of ``word_bpe_49k.json``, taken from distinct whitespace-separated chunks.

The file's rules (compose, fold white space, lower-case, split into words, digits and symbol runs) never look across
white space, so a chunk's pre-tokens do not depend on its neighbours: each distinct chunk is split once and its encoding
is shared by all documents of a task.
"""

from __future__ import annotations

import re
import unicodedata

import regex

from revlens.llm.common import Kept

#: Unicode White_Space, which is what the file's ``\\s`` means; ``str.split`` alone would also cut at \\x1c-\\x1f.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed values, must equal the file's: the split pattern and the two added tokens with their ids.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
SPECIAL_RE = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
#: In this range the character tables of all libraries agree.
PLAIN = re.compile("[!-\u024f]*")
RARE = re.compile("[^\\x00-\u024f]")
#: Marks a chunk that is an added token: no chunk has white space in it.
MARK = " "


def chunks(text: str | None, library=None) -> list[str]:
    """Normalised chunks in order; an added token comes as MARK followed by its text. Null and empty give none.

    Texts with characters outside Latin are normalised by the library: its character tables may be newer than Python's.
    """
    if not text:
        return []
    if "<|" in text and SPECIAL_RE.search(text):
        out: list[str] = []
        for part in SPECIAL_RE.split(text):
            out += [MARK + part] if part in SPECIAL else _chunks(part, library)
        return out
    return _chunks(text, library)


def _chunks(text: str, library=None) -> list[str]:
    if text.isascii():
        text = text.lower()
    elif library is not None and RARE.search(text):
        text = library.normalizer.normalize_str(text)
    else:
        text = unicodedata.normalize("NFC", text).lower()
    if SEPARATORS.search(text):
        return [x for x in WHITE.split(text) if x]
    return text.split()


def words(chunk: str, library=None) -> list[str]:
    """Pre-tokens of one chunk; chunks with rare characters go through the library's own splitter."""
    if library is not None and not PLAIN.fullmatch(chunk):
        return [unbyte(w) for w, _ in library.pre_tokenizer.pre_tokenize_str(chunk)]
    return SPLIT.findall(chunk)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    return table | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)}


LETTERS = byte_letters()
BYTES = {c: b for b, c in LETTERS.items()}


def spelled(word: str) -> str:
    """A word in byte letters."""
    return word.encode().decode("latin-1").translate(LETTERS)


def unbyte(word: str) -> str:
    return bytes(BYTES[c] for c in word).decode()


class ChunkEncoder:
    """Ids of whole texts from the encodings of distinct words; recent chunks are remembered.

    ``encode_words`` takes distinct words in byte letters, sorted, and gives the ids of each, ``width`` bytes an id.
    """

    def __init__(self, library, encode_words, width: int = 2, remembered: int = 150_000):
        self.library, self.encode_words = library, encode_words
        self.special = {MARK + text: number.to_bytes(width, "little") for text, number in SPECIAL.items()}
        self.known = Kept(remembered)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [chunks(t, self.library) for t in texts]
        self.known.turn()
        known = self.known.young
        known.update(self.special)
        new = {c: words(c, self.library) for c in self.known.missing(set().union(*cut))}
        spellings = {w: spelled(w) for w in set().union(*new.values())}
        order = sorted(set(spellings.values()))
        codes = dict(zip(order, self.encode_words(order), strict=True))
        for chunk, parts in new.items():
            known[chunk] = b"".join([codes[spellings[w]] for w in parts])
        return [b"".join([known[c] for c in parts]) for parts in cut]
