"""Token ids of whole texts with the tokenizers library, a distinct word at a time.

BPE merges never cross the borders of pre-tokens, so a text's ids are its pre-tokens' ids in order. Each distinct
pre-token of a task is encoded once by the library's model and remembered as bytes; a text's ids are these bytes joined.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache

import regex
from tokenizers import Tokenizer

CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
PATTERNS = {
    "ByteLevel": regex.compile(CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "Sequence": regex.compile(CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
}
#: The same classes within Latin-1, for the faster standard module.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN = {
    "ByteLevel": re.compile(CONTRACTIONS + rf"| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "Sequence": re.compile(CONTRACTIONS + rf"|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"),
}
#: Blocks in which Unicode versions differ about letters or case, and the capital sigma, whose lower case depends on
#: its place in Python alone. Segments with such characters are split by the library itself.
UNSETTLED = regex.compile("[Σ\u0530-\u058f\u0860-\u08ff\u0c00-\u0cff\u1c80-\u1c8f\u2080-\u209f\ua7c0-\ua7ff\uab60-\uab6f\U00010000-\U0010ffff]")


@lru_cache
def byte_alphabet() -> tuple[list[str], dict[str, int]]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    chars = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
    return chars, {c: b for b, c in enumerate(chars)}


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Splits texts as a tokenizer file says: special tokens first, then normalisation, then pre-tokens."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        kind = type(self.library.pre_tokenizer).__name__
        self.pattern, self.latin = PATTERNS[kind], LATIN[kind]
        self.lower = self.library.normalizer is not None

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at the odd places."""
        return self.between.split(text)

    def words(self, segment: str) -> list[str] | None:
        """Pre-tokens, or None where the library itself has to split."""
        if latin(segment):
            if self.lower:
                segment = (segment if segment.isascii() else unicodedata.normalize("NFC", segment)).lower()
            return self.latin.findall(segment)
        if UNSETTLED.search(segment):
            return None
        return self.pattern.findall(unicodedata.normalize("NFC", segment).lower() if self.lower else segment)


class WordIds:
    """Ids of whole texts; at most about ``most`` distinct words are remembered, then memory starts afresh."""

    def __init__(self, path: str, most: int = 400_000):
        self.split, self.most = Splitter(path), most
        self.known: dict[str | bytes, bytes] = {}
        self.model, self.chars = self.split.library.model, byte_alphabet()[0]

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.split.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the library's model, which takes them in the byte-level alphabet."""
        tokenize, chars = self.model.tokenize, self.chars
        return {w: array("I", [t.id for t in tokenize("".join([chars[b] for b in w.encode()]))]).tobytes() for w in words}

    def keys(self, text: str) -> list[str | bytes]:
        """Words of a text; in place of what is no word, its ids."""
        found: list[str | bytes] = []
        for k, segment in enumerate(self.split.segments(text)):
            if k % 2:
                found.append(array("I", [self.split.special[segment]]).tobytes())
            elif (words := self.split.words(segment)) is None:
                found += self.library([segment])
            else:
                found = found + words if found else words
        return found

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty; ``end`` is put after each."""
        if len(self.known) > self.most:
            self.known = {}
        lists = [self.keys(t) if t else [] for t in texts]
        new = list(set().union(*lists).difference(self.known))
        self.known.update(self.word_ids([k for k in new if isinstance(k, str)]))
        self.known.update((k, k) for k in new if isinstance(k, bytes))
        last = b"" if end is None else array("I", [end]).tobytes()
        ids = self.known.__getitem__
        return [b"".join(map(ids, x)) + last for x in lists]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory of words for each tokenizer and Python worker; a task has one core, so the library uses one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)
