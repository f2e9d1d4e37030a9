"""Ids of whole texts by a tokenizer file, each distinct word encoded once per task.

Byte-level BPE never merges across its pre-tokens, so a text's ids are its pre-tokens' ids in a
row. ``WordEncoder`` splits with the tokenizer's own pattern, keeps a bounded table of the words
seen and lets the merging model of the tokenizers library encode the new ones. A text that holds a
character outside the plain Latin range (where two Unicode versions might split differently) or
a special token goes to the library as a whole; so the ids are the library's in every case.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

KNOWN_WORDS = 400_000  # about 80 MB a Python worker at most

# Pre-token patterns of the two files; [^\W\d_] and \d are \p{L} and \p{N} there.
# Branches that start with other characters stand first where they are more frequent.
_BYTE = r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_WORD = r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+"
_ODD = re.compile("[\x1c-\x1f\x80-\xbf\xd7\xf7İƀ-\U0010ffff]")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table(dict):
    """Bounded table in two halves: when the young half is full it becomes the old one.

    A word that is missing is looked up in the old half, else encoded, and put into the young one;
    so ids of words in a row are one lookup a word.
    """

    def __init__(self, limit: int, encode: Callable[[str], bytes]) -> None:
        self.limit, self.encode, self.old = max(1, limit // 2), encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Library-exact ids, as little-endian unsigned 32-bit bytes, of lists of texts."""

    def __init__(self, path: str, limit: int = KNOWN_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lowers = self.library.normalizer is not None
        self.find = re.compile(_WORD if self.lowers else _BYTE).findall
        self.merge = self.library.model.tokenize
        self.shown = {b: c for b, c in enumerate(_spelling())}
        self.words = _Table(limit, self.by_model)
        self.pieces: list[bytes] | None = None

    @staticmethod
    def plain(text: str) -> bool:
        if text.isascii():
            return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return "<|" not in text and _ODD.search(text) is None

    def id_bytes(self) -> list[bytes]:
        """Bytes of every id of a byte-level vocabulary, built once a process: a piece spells
        each byte as one character, and a piece with any other character stands for itself."""
        if self.pieces is None:
            byte_of = {c: b for b, c in enumerate(_spelling())}
            names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
            self.pieces = [
                bytes(map(byte_of.__getitem__, n)) if all(map(byte_of.__contains__, n)) else n.encode("utf-8") for n in names
            ]
        return self.pieces

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a plain text."""
        return self.find(text.lower() if self.lowers else text)

    def by_library(self, items: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def by_model(self, word: str) -> bytes:
        """Ids of one pre-token: both files spell its bytes as characters and merge those."""
        rest = word[1:]
        if word[0] == " " and rest.isascii() and rest.isalnum():
            spelt = self.shown[32] + rest
        else:
            spelt = word.encode("utf-8").decode("latin-1").translate(self.shown)
        return _packed([t.id for t in self.merge(spelt)])

    def word_ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of lists of pre-tokens, each list joined."""
        return [self.few_ids(words) for words in lists]

    def few_ids(self, words: list[str]) -> bytes:
        """Ids of a few pre-tokens, joined."""
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, items: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for low in range(0, len(items), 256):  # few texts at a time keep the lists and their table small
            out += self._encode(items[low : low + 256])
        return out

    def _encode(self, items: list[str]) -> list[bytes]:
        plain = [self.plain(t) for t in items]
        whole = iter(self.by_library([t for t, p in zip(items, plain, strict=True) if not p]))
        split = iter(self.word_ids([self.pre_tokens(t) for t, p in zip(items, plain, strict=True) if p]))
        return [next(split if p else whole) for p in plain]


def _spelling() -> list[str]:
    """The character that spells each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b) or chr(b) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a tokenizer file; its table of words serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
