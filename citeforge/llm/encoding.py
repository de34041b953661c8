"""Whole-text encoding with the tokenizers library, remembering pieces that texts share.

A text is cut before each space that a non-white character follows. The byte-level pattern starts a
match at every such place, whatever stands before it, and the word pattern drops spaces; so the ids
of the pieces, one after the other, are the ids of the text. Pieces, and the matches that pieces
consist of, are encoded by the library once per worker as long as they stay in a bounded memory.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

#: Entries of a worker's memory before its older half is forgotten.
REMEMBERED = 400_000
_ODD = re.compile(r" (?=\s|\Z)")
#: Characters below U+0130 but for controls and blanks: there normalisation only lower-cases, and
#: Python's classes are those of the vocabularies' patterns.
_RANGE = [chr(c) for c in range(0x21, 0x130) if not 0x7F <= c <= 0xA0]


def _class(kind: str) -> str:
    return re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == kind))


_LATIN = re.compile(f"[\n{re.escape(''.join(_RANGE))}]*")
# The two vocabularies' patterns, over the characters of _RANGE, spaces and line feeds.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PATTERN = re.compile(f"{_CONTRACTIONS}|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
_BYTE_PATTERN = re.compile(f"{_CONTRACTIONS}| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^\\s{_class('L')}{_class('N')}]+|\\s+(?!\\S)|\\s+")


class _Memory(dict):
    """Makes what it is asked for, once as long as it is asked for again among the next ``limit`` entries."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def age(self) -> None:
        if len(self) > self.limit // 2:
            self.older = self.copy()
            self.clear()


class PieceEncoder:
    """Encodes batches of texts to little-endian ids of ``dtype``.

    keep_space: the space before a piece belongs to it (byte-level); else spaces are dropped.
    remembered: entries of its memory, some 200 bytes each."""

    def __init__(self, path: str, keep_space: bool, dtype: str, remembered: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_space, self.code = keep_space, "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.shown = byte_characters()
        self.matches = (_BYTE_PATTERN if keep_space else _WORD_PATTERN).findall
        n = remembered or REMEMBERED
        self.words = _Memory(self._word, n // 2)
        self.first = _Memory(self._piece, n // 8 if keep_space else n)
        self.rest = _Memory(lambda p: self._piece(" " + p), n) if keep_space else self.first

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return array(self.code, self.ids(text)).tobytes()

    def _word(self, word: str) -> bytes:
        """One match of the pattern: the library's BPE model has it at once, in the characters that stand for its bytes."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        body = piece[1:] if self.keep_space and piece[:1] == " " else piece
        if not _LATIN.fullmatch(body) or "<|" in body:
            return self._raw(piece)
        if not self.keep_space:
            piece = body.lower()
        return self.words[piece] if body.isalpha() else b"".join(map(self.words.__getitem__, self.matches(piece)))

    def encode(self, texts: list[str]) -> list[bytes]:
        for memory in (self.words, self.first, self.rest):
            memory.age()
        first, rest, out = self.first.__getitem__, self.rest.__getitem__, []
        for text in texts:
            if not self.keep_space:
                out.append(b"".join(map(rest, text.replace("\n", " ").split(" "))))
            elif _ODD.search(text):
                out.append(self._raw(text))
            else:
                head, *tail = text.split(" ")
                out.append(first(head) + b"".join(map(rest, tail)))
        return out


def byte_characters() -> dict[int, str]:
    """The character that a byte-level tokenizer shows for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}


def byte_level_vocabulary(tokenizer) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for; special tokens as their text."""
    byte = {c: b for b, c in byte_characters().items()}
    special = set(tokenizer.get_added_tokens_decoder())
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.encode() if i in special else bytes(byte[c] for c in token)
    return out
