"""Character mappings as column expressions, from tables that Unicode's own rules make."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that count as a hyphen.
DASHES = "‐‑‒–—−"
#: Letters that decomposition leaves whole, and what stands for them in keys.
LETTERS = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "đ": "d", "Đ": "D"}


@lru_cache(1)
def _compatible() -> tuple[str, str]:
    """Characters of the basic plane that compatibility normalisation makes another single one."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(1)
def _plain() -> tuple[str, str]:
    """Letters with marks, and the ASCII letter that they decompose to."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x < "\x80")) for c in range(0xA0, 0x2000)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(1)
def _spread() -> dict[str, str]:
    """Letters whose full upper case is more than one letter, and the single one that Unicode's simple mapping has: itself, its title form, or ẞ."""
    many = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
    return {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in many}


def simple_upper(x: str) -> str:
    """SQL: upper case letter by letter, as DuckDB has it, of one letter; Java spells ß as SS."""
    pairs = _spread()
    return f"CASE WHEN {x} IN ({', '.join(repr(c) for c in pairs)}) THEN translate({x}, '{''.join(pairs)}', '{''.join(pairs.values())}') ELSE upper({x}) END"


def compatible(x: Column) -> Column:
    """Compatibility forms of single characters (full width, superscripts, ligatures); sequences with combining marks stay."""
    out = F.translate(x, *_compatible())
    for c in "ﬀﬁﬂﬃﬄ…¨":
        out = F.replace(out, F.lit(c), F.lit(unicodedata.normalize("NFKC", c)))
    return out


def hyphens(x: Column) -> Column:
    return F.translate(x, DASHES, "-" * len(DASHES))


def without_marks(x: Column) -> Column:
    """ASCII letters for letters with marks; what has none goes."""
    return F.regexp_replace(F.translate(x, *_plain()), r"[^\x00-\x7F]", "")


def ascii_letters(x: Column) -> Column:
    """As :func:`without_marks`, with the letters of LETTERS written out before."""
    for letter, plain in LETTERS.items():
        x = F.replace(x, F.lit(letter), F.lit(plain))
    return without_marks(x)
