"""Vectorised word hashing over the raw bytes of Arrow string columns.

A word is a run of ``[^\\x20\\x09-\\x0D]`` unless another separator table is given. Everything
works on slices of bounded size, so memory does not follow the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 500_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z on single bytes; other bytes, also those of multi-byte characters, stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Start values and odd multipliers of the two hash functions.
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Longer words are hashed one by one, by the library.
LONG_WORD = 64


def tidy(run):
    """run over a partition's batches, giving freed memory back to the system at the end.

    Workers live on for other stages, and what an allocator keeps would count for all of them."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Hash of a followed by b. Not linear in a: sums of powers would take some sequences for equal whatever the base."""
    a = a * np.uint64(_BASES[which])
    return (a ^ (a >> np.uint64(29))) + b


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, as a view; beyond the end they are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def spans_hash(view: np.ndarray, start: np.ndarray, length: np.ndarray, which: int) -> np.ndarray:
    """Hash of the bytes from each start on, length of them; view is eights of the data."""
    out = mix(length.astype(np.uint64) + np.uint64(_SEEDS[which]))
    live, at = np.flatnonzero(length > 0), 0
    while len(live):
        left = length[live] - at
        part = view[start[live] + at]
        short = left < 8
        if short.any():
            part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mix((out[live] ^ part) * np.uint64(_BASES[which]))
        at += 8
        live = live[left > 8]
    return out


@dataclass
class Words:
    """The words of a slice of documents: data is its bytes, the rest has an entry per word."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per document, the index of its first word; one entry more at the end
    base: np.ndarray  # per document, where its bytes start; one entry more at the end

    def hashes(self, which: int = 0) -> np.ndarray:
        """64 bits of each word's bytes; the two functions together tell words apart by 128."""
        length = self.end - self.start
        long = np.flatnonzero(length > LONG_WORD)
        out = spans_hash(eights(self.data), self.start, np.where(length > LONG_WORD, 0, length), which)
        for i in long:
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), _SEEDS[which])
        return out


def split_words(data: np.ndarray, base: np.ndarray, sep: np.ndarray = SPACE) -> Words:
    n, docs = len(data), len(base) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(docs + 1, np.int64), base)
    gap = sep[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    full = base[1:] > base[:-1]
    before[base[:-1][full]] = True
    after[base[1:][full] - 1] = True
    word = ~gap
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    first = np.searchsorted(start, base)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(data, doc, start, end, first, base)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for runs of rows of about limit bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def ngrams(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries; len(h) - k + 1 of them, also across documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, power, span = 0, None, h, 1
    while True:
        if k & span:
            part = power[done : done + n]
            out = part.copy() if out is None else join_hash(out, part, which)
            done += span
        if span * 2 > k:
            break
        power = join_hash(power[:-span], power[span:], which)
        span *= 2
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive entries."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= k:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[k - span : k - span + n])
