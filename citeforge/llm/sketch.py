"""A count-min sketch in two bits a cell: never seen, seen once, seen more often.

Each partition makes its own sketch of 64-bit hashes; partial sketches meet by block of cells and
are merged, counts of two partials adding up and stopping at two. A cell collects every hash that
falls into it, so the least of a hash's cells is never below its true count: what was hashed twice
is always told to be repeated, and something hashed once is told so only if other hashes share all
its cells. The
sketch has at most 2**MAX_BITS cells, so its broadcast is bounded; over more data it only gets less
selective, and the exact step behind it gets more to do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .textbytes import mix, tidy

MAX_BITS, MIN_BITS, BLOCKS = 28, 16, 256
#: Hashes that a task holds before it emits a partial sketch.
HELD = 2_000_000


def bits_for(input_bytes: int) -> int:
    return max(MIN_BITS, min(MAX_BITS, (2 * max(input_bytes, 1)).bit_length()))


def cells(h: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The cells of each hash, one for each of depth hash functions."""
    out = [(h >> np.uint64(64 - bits)).astype(np.uint32)]
    for i in range(1, depth):
        out.append((mix(h + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.uint32))
    return out


def _partial(held: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    c = np.sort(np.concatenate(held))
    new = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    c, twice = c[at], np.diff(np.r_[at, len(c)]) > 1
    width = 1 << (bits - 8)
    edge = np.searchsorted(c, np.arange(BLOCKS + 1, dtype=np.uint64) * np.uint64(width))
    pack = zstandard.ZstdCompressor(level=1)
    rows: list[tuple[int, bytes, bytes]] = []
    for b in range(BLOCKS):
        lo, hi = edge[b], edge[b + 1]
        if hi > lo:
            own, more = np.zeros(width, bool), np.zeros(width, bool)
            i = c[lo:hi].astype(np.int64) - b * width
            own[i], more[i] = True, twice[lo:hi]
            rows.append((b, pack.compress(np.packbits(own).tobytes()), pack.compress(np.packbits(more).tobytes())))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "once", "twice"])


def repeated_cells(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int = 1) -> Broadcast:
    """The broadcast bitmap of cells that hashes of df's rows fall into more than once."""

    def part(batches):
        held, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                held += cells(h, bits, depth)
                n += len(h) * depth
                if n >= HELD:
                    yield from _partial(held, bits)
                    held, n = [], 0
        if n:
            yield from _partial(held, bits)

    def merge(batches):
        got: dict[int, list[np.ndarray]] = {}
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            for b, one, two in zip(*(batch.column(i).to_pylist() for i in range(3))):
                one, two = (np.frombuffer(un.decompress(x), np.uint8) for x in (one, two))
                if b not in got:
                    got[b] = [one.copy(), two.copy()]
                else:
                    have = got[b]
                    have[1] |= two | (have[0] & one)
                    have[0] |= one
        pack = zstandard.ZstdCompressor(level=1)
        for b, (_, two) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack.compress(two.tobytes())], pa.binary())], names=["block", "bits"])

    partial = df.mapInArrow(tidy(part), "block int, once binary, twice binary")
    merged = partial.repartition("block").mapInArrow(tidy(merge), "block int, bits binary")
    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS // 8), np.uint8)
    for r in merged.collect():  # BLOCKS rows of 2**MAX_BITS / 8 bytes in all at most
        out[r.block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.bits)), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.reshape(-1))


def is_repeated(bitmap: np.ndarray, h: np.ndarray, bits: int, depth: int = 1) -> np.ndarray:
    out = np.ones(len(h), bool)
    for c in cells(h, bits, depth):
        out &= (bitmap[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & 1 == 1
    return out
