"""Marking all but the first of equal things: the tasks' side of both substring dedups.

A thing is a row of two halves of a hash, its place (the document's row and a start) and what else
travels with it. A task settles what it holds: of equal things only the earliest goes on, the others
are marked at once, so that what occurs in a third of all rows is shuffled once a task. Rows then meet
by hash, sorted by place, and all but the first of a hash are marked. Marks are runs of starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import order_id
from .textbytes import tidy

TAG = 2**31 - 1
#: A row of the table: its doc_id, then 64 and 31 bits of its text's hash, which tell rows apart that share a doc_id.
KEY = ["doc", "text_key", "tag"]
MARKS = "doc long, text_key long, tag long, runs binary"
#: A thing's place; pos is tag << 32 | start.
PLACE = ["doc", "text_key", "pos"]
#: Things that a task holds before it settles them and passes on.
HELD = 250_000


def row_key():
    """The columns of KEY for a table of documents."""
    return [order_id().alias("doc"), F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit("second"), "text").bitwiseAND(F.lit(TAG)).alias("tag")]


def runs_of(doc: np.ndarray, text_key: np.ndarray, pos: np.ndarray, span: np.ndarray | None = None) -> pa.RecordBatch:
    """Marked starts as one row for each document: runs of consecutive starts, as int32 pairs (start, length).

    span: how many starts each of the places stands for, one if not given."""
    order = np.lexsort((pos, text_key, doc))
    d, x, t, s = doc[order], text_key[order], pos[order] >> 32, pos[order] & 0xFFFFFFFF
    end = s + (1 if span is None else span[order])
    other = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (t[1:] != t[:-1])]
    head = np.flatnonzero(other | np.r_[True, s[1:] > end[:-1]])
    pairs = np.stack([s[head], np.maximum.reduceat(end, head) - s[head]], 1).astype("<i4")
    cut = np.flatnonzero(other[head])
    blobs = [pairs[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(head)])]
    return pa.RecordBatch.from_arrays([*(pa.array(c[head][cut], pa.int64()) for c in (d, x, t)), pa.array(blobs, pa.binary())], names=[*KEY, "runs"])


def merged(found: DataFrame) -> DataFrame:
    """One row for each document that has marks: runs found in the tasks of many hashes, as few runs."""

    def merge(batches):
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                pair = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)
                pair = pair[np.argsort(pair[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pair.sum(1))
                head = np.flatnonzero(np.r_[True, pair[1:, 0] > reach[:-1]])
                out.append(np.stack([pair[head, 0], reach[np.r_[head[1:], len(pair)] - 1] - pair[head, 0]], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=[*KEY, "runs"])

    return found.groupBy(*KEY).agg(F.collect_list("runs").alias("runs")).mapInArrow(tidy(merge), MARKS)


def covered(runs: bytes, n: int, window: int) -> np.ndarray:
    """Which of n entries lie in a window that starts at one of the runs."""
    pair = np.frombuffer(runs, "<i4").reshape(-1, 2)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, pair[:, 0], 1)
    np.subtract.at(edge, pair[:, 0] + pair[:, 1] + (window - 1), 1)
    return np.cumsum(edge[:-1]) > 0


def _names(extra: list[str]) -> list[str]:
    return ["h1", "h2", *PLACE, *extra, "runs"]


def _settle(parts: list[list[np.ndarray]], extra: list[str]) -> Iterator[pa.RecordBatch]:
    cols = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort(cols[4::-1])
    h1, h2, *row = cols = [x[order] for x in cols]
    same = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    late = np.any([x != x[head] for x in row[:3]], 0)
    again = same & np.r_[False, np.all([x[1:] == x[:-1] for x in row[:3]], 0)]
    go = np.flatnonzero(~late & ~again)
    for lo in range(0, len(go), 50_000):
        g = go[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[g].view(np.int64)) for x in cols), pa.nulls(len(g), pa.binary())], names=_names(extra))
    if late.any():
        r = runs_of(*(x[late] for x in row[:3]), row[3][late].astype(np.int64) if extra else None)
        none = pa.nulls(r.num_rows, pa.int64())
        # A settled row carries the tag where others have their place.
        yield pa.RecordBatch.from_arrays([none, none, *r.columns[:3], *[none] * len(extra), r.columns[3]], names=_names(extra))


def first_ones(rows: DataFrame, find, extra: list[str] = [], firsts: bool = False) -> DataFrame:
    """Marks (KEY, runs) of all things but the first of each hash.

    find(batch) gives lists of arrays for a batch of rows: h1, h2, doc, text_key, pos, and those of
    extra, the first of which is the number of starts that the thing stands for. With firsts, rows of
    the first things come as well, all columns but runs filled; marks have null in h1."""
    names = _names(extra)

    def occurrences(batches):
        held, n = [], 0
        for batch in batches:
            for got in find(batch):
                held.append(got)
                n += len(got[0])
                if n >= HELD:
                    yield from _settle(held, extra)
                    held, n = [], 0
        if held:
            yield from _settle(held, extra)

    def later(batches):
        """Rows sorted by hash and place: all but the first of a hash are marked."""
        last = None
        for batch in batches:
            ready = batch.column(len(names) - 1).is_valid()
            done = batch.filter(ready)
            if done.num_rows:
                yield done if firsts else done.select(names[2:5] + ["runs"]).rename_columns([*KEY, "runs"])
            h1, h2, *row = cols = [c.to_numpy() for c in batch.filter(pc.invert(ready)).columns[:-1]]
            if not len(h1):
                continue
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            if last is not None and (h1[0], h2[0]) == last[:2]:
                new[0] = False
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first = [np.where(head >= 0, x[head], before) for x, before in zip(row[:3], last[2:] if last else (0, 0, 0))]
            late = np.any([x != y for x, y in zip(row[:3], first)], 0)
            last = (h1[-1], h2[-1], *(x[-1] for x in first))
            if late.any():
                r = runs_of(*(x[late] for x in row[:3]), row[3][late] if extra else None)
                none = pa.nulls(r.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *r.columns[:3], *[none] * len(extra), r.columns[3]], names=names) if firsts else r
            if firsts and new.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in cols), pa.nulls(int(new.sum()), pa.binary())], names=names)

    made = ", ".join(f"{c} long" for c in names[:-1]) + ", runs binary"
    occ = rows.mapInArrow(tidy(occurrences), made)
    # Single things are dealt by their hash, what is settled already by its document.
    dealt = occ.repartition(F.when(F.col("runs").isNull(), F.col("h1")).otherwise(F.xxhash64("doc", "text_key"))).sortWithinPartitions(*names[:5])
    return dealt.mapInArrow(tidy(later), made if firsts else MARKS)
