"""Suffix-array dedup of bytes: remove what a 100-byte string covers that also starts earlier.

Method: prefix-free parsing, with the order taken to the depth that is asked, ``window`` bytes.

1. Rolling-hash triggers. Each string of ``window`` bytes has a trigger, the leftmost least hash among
   its grams of ``gram`` bytes, which depends on the string alone. Strings of one trigger follow each
   other, and what they span together is a phrase. So phrases overlap by ``window`` - 1 bytes, every
   string lies in just one of them, and the order of suffixes to this depth is settled within phrases.
2. Dictionary and parse. A phrase whose gram occurs nowhere else has no repeated string and leaves at
   once (by a sketch that overestimates counts, :mod:`.sketch`). The occurrences of the others are
   sorted by phrase and place, the suffix array of the parse: the first of each phrase goes to the
   dictionary, all strings of the later ones are marked. Text that repeats is not looked at again.
3. The suffixes of dictionary phrases that share their gram with another phrase, cut to ``window``
   bytes, are sorted by name and place: the dictionary's suffix array. Of equal neighbours the
   first place is the corpus's first one, the others are marked.
4. Marked starts, as runs, are joined to the texts, and covered bytes removed.

Suffixes are named by 128 bits of hash in place of their bytes, so equal ones meet, in an order of
names and not of the alphabet. Long texts pass in pieces; a phrase cut in two at the end of one is
two phrases, which changes no result.

Defined results: a null text is empty; texts below ``window`` bytes keep all; a null doc_id counts as the
largest; rows that repeat doc_id and text get the same marks, neither being earlier than the other; rows
that share a doc_id, or have none, with different texts stand in the order of a hash of their texts; other
columns are passed through, those named like the result's replaced; an empty table gives an empty table.
What is kept may cut a character in two, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs, sketch
from .shared import input_bytes, measured, small_batches, written
from .textbytes import eights, join_hash, mix, slices, sliding_min, spans_hash, tidy

WINDOW, GRAM = 100, 40
#: A task looks at so many starts of a text at once.
PIECE = 400_000
DEPTH = 2
#: Tables of runs are broadcast to the texts if they take no more bytes than this, else both are shuffled.
BROADCAST_BYTES = 32_000_000
MADE = ("n_bytes", "n_removed", "n_spans", "kept")


def _pieces(texts, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, start of the piece in its text, bytes, offsets of rows)."""
    for a, _, data, base in slices(texts):
        if len(base) == 2 and len(data) > PIECE + window:
            for lo in range(0, len(data) - window + 1, PIECE):
                part = data[lo : lo + PIECE + window - 1]
                yield a, lo, part, np.array([0, len(part)])
        else:
            yield a, 0, data, base


def phrases(texts, window: int, gram: int):
    """Per piece: first row, start of the piece, rows' offsets, its bytes as eights, and of each phrase gram, row, first start and number of starts."""
    for a, lo, data, base in _pieces(texts, window):
        n = len(data) - window + 1
        if n <= 0:
            continue
        view = eights(data).copy()
        grams = len(data) - gram + 1
        g = mix(view[:grams])
        for at in range(8, gram, 8):
            g = join_hash(g, view[at : at + grams], 0)
        g = mix(g)
        key = (g >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        trigger = sliding_min(key, window - gram + 1) & np.uint64(0xFFFFFFFF)
        row = np.repeat(np.arange(len(base) - 1), np.diff(base))[:n]
        start = np.flatnonzero(np.arange(n) + window <= base[row + 1])
        if not len(start):
            continue
        t = trigger[start]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        yield a, lo, base, view, g[t[head].astype(np.int64)], row[start[head]], start[head], np.diff(np.r_[head, len(start)])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary) added."""
    if gram % 8 or not 8 <= gram <= window:
        raise ValueError("gram has to be a multiple of 8 within window")
    spark = docs.sparkSession
    small_batches(spark)
    bits = sketch.bits_for(input_bytes(docs))
    keyed = docs.select(*runs.row_key(), "text")

    def grams(batch):
        for *_, g, _, _, _ in phrases(batch.column(0), window, gram):
            yield g

    bitmap = sketch.repeated_cells(docs.select("text"), grams, bits, DEPTH)

    def parse(batch):
        """Occurrences of phrases whose gram is estimated repeated, named by their first and last string and length."""
        ids, keys, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for a, lo, base, view, g, row, start, many in phrases(batch.column(3), window, gram):
            hit = np.flatnonzero(sketch.is_repeated(bitmap.value, g, bits, DEPTH))
            if not len(hit):
                continue
            g, row, start, many = g[hit], row[hit], start[hit], many[hit]
            length = np.full(len(hit), window)
            name = []
            for which in (0, 1):
                both = join_hash(spans_hash(view, start, length, which), spans_hash(view, start + many - 1, length, which), which)
                name.append(mix(join_hash(both, many.astype(np.uint64), which)))
            at = start - base[row] + lo
            row = row + a
            yield [*name, ids[row], keys[row], tags[row] << 32 | at, many.astype(np.int64), g.view(np.int64)]

    parsed = written(runs.first_ones(keyed, parse, ["many", "gram"], firsts=True), "suffix-parse")
    bitmap.unpersist()
    settled = parsed.where("runs is not null").select("doc", "text_key", F.col("pos").alias("tag"), "runs")
    dictionary = parsed.where("runs is null")
    shared = dictionary.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")

    def as_runs(batches):
        for batch in batches:
            if batch.num_rows:
                yield runs.runs_of(*(c.to_numpy() for c in batch.columns))

    open_, size = measured(runs.merged(dictionary.join(shared, "gram", "left_semi").select(*runs.PLACE, "many").mapInArrow(tidy(as_runs), runs.MARKS)), "suffix-dictionary", "runs")
    texts = keyed.join(F.broadcast(open_) if size <= BROADCAST_BYTES else open_, runs.KEY)

    def suffixes(batch):
        """The dictionary's suffixes cut to the window, named by 128 bits."""
        ids, keys, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        blobs = batch.column(4).to_pylist()
        for a, b, data, base in slices(batch.column(3)):
            pair = np.frombuffer(b"".join(blobs[a:b]), "<i4").reshape(-1, 2).astype(np.int64)
            owner = np.repeat(np.arange(a, b), [len(x) // 8 for x in blobs[a:b]])
            view = eights(data)
            # Runs of a long text may be many: so many starts at once.
            cut = np.searchsorted(np.cumsum(pair[:, 1]), np.arange(PIECE, pair[:, 1].sum() + PIECE, PIECE))
            for i, j in zip(np.r_[0, cut[:-1] + 1], cut + 1):
                p, o = pair[i:j], owner[i:j]
                if not len(p):
                    continue
                ramp = np.arange(p[:, 1].sum()) - np.repeat(np.cumsum(p[:, 1]) - p[:, 1], p[:, 1])
                at, row = np.repeat(p[:, 0], p[:, 1]) + ramp, np.repeat(o, p[:, 1])
                start, length = at + base[row - a], np.full(len(at), window)
                yield [spans_hash(view, start, length, 0), spans_hash(view, start, length, 1), ids[row], keys[row], tags[row] << 32 | at]

    found = runs.first_ones(texts.select(*runs.KEY, "text", "runs"), suffixes)
    marks, size = measured(runs.merged(settled.unionByName(found)), "suffix-marks", "runs")

    def cut(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                n.append(len(raw))
                count = removed = 0
                if marked:
                    off = runs.covered(marked, len(raw), window)
                    removed, count = int(off.sum()), int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~off].tobytes()
                gone.append(removed)
                spans.append(count)
                kept.append(raw)
            made = [pa.array(x, pa.int64()) for x in (n, gone, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *made, pa.array(kept, pa.binary())], names=["own", "text", *MADE])

    # Own columns go in a struct, so that no name of the table can clash with ours.
    packed = docs.select(*runs.row_key(), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"))
    joined = packed.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, runs.KEY, "left").select("text", "runs", "own")
    made = [T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in MADE[:3]), T.StructField("kept", T.BinaryType())]
    out = joined.mapInArrow(tidy(cut), T.StructType([joined.schema["own"], *made]))
    return out.select(*[F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c not in MADE], *MADE)
