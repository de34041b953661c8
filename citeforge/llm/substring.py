"""Substring dedup: remove words covered by a window of words that also starts earlier.

Method: count-min prefilter. Any window of ``window`` words contains ``ANCHOR`` + 1 or more grams of
``window - ANCHOR`` words; the smallest of them by hash, its anchor, depends on the window's words
alone. So a window that occurs twice has an anchor that occurs at two places, and the merged
partition sketches of anchors (:mod:`.sketch`) overestimate the count of every window. A sketch of
the windows whose anchor is estimated repeated does so more closely. The last pass takes only
windows that this second sketch estimates repeated, groups them exactly by 128 bits of hash, and
marks all but the first. No repeated window is lost.

A task first settles the windows it holds itself (:mod:`.runs`), so a window that occurs in a third of
all rows is shuffled once a task.

Defined results: null and empty texts have no words and keep none; a null doc_id counts as the
largest; rows that repeat doc_id and text get the same marks, neither being earlier than the
other; rows that share a doc_id (or have none) with different texts stand in the order of a hash of
their texts and are told apart by 95 bits of it; other columns are passed through; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs, sketch
from .shared import input_bytes, measured, small_batches
from .textbytes import ngrams, slices, sliding_min, split_words, tidy

ANCHOR = 9
#: Hash functions of the sketches.
DEPTH = 2
#: Marks are broadcast to the texts if they take no more bytes than this, else both are shuffled.
BROADCAST_BYTES = 32_000_000


def _windows(texts, window: int):
    """Per slice: first row, words, and the start word of each window."""
    for a, _, data, base in slices(texts):
        w = split_words(data, base)
        n = len(w.doc) - window + 1
        if n > 0 and len(at := np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])):
            yield a, w, at


def _anchors(w, at: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and which of them is the anchor of each window; h: hashes of the words."""
    gram = max(1, window - ANCHOR)
    g = ngrams(h, gram)
    key = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    return g, (sliding_min(key, window - gram + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) added."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = sketch.bits_for(input_bytes(docs))

    def anchors(batch):
        for _, w, at in _windows(batch.column(0), window):
            g, best = _anchors(w, at, w.hashes(), window)
            yield g[np.unique(best)]

    bitmap = sketch.repeated_cells(docs.select("text"), anchors, bits, DEPTH)

    def likely(batch):
        """Hashes of the windows whose anchor is estimated repeated."""
        for _, w, at in _windows(batch.column(0), window):
            h = w.hashes()
            g, best = _anchors(w, at, h, window)
            at = at[sketch.is_repeated(bitmap.value, g, bits, DEPTH)[best]]
            if len(at):
                yield ngrams(h, window)[at]

    second = sketch.repeated_cells(docs.select("text"), likely, bits, DEPTH)
    bitmap.unpersist()

    def occurrences(batch):
        seen = second.value
        ids, keys, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for a, w, at in _windows(batch.column(3), window):
            h = ngrams(w.hashes(), window)[at]
            hit = sketch.is_repeated(seen, h, bits, DEPTH)
            at, h = at[hit], h[hit]
            if len(at):
                row = w.doc[at] + a
                yield [h, ngrams(w.hashes(1), window, 1)[at], ids[row], keys[row], tags[row] << 32 | (at - w.first[w.doc[at]])]

    marks, size = measured(runs.merged(runs.first_ones(docs.select(*runs.row_key(), "text"), occurrences)), "substring-marks", "runs")

    second.unpersist()

    def cut(batches):
        for batch in batches:
            kept, n, gone = [], [], []
            for text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                n.append(len(words))
                if marked:
                    words = [words[i] for i in np.flatnonzero(~runs.covered(marked, len(words), window))]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            rest = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([*rest, batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[2:], "text", "n_words", "n_removed", "kept_text"])

    # Own columns go in a struct, so that no name of the table can clash with ours.
    packed = docs.select(*runs.row_key(), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"))
    joined = packed.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, runs.KEY, "left").select("text", "runs", "own")
    made = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    out = joined.mapInArrow(tidy(cut), T.StructType([joined.schema["own"], *made]))
    back = [F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    return out.select(*back, "n_words", "n_removed", "kept_text")
