"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text into chunks, so equal passages give equal
chunks wherever they stand. Merged partition sketches (:mod:`.sketch`) tell which chunks may occur
more than once. A text without such a chunk is encoded where it is. Of the others, own chunks are
encoded in place, shared ones meet by digest and are encoded once in all, and their ids are joined
back; so only texts that share something are shuffled, and a shared chunk's text once a task.

At each seam between chunks the ids are repaired: the text from some cut points left of the seam to
some right of it is encoded anew, and is accepted when its ids agree with the chunks' own ids over
the outermost piece on either side, from where the chunks' ids go on unchanged. Else more is
encoded, at last the whole.

Defined results: a null text counts as empty and has no ids; rows that repeat a doc_id are encoded
each for themselves; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .encoding import PieceEncoder, byte_level_vocabulary
from .shared import input_bytes, small_batches, written
from .textbytes import mix, slices, tidy

#: A cut falls after about every 2**CHUNK_BITS bytes, at LEAST bytes or more from the last, and not inside a character.
CHUNK_BITS, LEAST = 10, 256

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, base: np.ndarray) -> list[list[int]]:
    """Per document the ends of its chunks, from the start of the slice."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        step = h.copy()
        step[span:] += h[:-span] << np.uint32(span)
        h = step
    inner = np.empty(len(data), bool)
    inner[-1:], inner[:-1] = False, (data[1:] & 0xC0) != 0x80
    found = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS) == 0) & inner) + 1
    edge = np.searchsorted(found, base)
    out = []
    for i in range(len(base) - 1):
        last, end, ends = int(base[i]), int(base[i + 1]), []
        for p in found[edge[i] : edge[i + 1]].tolist():
            if p - last >= LEAST and p < end:
                ends.append(p)
                last = p
        if end > last:
            ends.append(end)
        out.append(ends)
    return out


def _digest_halves(chunk) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(chunk)
    return d >> 64, d & (2**64 - 1)


def _chunks(texts):
    """Per slice: first row, bytes, base, chunk ends, and high and low digests in one array each."""
    for a, _, data, base in slices(texts):
        if not len(data):
            yield a, data, base, [[]] * (len(base) - 1), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            continue
        ends = cut_points(data, base)
        view, hi, lo = memoryview(data), [], []
        for i, e in enumerate(ends):
            at = int(base[i])
            for p in e:
                x, y = _digest_halves(view[at:p])
                hi.append(x)
                lo.append(y)
                at = p
        yield a, data, base, ends, np.array(hi, np.uint64), np.array(lo, np.uint64)


@lru_cache(2)
def encoder(path: str) -> tuple[PieceEncoder, list[bytes]]:
    e = PieceEncoder(path, True, "<u4")
    return e, byte_level_vocabulary(e.tokenizer)


#: Bytes that may follow a space at a cut point: no white space, nor the first byte of one.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xF5] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False


class _Chunk:
    def __init__(self, ids: np.ndarray, vocabulary: list[bytes]):
        self.ids = ids
        parts = [vocabulary[i] for i in ids.tolist()]
        self.text = b"".join(parts)
        self.at = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        b = np.frombuffer(self.text, np.uint8)
        self.cuts = np.flatnonzero((b[:-1] == 0x20) & _AFTER[b[1:]]) if len(b) > 1 else np.zeros(0, np.int64)

    def token(self, byte: int) -> int:
        """Index of the token that starts at byte, -1 if none does."""
        i = int(np.searchsorted(self.at, byte))
        return i if self.at[i] == byte else -1


def stitch(chunks: list[np.ndarray], e: PieceEncoder, vocabulary: list[bytes]) -> np.ndarray:
    """Ids of the whole text from the ids of its chunks."""
    if not chunks:
        return np.zeros(0, np.uint32)
    done: list[np.ndarray] = []
    left = _Chunk(chunks[0], vocabulary)
    for ids in chunks[1:]:
        right = _Chunk(ids, vocabulary)
        reach = 2
        while True:
            whole_left, whole_right = len(left.cuts) < reach, len(right.cuts) < reach
            la = 0 if whole_left else int(left.cuts[-reach])
            rb = len(right.text) if whole_right else int(right.cuts[reach - 1])
            new = np.array(e.ids((left.text[la:] + right.text[:rb]).decode()), np.uint32)
            ok, i, j = True, 0, len(right.ids)
            if not whole_left:
                i, k = left.token(la), left.token(int(left.cuts[-reach + 1]))
                ok = i >= 0 and k >= 0 and np.array_equal(new[: k - i], left.ids[i:k])
            if ok and not whole_right:
                k, j = right.token(int(right.cuts[reach - 2])), right.token(rb)
                ok = k >= 0 and j >= 0 and j - k <= len(new) and np.array_equal(new[len(new) - (j - k) :], right.ids[k:j])
            if ok or (whole_left and whole_right):
                break
            reach *= 2
        if whole_right:  # what is left of this seam may still change at the next
            left = _Chunk(np.concatenate([left.ids[:i], new]) if not whole_left else new, vocabulary)
        else:
            done.append(left.ids[:i] if not whole_left else left.ids[:0])
            done.append(new)
            left = _Chunk(right.ids[j:], vocabulary)
            if not len(left.cuts) or len(left.cuts) < 2:  # too short to end a window in: keep it with what precedes
                left = _Chunk(np.concatenate([done.pop(), left.ids]), vocabulary)
    done.append(left.ids)
    return np.concatenate(done).astype(np.uint32)


def _digests(raw_ids: bytes, vocabulary: list[bytes]) -> tuple[int, str, str]:
    text = b"".join([vocabulary[i] for i in np.frombuffer(raw_ids, "<u4").tolist()]).decode("utf-8", "replace")
    return len(raw_ids) // 4, hashlib.sha256(raw_ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_OUT = "key long, doc_ids array<long>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.nulls(0, k) for k in kinds], names=["key", "doc_ids", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs; path names the vocabulary file."""
    return _run(docs, path, with_ids=False)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`encode_decode` with ``ids`` too, little-endian unsigned 32-bit integers in a binary."""
    return _run(docs, path, with_ids=True)


def _run(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    bits = sketch.bits_for(input_bytes(docs))

    def hashes(batch):
        for *_, hi, _ in _chunks(pc.fill_null(batch.column(0), "").dictionary_encode().dictionary):
            yield mix(hi)

    bitmap = sketch.repeated_cells(docs.select("text"), hashes, bits)

    def local(batches):
        """A row for each finished text, and for the others a row for each chunk, with its ids or its text."""
        e, vocabulary = encoder(path)
        seen = bitmap.value
        for batch in batches:
            # Equal texts of a batch, such as the copies that a mix makes, are one text with several documents.
            coded_texts = pc.fill_null(batch.column(2), "").dictionary_encode()
            which = coded_texts.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(coded_texts.dictionary) + 1))
            all_ids = batch.column(1).take(pa.array(order)).to_pylist()
            ids = [all_ids[i:j] for i, j in zip(first[:-1], first[1:])]
            keys = batch.column(0).to_numpy()[order[first[:-1]]].tolist()
            for a, data, base, ends, hi, lo in _chunks(coded_texts.dictionary):
                shared = sketch.is_repeated(seen, mix(hi), bits)
                at, jobs, view = 0, [], memoryview(data)
                for i, e_i in enumerate(ends):
                    mine = shared[at : at + len(e_i)]
                    lo_i, hi_i = int(base[i]), int(base[i + 1])
                    if not mine.any():
                        jobs.append((i, -1, 0, 0, str(view[lo_i:hi_i], "utf-8"), False))
                    else:
                        for pos, p in enumerate(e_i):
                            jobs.append((i, pos, int(hi[at + pos].view(np.int64)), int(lo[at + pos].view(np.int64)), str(view[lo_i:p], "utf-8"), bool(mine[pos])))
                            lo_i = p
                    at += len(e_i)
                coded = iter(e.encode([j[4] for j in jobs if not j[5]]))
                rows = []
                for i, pos, d1, d2, text, later in jobs:
                    raw = None if later else next(coded)
                    head = (keys[a + i], ids[a + i] if pos <= 0 else None)
                    if pos < 0:
                        rows.append((*head, -1, None, None, *_digests(raw, vocabulary), raw if with_ids else None, None))
                    else:
                        rows.append((*head, pos, d1 if later else None, d2 if later else None, None, None, None, raw, text if later else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _LOCAL)], names=_LOCAL_NAMES)

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(keyed.mapInArrow(tidy(local), "key long, doc_ids array<long>, pos int, d1 long, d2 long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, text string"), "bpe-chunks")

    bitmap.unpersist()

    def encode_shared(batches):
        e, _ = encoder(path)
        for batch in batches:
            coded = e.encode(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], names=["d1", "d2", "coded"])

    shared = rows.where("text is not null").groupBy("d1", "d2").agg(F.first("text").alias("text")).mapInArrow(tidy(encode_shared), "d1 long, d2 long, coded binary")
    waiting = rows.where("pos >= 0").select("key", "doc_ids", "pos", "d1", "d2", "ids")
    mine = waiting.where("d1 is null").select("key", "doc_ids", "pos", "ids")
    theirs = waiting.where("d1 is not null").join(shared, ["d1", "d2"]).select("key", "doc_ids", "pos", F.col("coded").alias("ids"))
    whole = mine.unionByName(theirs).groupBy("key").agg(F.first("doc_ids", True).alias("doc_ids"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x.getField("ids")).alias("parts"))

    def assemble(batches):
        e, vocabulary = encoder(path)
        for batch in batches:
            rows, raws = [], []
            for key, doc, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = stitch([np.frombuffer(p, "<u4") for p in parts], e, vocabulary).astype("<u4").tobytes()
                rows.append((key, doc, *_digests(raw, vocabulary)))
                raws.append(raw if with_ids else None)
            out = _finished(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(raws, pa.binary())], names=[*out.schema.names, "ids"])

    done = whole.mapInArrow(tidy(assemble), _OUT + ", ids binary")
    columns = [F.explode("doc_ids").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256"]
    every = rows.where("pos < 0").select(*columns, "ids").unionByName(done.select(*columns, "ids"))
    return every if with_ids else every.drop("ids")


_LOCAL = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
_LOCAL_NAMES = ["key", "doc_ids", "pos", "d1", "d2", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "text"]
