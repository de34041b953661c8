"""Token ids in binary shards: independent zstandard frames with a trailing seek table.

A shard holds one frame for each document, in order; a skippable frame with the documents' ids and
the width of a token; and last the seek table of the public seekable format, in a skippable frame:
for each frame its compressed size, its size and the low 32 bits of the XXH64 of its content. So a
reader finds a document's frame by adding up sizes and decompresses that frame alone, and a decoder
that knows only plain zstandard still reads every id of the file.

Documents are range-partitioned by doc_id and a hash of their text, so an id that repeats, null among
them, need not fall to one task, and Spark's text writer puts each partition into a file of its own
through its commit protocol, to whatever store the path names. The writer ends each row with the line
separator; the four magic bytes that end a seek table serve as that. A task that has more than
FILE_BYTES of frames ends a shard and begins another behind it in the same file.

Defined results: a null text counts as empty and holds the end id alone; a null doc_id comes last;
rows that repeat a doc_id are written each, in the order of a hash of their texts; an empty table
gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import PieceEncoder
from .shared import LAST_ID, input_bytes, new_path, order_id, small_batches, written
from .textbytes import tidy

# Fixed values of the seekable format.
SEEK_FRAME, INDEX_FRAME, MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, b"\xb1\xea\x92\x8f", 0x80
#: A shard is made of about so many bytes of Spark's estimate of its input.
SHARD_BYTES = 12_000_000
#: Pieces that a worker remembers, some 300 MB with the words that they consist of.
REMEMBERED = 1_000_000
#: A shard ends at so many bytes of frames.
FILE_BYTES = 64_000_000


@lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, False, "<u2", REMEMBERED)


class ShardWriter:
    """Collects documents; close() gives the shard but for the last four bytes."""

    def __init__(self, width: int = 2):
        self.pack, self.width = zstandard.ZstdCompressor(level=3), width
        self.frames, self.table, self.ids, self.bytes = [], [], [], 0

    def add(self, doc: int, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.frames.append(frame)
        self.bytes += len(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc)

    def close(self) -> bytes:
        index = struct.pack("<I", self.width) + np.array(self.ids, "<i8").tobytes()
        extra = struct.pack("<II", INDEX_FRAME, len(index)) + index
        # The seek table covers all frames before it, the index as one of size 0.
        table = b"".join(self.table) + struct.pack("<III", len(extra), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        n = len(self.table) + 1
        seek = struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IB", n, CHECKSUMS)
        return b"".join(self.frames) + extra + seek


class ShardReader:
    """Random access to the documents of a shard: reads the tables at its end, then the frames asked for and nothing else.

    read(at, size) gives bytes of a file, and end is where the shard ends in it; shards may follow each other."""

    def __init__(self, read: Callable[[int, int], bytes], end: int):
        tail = read(end - 9, 9)
        if tail[-4:] != MAGIC:
            raise ValueError("no seek table at the end of the shard")
        n, flags = struct.unpack("<IB", tail[:5])
        if flags != CHECKSUMS:
            raise ValueError("frames without checksums")
        head = read(end - 17 - 12 * n, 8 + 12 * n)
        kind, size = struct.unpack("<II", head[:8])
        if kind != SEEK_FRAME or size != 12 * n + 9:
            raise ValueError("damaged seek table")
        table = np.frombuffer(head[8:], "<u4").reshape(n, 3)
        packed = table[:, 0].astype(np.int64)
        self.begin = end - 17 - 12 * n - int(packed.sum())
        self.read, self.sizes, self.sums = read, table[:-1, 1].astype(np.int64), table[:-1, 2]
        self.at = self.begin + np.r_[0, np.cumsum(packed)]
        index = read(int(self.at[-2]) + 8, int(packed[-1]) - 8)
        self.width = struct.unpack("<I", index[:4])[0]
        self.docs = np.frombuffer(index[4:], "<i8")
        self.starts = np.r_[0, np.cumsum(self.sizes // self.width)]
        self._un = zstandard.ZstdDecompressor()

    @classmethod
    def all_of(cls, read: Callable[[int, int], bytes], end: int) -> list[ShardReader]:
        """The shards of a file of ``end`` bytes, in order."""
        out: list[ShardReader] = []
        while end > 0:
            out.append(cls(read, end))
            end = out[-1].begin
        return out[::-1]

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, checked against its checksum."""
        raw = self._un.decompress(self.read(int(self.at[i]), int(self.at[i + 1] - self.at[i])), max_output_size=int(self.sizes[i]) or 1)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"checksum of document {self.docs[i]}")
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, doc: int) -> np.ndarray | None:
        """Ids of the first document of this id, or None; the ids of a shard ascend."""
        i = int(np.searchsorted(self.docs, doc))
        return self.tokens(i) if i < len(self.docs) and self.docs[i] == doc else None


def bytes_reader(content: bytes) -> Callable[[int, int], bytes]:
    return lambda at, size: content[at : at + size]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encodes every text, appends end_id, and writes the shards under path in ascending doc_id order."""
    small_batches(docs.sparkSession)
    if shards is None:
        size = input_bytes(docs)
        size = size if size < 2**50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    end = np.array([end_id], "<u2").tobytes()

    def shard(batches) -> Iterator[pa.RecordBatch]:
        e, out = _encoder(tokenizer), ShardWriter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(ids), 500):
                for doc, raw in zip(ids[a : a + 500], e.encode(texts[a : a + 500])):
                    out.add(doc, raw + end)
                if out.bytes > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], names=["shard"])
                    out = ShardWriter()
        if out.ids:
            yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], names=["shard"])

    ordered = docs.select(order_id().alias("doc"), "text").withColumn("th", F.xxhash64("text")).repartitionByRange(shards, "doc", "th").sortWithinPartitions("doc", "th").select("doc", "text")
    made = ordered.mapInArrow(tidy(shard), "shard binary").select(F.col("shard").cast("string").alias("value"))
    made.write.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards under path."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")

    def documents(batches):
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content, local = content.as_py(), 0
                for r in ShardReader.all_of(bytes_reader(content), len(content)):
                    crc = [zlib.crc32(r.tokens(i).astype("<u4").tobytes()) for i in range(len(r.docs))]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(crc), pa.int32()), pa.array(r.docs), pa.array(local + r.starts[:-1]), pa.array(np.diff(r.starts)), pa.array(crc, pa.int64())], names=["shard", "doc", "local", "n_tokens", "ids_crc32"])
                    local += int(r.starts[-1])

    # The files are read once; what is kept of them has a row of five numbers for each document.
    rows = written(files.mapInArrow(tidy(documents), "shard int, doc long, local long, n_tokens long, ids_crc32 long"), "tokens-read")
    # One row a file, so this window is over few rows whatever the number of documents.
    before = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).withColumn("before", F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    doc = F.when(F.col("doc") != LAST_ID, F.col("doc"))
    return rows.join(before, "shard").select(doc.alias("doc_id"), (F.col("local") + F.coalesce("before", F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new folder under the shared one and reads it back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(spark, path)
