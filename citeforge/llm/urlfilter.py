"""URL filters: exact membership of rule keys by a cascade of Bloom filters, without joins.

A rule is a host, a path prefix and a verdict. The keys of a URL are all pairs of one of its host's
suffixes and one of its path's prefixes of a length that some rule has; the corpus's key universe is
all keys of all its URLs. For a verdict, level 1 of its cascade encodes the listed keys; level 2 the
keys of the universe that level 1 takes for listed but are not; level 3 the listed keys that level 2
holds as well, and so on until nothing is mistaken. A key of the universe belongs to the list if the
first level that lacks it has an even number. Level 1 has a false positive rate of about the share
of listed keys, so every level is of the order of the list, whatever the size of the universe.

The universe is written once and both cascades read it. Only suffixes of as many labels as some rule's
host has are keys, so a host of thousands of labels has no more keys than another. The rules are
given on the driver, and a level has at most MAX_LEVEL_BITS bits; more rules are refused.

Defined results: a null URL or one without ``://`` has an empty host and path and no key, so no rule;
URLs without a rule are allowed, which is what the cascades say of keys that they lack.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

HASHES = 6
#: Bits of one level at most; a list that needs more is refused rather than broadcast.
MAX_LEVEL_BITS = 2**28
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(rules: tuple[Rule, ...]) -> Column:
    """The keys of host and path, longest first: for each shape of a rule (labels of its host, length of its path) one at most."""
    parts = []
    for labels, n in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        suffix = f"substring_index(host, '.', -{labels})"
        fits = f"length(host) - length(replace(host, '.', '')) >= {labels - 1} and length(path) >= {n} and (host <> '' or path <> '')"
        parts.append(f"if({fits}, named_struct('n', -length({suffix}) - {n}, 'key', concat({suffix}, substr(path, 1, {n}))), null)")
    return F.expr(f"transform(array_sort(array_distinct(array_compact(array({', '.join(parts)})))), x -> x.key)")


def _places(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Cells of each hash in a level, HASHES for each."""
    x = (h.astype(np.int64).view(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (x[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


@dataclass
class Cascade:
    levels: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def in_level(self, h: np.ndarray, i: int) -> np.ndarray:
        bits, packed = self.levels[i]
        at = _places(h, i + 1, bits)
        return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe that the cascade was built over."""
        first = np.full(len(h), len(self.levels))
        open_ = np.ones(len(h), bool)
        for i in range(len(self.levels)):
            hit = np.zeros(len(h), bool)
            hit[open_] = self.in_level(h[open_], i)
            first[open_ & ~hit] = i
            open_ &= hit
        return first % 2 == 1


def _level(keys: DataFrame, n: int, rate: float, number: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of n hashes in column h, its cells collected as packed bytes of a checked size."""
    # Bits for the wanted rate with a fixed number of hash functions.
    share = min(0.5, rate ** (1 / HASHES))
    bits = max(64, math.ceil(-HASHES * n / math.log(1 - share)))
    if bits > MAX_LEVEL_BITS:
        raise ValueError(f"a level of {bits} bits is too large to broadcast")

    def cells(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), number, bits))
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(bit.astype(np.int32))], names=["byte", "bit"])

    def pack(batches):
        for batch in batches:
            at, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([bit.astype(np.uint8).tobytes()], pa.binary())], names=["at", "bit"])

    out = np.zeros(-(-bits // 8), np.uint8)
    merged = keys.mapInArrow(cells, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    for r in merged.mapInArrow(pack, "at binary, bit binary").collect():  # 9 bytes for each byte of the level at most
        out[np.frombuffer(r.at, np.int64)] = np.frombuffer(r.bit, np.uint8)
    return bits, out


def build(universe: DataFrame, listed: list[str], n_universe: int) -> Cascade:
    """Cascade for the listed keys over universe, distinct hashes ``h`` of keys."""
    spark = universe.sparkSession
    own = spark.createDataFrame([(k,) for k in listed], "key string").select(F.xxhash64("key").alias("h")).distinct()
    sides = [own, universe.join(F.broadcast(own) if len(listed) <= 1_000_000 else own, "h", "left_anti")]
    cascade, rate = Cascade(), min(0.5, max(len(listed) / max(1, n_universe), 1e-9) / math.sqrt(2))
    n = len(listed)
    while n:
        i = len(cascade.levels)
        if i == MAX_LEVELS:
            raise ValueError("the cascade does not settle: two keys share a 64-bit hash")
        cascade.levels.append(_level(sides[i % 2], n, rate if i == 0 else 0.5, i + 1))
        # The other side's keys that this level takes for its own are the next level's.
        held, number = cascade, i

        def mistaken(batches, held=held, number=number):
            for batch in batches:
                h = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h[held.in_level(h, number)])], names=["h"])

        sides[(i + 1) % 2] = sides[(i + 1) % 2].mapInArrow(mistaken, "h long")
        n = sides[(i + 1) % 2].count()
    return cascade


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and ``verdict`` added (replacing columns of these names)."""
    spark = pages.sparkSession
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keyed = split.withColumn("rule", _keys(rules))
    hashes = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).select(F.explode(_keys(rules)).alias("key")).select(F.xxhash64("key").alias("h"))
    universe = written(hashes.distinct(), "url-universe")
    n = universe.count()
    verdicts = {v: build(universe, sorted({r.key for r in rules if r.verdict == v}), n) for v in ("block", "allow")}
    cascades = spark.sparkContext.broadcast(verdicts)

    @F.pandas_udf("rule string, verdict string")
    def look_up(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        size = np.array([len(x) for x in keys], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if size.sum() else np.zeros(0, np.int64)
        block, allow = (cascades.value[v].contains(flat) for v in ("block", "allow"))
        rule: list[str | None] = [None] * len(size)
        verdict = ["allow"] * len(size)
        row = np.repeat(np.arange(len(size)), size)
        start = np.r_[0, np.cumsum(size)]
        hit = np.flatnonzero(block | allow)
        for at in hit[::-1].tolist():  # keys are longest first, so the first hit of a row stays
            i = int(row[at])
            rule[i], verdict[i] = keys.iloc[i][at - start[i]], "block" if block[at] else "allow"
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    got = keyed.withColumn("verdict", look_up("rule", F.transform("rule", lambda k: F.xxhash64(k))))
    return got.withColumns({"rule": F.col("verdict.rule"), "verdict": F.col("verdict.verdict")})
