"""Merkle manifest of a dataset: a tree over each group's rows, one over the groups, and proofs down to rows.

Method: Pregel-style supersteps over RDDs of small records; texts stay in the table that leaves are
hashed from. Leaves are numbered in their order from range partitions, of each of which only
its edges reach the driver. Going up, children message (place, digest) to their parent, which is
complete when it holds ``fanout`` places or all up to the group's last one; it hashes them and forwards. A node
that is first and last of its group is the group's subroot, and the subroots climb in the same way to the
root. In reverse supersteps every parent sends each child the path so far with the child's siblings in
front; near the leaves a run of up to ``fanout`` rows gets one message, and folds and digests its rows' paths there.

A key stands for one run, so no message list is longer than ``fanout`` however many rows a group has. Every
superstep's records are a written table, from which lost tasks are done again.

Defined results: null in a hashed column is ``-``; a null group is the first one; a null id comes last in its
group and is never tampered with; rows that repeat an id stand in the order of their leaves, equal ones in any order, which gives
the same digests; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows a range partition holds about; records of a leaf take some 200 bytes.
ROWS = 400_000

_ROWS = "id long, leaf string, altered string, tree long, place long, last boolean"
_RUNS = "level int, tree long, parent long, children binary, digest binary, last boolean"


def digest_of(*columns: Column) -> Column:
    """H of the columns: sha256 over ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, grp, leaf, altered): altered is the leaf after text is lower-cased (A-Z) where 5 divides the id's crc32, else null."""
    small_batches(docs.sparkSession)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whole = {c: F.col(f"`{c}`") for c in columns}
    other = whole | {text: F.translate(whole[text], upper, upper.lower())}
    hit = F.crc32(whole[key].cast("string")) % 5 == 0
    return docs.select(whole[key].cast("long").alias("id"), F.col(f"`{group}`").cast("string").alias("grp"), digest_of(*whole.values()).alias("leaf"), F.when(hit, digest_of(*other.values())).alias("altered"))


def _hash(*parts: bytes) -> bytes:
    """H of digests, as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def _parts(spark: SparkSession, n: int) -> int:
    return max(1, min(n, max(-(-n // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))))


def numbered(rows: DataFrame) -> DataFrame:
    """Leaves in their order: tree (number of the group), place within it, and whether it is the group's last."""
    spark = rows.sparkSession
    parts = _parts(spark, rows.count())
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("leaf").asc()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "leaf", "altered", "grp").rdd.map(tuple)

    def edge(k, it):
        """Of a partition: first and last group, number of groups, rows of the last group, whether it has rows."""
        first, last, groups, tail = None, None, 0, 0
        for grp, rs in groupby(it, lambda r: r[3]):
            if not groups:
                first = grp
            last, groups, tail = grp, groups + 1, sum(1 for _ in rs)
        yield k, groups, first, last, tail

    # One row a partition. What each starts from: its first group's number and the rows that group has before it.
    start, end_of = {}, {}
    tree, before, open_ = -1, 0, None
    edges = [e for e in sorted(ordered.mapPartitionsWithIndex(edge).collect()) if e[1]]
    for i, (k, groups, first, last, tail) in enumerate(edges):
        same = i > 0 and first == open_
        start[k] = (tree if same else tree + 1, before if same else 0)
        end_of[k] = i + 1 == len(edges) or edges[i + 1][2] != last
        before = before + tail if same and groups == 1 else tail
        tree, open_ = start[k][0] + groups - 1, last

    def number(k, it):
        held, (tree, place) = None, start.get(k, (0, 0))
        for r in it:
            if held is not None:
                same = held[3] == r[3]
                yield (*held[:3], tree, place, not same)
                tree, place = (tree, place + 1) if same else (tree + 1, 0)
            held = r
        if held is not None:
            yield (*held[:3], tree, place, end_of[k])

    return written(spark.createDataFrame(ordered.mapPartitionsWithIndex(number), _ROWS, verifySchema=False), "merkle-leaves")


def _parents(messages: RDD, level: int, parts: int) -> RDD:
    """Runs that have all their children: rows of _RUNS."""

    def complete(got):
        (tree, parent), children = got
        children = sorted(children)
        if [c[0] for c in children] != list(range(len(children))) or not (len(children) == FANOUT or children[-1][2]):
            raise ValueError(f"run {parent} of tree {tree} lacks children on level {level}")
        digests = [c[1] for c in children]
        return level, tree, parent, b"".join(digests), _hash(*digests), children[-1][2]

    return messages.groupByKey(parts).map(complete)


def climb(spark: SparkSession, nodes: RDD, parts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes: (tree, place, digest, last). The runs of each level, and tables (tree, level, digest) of finished trees, by level."""
    levels, tops, level = [], [], 0
    top = "tree long, level int, digest binary"
    while True:
        tops.append(written(spark.createDataFrame(nodes.filter(lambda v: v[1] == 0 and v[3]).map(lambda v, k=level: (v[0], k, v[2])), top, verifySchema=False), "merkle-tops"))
        messages = nodes.filter(lambda v: not (v[1] == 0 and v[3])).map(lambda v: ((v[0], v[1] // FANOUT), (v[1] % FANOUT, v[2], v[3])))
        level += 1
        table = written(spark.createDataFrame(_parents(messages, level, parts), _RUNS, verifySchema=False), "merkle-runs")
        n = table.count()
        if n == 0:
            return levels, tops
        levels.append(table)
        parts = max(1, min(parts, -(-n // 10_000)))
        nodes = table.select("tree", "parent", "digest", "last").rdd.map(lambda r: (r.tree, r.parent, bytes(r.digest), r.last)).coalesce(parts)


def _children(got):
    """The messages of a run to its children: ((tree, place), path), the path a child's steps up to the root."""
    (tree, parent), (paths, runs) = got
    for path in paths:
        for children in runs:
            digests = [children[i : i + 32] for i in range(0, len(children), 32)]
            for i in range(len(digests)):
                yield (tree, parent * FANOUT + i), ((i, b"".join(digests[:i] + digests[i + 1 :])), *path)


def descend(spark: SparkSession, levels: list[DataFrame], starts: list[RDD], parts: int, stop: int = 0) -> RDD:
    """((tree, place), path) of the nodes of level stop, from the paths that trees of each level start with."""
    schema = "tree long, place long, path array<struct<pos: int, siblings: binary>>"
    at = starts[-1]
    for level in range(len(levels), stop, -1):
        runs = levels[level - 1].select("tree", "parent", "children").rdd.map(lambda r: ((r.tree, r.parent), bytes(r.children)))
        down = at.cogroup(runs, numPartitions=max(1, min(parts, runs.getNumPartitions() * FANOUT))).flatMap(_children)
        sent = written(spark.createDataFrame(down.map(lambda m: (*m[0], list(m[1]))), schema, verifySchema=False), "merkle-paths")
        at = sent.rdd.map(lambda r: ((r.tree, r.place), tuple((s.pos, bytes(s.siblings)) for s in r.path))).union(starts[level - 1])
    return at


def fold(leaf: bytes, path) -> bytes:
    """The root that a leaf and its siblings give."""
    for pos, siblings in path:
        leaf = _hash(*(siblings[i : i + 32] for i in range(0, 32 * pos, 32)), leaf, *(siblings[i : i + 32] for i in range(32 * pos, len(siblings), 32)))
    return leaf


def manifest(rows: DataFrame, with_proof: bool = False) -> DataFrame:
    """For each leaf (id, grp, leaf, altered): leaf, subroot, root, the digest of its siblings up to the root, the root
    that the altered leaf (or the leaf) folds to with them, and whether that is the root.

    with_proof adds the steps as binary: of each a byte for the place, one for the number of siblings, and their digests."""
    spark = rows.sparkSession
    table = numbered(written(rows, "merkle-hashed"))
    size = table.agg(F.count("*").alias("n"), F.max("tree").alias("final")).first()
    parts, final = _parts(spark, size.n), size.final
    base = table.select("tree", "place", "leaf", "last").rdd.map(lambda r: (r.tree, r.place, bytes.fromhex(r.leaf), r.last))
    levels, tops = climb(spark, base, parts)
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    high, roots = climb(spark, subroots.rdd.map(lambda r: (-1, r.tree, bytes(r.digest), r.tree == final)), parts)
    got = [bytes(r.digest) for t in roots for r in t.collect()]  # the root
    root = got[0] if got else None

    # Down: first to the subroots, then from each level's finished trees to the runs above the leaves.
    none = spark.sparkContext.emptyRDD()
    begin = [none] * len(roots)
    begin[len(high)] = spark.sparkContext.parallelize([((-1, 0), ())], 1)
    above = descend(spark, high, begin, parts).map(lambda m: (m[0][1], m[1]))
    reached = subroots.rdd.map(lambda r: (r.tree, (r.level, bytes(r.digest)))).join(above, numPartitions=max(1, min(parts, len(tops))))
    starts = [reached.filter(lambda m, k=k: m[1][0][0] == k).map(lambda m: ((m[0], 0), m[1][1])) for k in range(len(tops))]
    runs = descend(spark, levels, starts, parts, stop=1)
    # A lone leaf is its tree's subroot, and has no step in the tree.
    messages = starts[0].map(lambda m: (m[0], (m[1], True)))
    if levels:
        messages = messages.union(runs.map(lambda m: (m[0], (m[1], False))))
    mine = table.rdd.map(lambda r: ((r.tree, r.place // FANOUT), (r.place % FANOUT, r.id, r.leaf, r.altered)))

    def finish(got):
        (tree, _), (sent, members) = got
        members = sorted(members, key=lambda m: m[0])
        if not members:
            return
        ((path, lone),) = sent
        digests = [bytes.fromhex(m[2]) for m in members]
        upper = b"".join(s for _, s in path).hex().encode()
        for i, (_, id_, leaf, altered) in enumerate(members):
            own = () if lone else ((i, b"".join(digests[:i] + digests[i + 1 :])),)
            whole = (*own, *path)
            low = b"".join(s for _, s in own).hex().encode()
            folded = fold(bytes.fromhex(altered or leaf), whole)
            proof = b"".join(bytes((p, len(s) // 32)) + s for p, s in whole) if with_proof else None
            yield tree, id_, leaf, hashlib.sha256(low + upper).hexdigest(), folded.hex(), folded == root, proof

    done = messages.cogroup(mine, numPartitions=parts).flatMap(finish)
    out = spark.createDataFrame(done, "tree long, id long, leaf string, proof_sha256 string, folded_root string, verified boolean, proof binary", verifySchema=False)
    subs = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    columns = ["id", "leaf", "subroot", F.lit(root.hex() if root else None).alias("root"), "proof_sha256", "folded_root", "verified"]
    return out.join(subs, "tree").select(*columns, *(["proof"] if with_proof else []))
