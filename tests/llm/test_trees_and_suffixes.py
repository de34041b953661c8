"""Merkle manifest, suffix-array dedup and Lloyd clustering against plain versions; hashes that must not take different texts for equal."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_suffix(rows, window=100):
    """rows: (order, key, text); result by key."""
    first, out = {}, {}
    for order, key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if first.setdefault(raw[k : k + window], (order, k)) != (order, k):
                cover[k : k + window] = b"\1" * window
        kept = bytes(x for x, c in zip(raw, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[key] = (len(raw), sum(cover), spans, kept)
    return out


def suffix_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, edge = text(400), text(100)
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 300), (4, "ab" * 200 + edge), (5, "z" + edge), (6, edge[1:]), (7, shared), (8, shared[:150] + "!" + shared[150:])]
    rows += [(i, text(rng.randint(0, 80)) + shared[rng.randint(0, 100) : rng.randint(200, 400)] + text(rng.randint(0, 200))) for i in range(9, 30)]
    rows += [(30, text(200) * 3), (31, rows[15][1]), (32, "x" * 250)]
    return rows


def test_suffix_dedup(spark):
    from citeforge.llm.suffix import remove_repeats

    rows = suffix_rows()
    docs = spark.createDataFrame([(i, t, "own", i) for i, t in [*rows, rows[12]]], "doc_id long, text string, gram string, n_removed long").repartition(3)
    got = remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "gram", "n_bytes", "n_removed", "n_spans", "kept"]
    want = plain_suffix([((i,), i, t) for i, t in rows])
    seen = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got.collect()]
    assert len(seen) == len(rows) + 1 and all(want[i] == x for i, x in seen)
    assert sum(x[1] for x in want.values()) > 3000
    assert remove_repeats(docs.where("false")).count() == 0


def test_suffix_long_text_in_pieces(spark):
    from citeforge.llm.suffix import PIECE, remove_repeats

    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(PIECE + 5000))
    rows = [(1, base), (2, "q" * 333 + base[PIECE - 3000 : PIECE + 3000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_suffix([((i,), i, t) for i, t in rows])
    assert got[1][1] == 0 and got[2][1] == 6000 + 332  # a run of q repeats itself from its second byte on


def test_suffix_null_and_repeated_ids(spark):
    from citeforge.llm.suffix import remove_repeats

    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(None, passage + str(i)) for i in range(6)] + [(7, "q" + passage), (7, "r" + passage), (8, "short")]
    got = [(r.doc_id, r.text, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # Rows that share an id are rows of their own: just one of those of id 7 keeps the passage.
    assert sorted(n for i, _, n in got if i == 7) == [0, 150]
    assert [n for i, _, n in got if i is None] == [150] * 6


def plain_tree(rows):
    """rows: (doc_id, source, lang, n_chars, text) with ids that differ within a source."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: sha("".join(map(field, r)))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            i //= 16
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([leaf_of(r) for r in sorted(groups[s], key=lambda r: (r[0] is None, r[0] or 0))]) for s in names]
    top = climb([t[-1][0] for t in trees])
    out = {}
    for t, s in enumerate(names):
        for i, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is None, r[0] or 0))):
            steps = path(trees[t], i) + path(top, t)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf_of((*r[:4], r[4].translate(low) if hit and r[4] is not None else r[4]))
            for pos, others in steps:
                node = sha("".join(others[:pos] + [node] + others[pos:]))
            out[r[0], s] = (leaf_of(r), trees[t][-1][0], top[-1][0], sha("".join("".join(o) for _, o in steps)), node, node == top[-1][0])
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 16, "": 17}, {"hot": 300, "é": 3, "b": 257, None: 40}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_merkle_manifest(spark, sizes):
    from citeforge.llm.merkle import fold, leaves, manifest

    rng, rows, n = random.Random(2), [], 0
    for source, many in sizes.items():
        for k in range(many):
            n += 1
            rows.append((n if k else None, source, None if k % 7 == 3 else "en", k, None if k % 11 == 5 else "".join(rng.choice("aBcÉ ") for _ in range(k % 9))))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int").repartition(3)
    got = manifest(leaves(docs), with_proof=True).collect()
    want = plain_tree(rows)
    by_leaf = {v[0]: v for v in want.values()}
    assert len(got) == len(rows)
    assert all(by_leaf[r.leaf] == (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)
    for r in got:
        path, raw = [], bytes(r.proof)
        while raw:
            path.append((raw[0], raw[2 : 2 + 32 * raw[1]]))
            raw = raw[2 + 32 * raw[1] :]
        assert fold(bytes.fromhex(r.leaf), path).hex() == r.root
    assert len({r.root for r in got}) == 1


def test_merkle_repeats_and_empty(spark):
    from citeforge.llm.merkle import leaves, manifest

    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(1, "s", "en", 2, "Aa")] * 20 + [(None, None, None, None, None)] * 2
    got = manifest(leaves(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 22 and len({r.root for r in got}) == 1
    assert manifest(leaves(spark.createDataFrame([], schema))).count() == 0


def plain_lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [x for _, x in sorted(kept, key=lambda r: (sha(f"3:{r[0]}"), r[1]))[:k]]

    def assign():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
            out.append((i, x, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            own = [x for _, x, c, _ in got if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    return sorted((i, j, d, sum(r[3] for r in got if r[2] == j), sum(r[3] for r in got), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, _, j, d in got)


def test_lloyd(spark):
    from citeforge.llm.lloyd import cluster, with_inertia

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal((i % 3) - 1, 0.4, 64)]) for i in range(60)]
    rows += [(60, rows[5][1]), (5, rows[5][1]), (61, None), (62, [1.0] * 63), (63, [None] + [0.0] * 63), (64, [math.nan] * 64), (65, [math.inf] * 64), (66, [-0.0001] * 64)]
    schema = "vec_id long, embedding array<double>, cluster string"
    table = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3)
    got = sorted(tuple(r) for r in with_inertia(*cluster(table)).collect())
    assert got == plain_lloyd(rows) and len({r[1] for r in got}) > 2
    # Beyond what 64 bits of distance can hold a vector is left out; fewer vectors give fewer centroids, none give none.
    few = spark.createDataFrame([(1, [1e300] * 64, ""), (2, [0.5] * 64, ""), (None, [0.25] * 64, ""), (3, [-1e6] * 64, "")], schema)
    assert sorted((r.vec_id or 0, r.distance) for r in with_inertia(*cluster(few)).collect()) == [(0, 0), (2, 0)]
    assert with_inertia(*cluster(few.where("false"))).count() == 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_sums_of_powers_take_for_equal(spark, n):
    from citeforge.llm.jaccard import op_rows
    from citeforge.llm.substring import remove_repeats

    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} b c d e"), (4, f"{two} b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    links = {r.doc_id: r.component_id for r in op_rows(docs).collect()}
    assert links[3] == 3 and links[4] == 4


def test_sequences_that_sums_of_powers_take_for_equal():
    from citeforge.llm.textbytes import ngrams

    for which in (0, 1):
        x, y = (np.array([{"a": 17, "b": 4242}[c] for c in thue_morse(2048, *p)], np.uint64) for p in ("ab", "ba"))
        assert ngrams(x, 2048, which)[0] != ngrams(y, 2048, which)[0]


def test_rows_without_id_are_told_apart(spark):
    """Two rows without id whose texts agree in 24 bits of their hash, and one of which repeats another row's words."""
    from citeforge.llm.substring import remove_repeats

    passage = " ".join(f"p{i}" for i in range(20))
    other = " ".join(f"o{i}" for i in range(24))
    made = spark.range(12000).select(F.concat(F.lit(passage + " x"), "id").alias("a"), F.concat(F.lit(other + " y"), "id").alias("b"))
    low = lambda c: F.xxhash64(c).bitwiseAND(F.lit(2**24 - 1))
    pair = made.select("a", low("a").alias("t")).join(made.select("b", low("b").alias("t")), "t").first()
    rows = [(1, passage), (None, pair.a), (None, pair.b)]
    got = {r.text: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {passage: 0, pair.a: 20, pair.b: 0}


def test_rows_that_share_an_id(spark):
    from citeforge.llm.substring import remove_repeats

    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(5, f"a {passage}"), (5, f"b {passage}"), (5, f"b {passage}"), (6, passage)]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # One of the texts of id 5 is the first, and its copies keep the passage as well.
    assert [r[2] for r in got] in ([0, 25, 25, 25], [25, 0, 0, 25])


def test_top_k_of_large_components(spark):
    """Finite components whose scores could leave 64 bits take no part; the largest that do are exact."""
    from citeforge.llm.topk import LARGEST, top_k

    big = LARGEST / 256
    rows = [(0, [1.0, big]), (1, [-1e300, 0.0]), (2, [1e18, 1.0]), (3, [0.5, -big]), (4, [2.0, 3.0]), (5, [0.0] * 3000), (50, [big, -big])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i not in (1, 2, 5)}
    want = []
    for q in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == want and max(abs(r[3]) for r in want) > 2**52


def test_top_k_visits_no_segment_that_cannot_win(spark, monkeypatch):
    """Small segments, clustered vectors, repeated ids and ties: results of the plain search, and of searching every pair."""
    from citeforge.llm import topk

    monkeypatch.setattr(topk, "SEGMENT", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(8 * (i // 60), 0.2, 6)]) for i in range(600)]
    rows += [(100, rows[3][1]), (100, [0.0] * 6), (601, [1.0] * 4), (602, rows[50][1]), (603, [-9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        found = [(-sum(a * b for a, b in zip(x, v)), i) for j, x in ints if j == q for i, v in ints if i != q]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:5])]
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == want
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want
