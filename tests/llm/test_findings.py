"""What reviews found in the operators for training data, each as a small table that failed before."""

import random
import re


def test_unlike_documents_make_no_sets_when_sketches_are_full(spark, monkeypatch):
    from citeforge.llm import jaccard, sketch

    rng, kept = random.Random(5), {}
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, own = [(i, " ".join(text(200))) for i in range(1500)], jaccard.written
    for i, n in enumerate((4, 90, 104, 105, 106, 125, 128, 130, 131, 400)):  # about the sizes from which a slice is sent
        words = text(n)
        more = [w for w in words]
        more[-1] = "other"  # the last shingle alone differs
        rows += [(2000 + 2 * i, " ".join(words)), (2001 + 2 * i, " ".join(more + text(n // 10)))]

    def written(df, name):
        kept[name] = own(df, name)
        return kept[name]

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(sketch, "MAX_BITS", 16)
    got = {r.doc_id: r.component_id for r in jaccard.op_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i if i < 2002 else i - i % 2 for i in got} and len(got) == len(rows)
    assert kept["jaccard-classes"].count() <= 40


def test_misses_of_sets(spark):
    import numpy as np
    import pyarrow as pa

    from citeforge.llm.misses import ALL, in_slice, misses

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    sets = [np.unique(rng.choice(pool, int(n))) for n in rng.integers(1, 260, 120)] + [np.zeros(0, np.uint64)]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "doc long, s binary").repartition(5)

    def read(batch: pa.RecordBatch):
        for doc, s in zip(*(c.to_pylist() for c in batch.columns)):
            yield doc, np.frombuffer(s, np.uint64), 7, doc

    got = {r.doc: (r.n, r.d1, r.d2, r.misses) for r in misses(df, read, 6, 1.25).collect()}
    for i, s in enumerate(sets):
        # Hashes that others send: all of sets up to 1.25 * ALL, of larger ones the slice.
        others = np.concatenate([x if len(x) <= 1.25 * ALL else x[in_slice(x)] for j, x in enumerate(sets) if j != i])
        own = s if len(s) <= ALL else s[in_slice(s)]
        assert got[i] == (len(s), 7, i, int((~np.isin(own, others)).sum()))


def test_top_k_pairs_are_never_broadcast(spark, monkeypatch):
    from citeforge.llm import topk

    monkeypatch.setattr(topk, "SEGMENT", 8)
    monkeypatch.setattr(topk, "TASKS", 5, raising=False)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)], "vec_id long, embedding array<double>")
    got = topk.top_k(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Each query visits many segments: the pairs are as many times the queries as there are segments.
    assert "SortMergeJoin [part" in plan and "BroadcastHashJoin [part" not in plan
    assert max(int(n) for n in re.findall(r"hashpartitioning\(part#\d+L?, (\d+)\)", plan)) == 5
    x = {i: [int(256 * v // 1) for v in e] for i, e in df.collect()}
    best = lambda q: sorted((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q)[:5]
    want = {(q, r + 1, -s, c) for q in x if q % 50 == 0 for r, (s, c) in enumerate(best(q))}
    assert {(r.query_id, r["rank"], r.score, r.vec_id) for r in got.collect()} == want
