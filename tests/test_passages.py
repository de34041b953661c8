"""Kept index, implicit passages, and lists without markers, against plain versions on small fixtures."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F


def plain_search(docs, queries, top):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = {i: split(t) for i, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    out = []
    for q, text in queries:
        asked = set(split(text))
        hits = []
        for i, w in words.items():
            if asked and asked <= set(w):
                score = 0
                for x in asked:
                    df = sum(x in v for v in words.values())
                    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df < n + 0.5 else 1e-6
                    tf = w.count(x)
                    score += math.floor(1e6 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) + 0.5)
                hits.append((-score, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(hits)[:top])]
    return sorted(out)


def test_index_in_segments_and_blocks(spark, tmp_path):
    from citeforge.operators import postings

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["été", "the"]
    # Some words are in nearly all texts, others in few; lengths differ, so blocks have different bounds.
    docs = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 20, 62])]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "W1, w2; W1-w3!")]
    queries = [(0, "w1"), (1, "w1 w2"), (2, "w1 W1 w19"), (3, "nowhere w1"), (4, ""), (5, None), (6, "été the"), (7, "w0 w1 w2 w3"), (8, "w59")]
    path = str(tmp_path / "index")
    for part in (0, 1, 2):
        postings.add(spark.createDataFrame([d for d in docs if d[0] % 3 == part], "id long, text string"), path, block=16)
    got = postings.Index(spark, path).search(spark.createDataFrame(queries, "query_id long, text string"), 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(docs, queries, 4)
    # Blocks that can't reach the k-th score are not read: all of one word's texts fall in a few of them.
    assert [r.query_id for r in got.where("query_id in (3, 4, 5)").collect()] == []


def test_index_of_nothing(spark, tmp_path):
    from citeforge.operators import postings

    path = str(tmp_path / "index")
    postings.add(spark.createDataFrame([], "id long, text string"), path)
    assert postings.Index(spark, path).search(spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_single_search_weighs_as_the_index(spark, tmp_path):
    from citeforge.operators import postings
    from citeforge.operators.catalog import bm25

    docs = spark.createDataFrame([(1, "a b c"), (2, "a a x y z"), (3, None), (4, "b"), (5, "")], "id long, text string")
    postings.add(docs, str(tmp_path / "index"))
    one = postings.Index(spark, str(tmp_path / "index")).search(spark.createDataFrame([(0, "a")], "query_id long, text string"))
    assert [(r.id, r.score) for r in one.orderBy("rank").collect()] == [tuple(r) for r in bm25(docs, ["a"]).collect()]


def test_passages(spark):
    from citeforge.operators.discovery import discover

    body = "Nothing of interest is written in this first sentence here. Transformers rely on attention to weigh every token in a sequence. They were proposed by Vaswani and colleagues at a conference. Another sentence speaks about mạng nơ-ron in a different language altogether. Smith, J. (2001). Attention in transformers, a list entry. Press of the city."
    texts = [(1, body), (2, None), (3, "short"), (4, body), (5, "TABLE OF CONTENTS " + body)]
    refs = [(1, 1, "Attention for transformers", "A token sequence model", ["Vaswani, A."]), (1, 2, "Unrelated zebra", None, []), (1, 3, None, None, ["X"]), (1, 4, "Neural networks", None, None), (2, 1, "Attention", None, []), (5, 1, "Attention", None, []), (4, 1, "They were proposed by Vaswani and colleagues", None, [])]
    got = discover(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(refs, "doc_id long, ref long, title string, abstract string, authors array<string>"), {"mạng nơ-ron": "neural network"})
    found = {(r.doc_id, r.ref): r for r in got.collect()}
    # The windows that hold a title itself are taken for entries of a list, so reference 1 of text 4 has none.
    assert set(found) == {(1, 1), (1, 4)}
    assert found[1, 1].place == 1 and "Vaswani" in found[1, 1].passage and found[1, 1].similarity > 0.5
    assert "mạng nơ-ron" in found[1, 4].passage


def test_passages_stop_early_with_the_same_result():
    from citeforge.operators import discovery

    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(30)]
    for _ in range(60):
        passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 14))) for _ in range(40)]
        index = {}
        for i, p in enumerate(passages):
            for w in discovery._words(p):
                index.setdefault(w, []).append(i)
        ref = {"title": " ".join(rng.sample(vocab, 5)), "abstract": None, "authors": [rng.choice(vocab) + ", A."]}
        got = discovery._passage(ref, list(range(40)), passages, index, [])
        title, name = set(discovery._words(ref["title"])), re.sub("[^a-z]", "", ref["authors"][0].split(",")[0])
        score = lambda p: 2.0 * len(title & set(discovery._words(p))) + 3.0 * (name in discovery._words(p)) + min(len(p), 260) / 300  # noqa: B023, E731
        best = sorted((-round(score(p), 9), i) for i, p in enumerate(passages) if score(p) >= 2)[:8]
        want = max(best, key=lambda b: (len(title & set(discovery._words(passages[b[1]]))), -best.index(b)))
        assert got[0] == want[1]


def plain_cut(lines):
    from citeforge.operators import lists as c

    begins = lambda x: -4 if re.match(r"(?:URL\b|https?:|doi:|DOI:|ISBN\b|ISSN\b|arXiv:|volume\b|vol\.|pages\b|pp\.|In\s)", x) else 3 if re.match(r"[A-ZÀ-Ý][\w'’\-]+,\s+[A-Z]", x) else 1 if re.match(r"[A-ZÀ-Ý\"“]", x) else -3
    years = lambda x: len(re.findall(r"\b(?:18|19|20)\d{2}[a-z]?\b", x))
    best = None
    for tail in itertools.product("01", repeat=len(lines) - 1):
        cuts = "1" + "".join(tail)
        starts = [i for i, x in enumerate(cuts) if x == "1"]
        score = 0
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            score += begins(lines[a]) + c.YEARS[min(3, sum(map(years, lines[a:b])))] + ((2 if re.search(r"(?:[.\d]|https?://\S+)$", lines[a - 1]) else -2) if a else 0)
        if best is None or (score, -len(starts), cuts) > best:
            best = (score, -len(starts), cuts)
    return best[2]


def test_cut_against_all_cuts(spark):
    from citeforge.operators.lists import best_cut

    rng = random.Random(12)
    pieces = ["Smith, J. (2001). One study.", "of many things. Press.", "Doe, A. and Roe, B. 1999.", "https://x.org/a", "pp. 12-14, 2003.", "A title in capitals", "lower case goes on,", "“Quoted title,” 2011.", "In Proceedings of Things, 1998."]
    lists = [[rng.choice(pieces) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, lines array<string>").select("id", best_cut(F.col("lines")).alias("c")).collect()
    assert {r.id: r.c for r in got} == {i: plain_cut(x) for i, x in enumerate(lists)}


@pytest.mark.parametrize("text,want", [
    ("Smith, J. (2001). A study of many\nthings and of others. Press.\nTran, A. (2002). Another study. Press.", ["Smith, J. (2001). A study of many things and of others. Press.", "Tran, A. (2002). Another study. Press."]),
    ("Smith, J. (2001). One long study here. Press. Tran, A. (2002). Another study here. Press.", ["Smith, J. (2001). One long study here. Press.", "Tran, A. (2002). Another study here. Press."]),
    ("Jane Smith and Al Roe. A study of recog-\nnition. Journal of Tests, 2001.\nAnn Tran. Another study of the things.\nhttps://doi.org/10.1/x, 2003.", ["Jane Smith and Al Roe. A study of recognition. Journal of Tests, 2001.", "Ann Tran. Another study of the things. https://doi.org/10.1/x, 2003."]),
    ("Only one entry of some length, 2001.", ["Only one entry of some length, 2001."]),
    ("", []), (None, []), ("short", []),
])
def test_entries_without_markers(spark, text, want):
    from citeforge.operators.lists import unmarked_entries

    got = unmarked_entries(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("entry").collect()
    assert [r.raw for r in got] == want


def test_implicit_lists(spark):
    from citeforge.operators.lists import implicit_lists

    prose = "\n".join(f"This is line {i} of prose." for i in range(8))
    marked = "\n".join(f"[{i}] Smith, J. Study {i}, 2001." for i in range(1, 5))
    dotted = "\n".join(f"{i}. Smith, J. Study {i}, 200{i}" for i in range(1, 5))
    wild = "\n".join(f"{i}. Smith, J. Study, 2001" for i in (3, 9, 20, 31))
    undated = "\n".join(f"{i}. Smith, J. Study" for i in range(1, 5))
    rows = [(1, f"{prose}\n{marked}\nEnd of it."), (2, f"{prose}\n{dotted}\nEnd."), (3, f"{prose}\n{wild}"), (4, f"{prose}\n{undated}"), (5, prose), (6, ""), (7, None), (8, f"{marked}\n{prose}")]
    got = {r[0]: tuple(r)[1:] for r in implicit_lists(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (8, 11, 4, 4), 2: (8, 11, 4, 4)}
