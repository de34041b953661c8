"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names in every operator and stage."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import words

#: Columns that the operators use themselves.
CLASHING = ["doc", "key", "own", "row", "tag", "drop_id", "again_id", "mix_doc_id", "th", "copies", "score", "n", "h1", "runs", "s", "d1", "component", "languages", "host", "size", "id", "of", "predicted", "kept", "n_words", "a b"]


def rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(80)
    out = [(None, base, "en", "a"), (None, None, None, None), (1, "", "en", None), (2, base + " more", None, "b"), (3, text(9000), "de", "a"), (4, " \n\t", "de", "a"), (5, text(60), "en", "b"), (5, text(60), "en", "b"), (6, base, "de", "a"), (6, base, "de", "a")]
    out += [(10 + i, f"{text(30)} stupid fool {text(20)}" if i % 4 == 0 else text(50), ["en", "de"][i % 2], "ab"[i % 2]) for i in range(80)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    return d.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(f"keep {c}").alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    got = [(i, int("stupid" in (t or ""))) for i, t, *_ in rows() if i and i >= 10]
    return spark.createDataFrame([*got, (None, 1), (10, None), (11, 1), (11, 0), (4000, 1)], "doc_id long, toxic int")


def same_rows(got, docs):
    """Every row of docs is there with all its columns."""
    assert Counter(map(tuple, got.select(*[F.col(f"`{c}`") for c in docs.columns]).collect())) == Counter(map(tuple, docs.collect()))


def own(docs, *taken):
    return docs.drop(*taken)


def test_columns_pass_through(docs, labels):
    from citeforge.llm import langid, mixing, substring, toxicity

    d = own(docs, "score", "predicted")
    model = toxicity.train(d, labels, 1, 3)
    assert model is not None
    same_rows(toxicity.score(d, model), d)
    d = own(docs, "n_words", "n_removed", "kept_text")
    same_rows(substring.remove_repeats(d), d)
    d = own(docs, "lang_pred", "score", "languages")
    same_rows(langid.identify(d, *langid.train(d)), d)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    mine = Counter(map(tuple, docs.collect()))
    assert set(map(tuple, mix.collect())) <= set(mine)


def test_keep_one_keeps_columns(docs):
    from citeforge.llm.jaccard import keep_one

    got = keep_one(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    # Of the group of copies of base (6 twice, a null id, 2) the row of smallest id stays; different texts of id 5 both do.
    assert kept[2, rows()[3][1]] == 1 and not any(i == 6 for i, _ in kept) and sum(v for (i, _), v in kept.items() if i == 5) == 2
    assert kept[None, None] == 1 and (None, rows()[0][1]) not in kept


def test_language_with_odd_rows(docs):
    from citeforge.llm.langid import identify, train

    languages, model = train(docs)
    assert languages == ["de", "en"] and model.sum(1) == pytest.approx(1)
    got = identify(docs.select("doc_id", "text"), languages, model).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if not any(c.isalpha() for c in r.text or ""))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows())
    none, empty = train(docs.where("lang is null"))
    assert none == [] and {r.lang_pred for r in identify(docs.select("doc_id", "text"), none, empty).collect()} == {"und"}


def test_repeated_and_null_ids_in_files(spark, docs):
    from tokenizers import Tokenizer

    from citeforge.llm.bpe import encode_decode
    from citeforge.llm.queries import vocabulary
    from citeforge.llm.tokenfile import round_trip

    word, byte = (Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    got = round_trip(docs, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    at = 0
    for r in got:  # starts are those of all documents before, whatever the order of equal ids
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    crc = Counter((i, zlib.crc32(np.array([*word.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == crc
    sha = Counter((i, hashlib.sha256(np.array(byte.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.ids_sha256) for r in encode_decode(docs, vocabulary("byte_bpe_50k.json")).collect()) == sha


def test_pieces_equal_the_library():
    """Odd spaces, contractions, special tokens, controls and letters beyond Latin, in memories that overflow."""
    from tokenizers import Tokenizer

    from citeforge.llm import encoding
    from citeforge.llm.queries import vocabulary

    rng = random.Random(8)
    parts = ["I'll", "don't", "x's", "'s", "a", "ß", "Éa", "ª", "²", "10.5", "a1b2", "...", "—", "é", "e\u0301", "İ", "привет", "日本語", "\x1c", "\x85", "\u00a0", "\u00ad", "\n", "\n\n", "  ", "\t", " ", "", "<|endoftext|>", "<|startoftext|>", "<|", "€", "ﬁ", "_x_", "%$#", "naïve,", "(end)."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + parts + [""]
    old, encoding.REMEMBERED = encoding.REMEMBERED, 64
    try:
        for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
            e, t = encoding.PieceEncoder(vocabulary(name), keep, "<u4"), Tokenizer.from_file(vocabulary(name))
            for a in range(0, len(texts), 50):
                for text, raw in zip(texts[a : a + 50], e.encode(texts[a : a + 50])):
                    assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, (name, text)
    finally:
        encoding.REMEMBERED = old


def test_urls_of_many_labels(spark):
    from citeforge.llm.urlfilter import Rule, judge

    long = ".".join(["a"] * 20_000)
    urls = [f"http://{long}.com/en/1", f"http://{long}.de/en/1", "http://com/en/", "http:///en/", None, "x://b.org/es/", "x://b.org/es/"]
    df = spark.createDataFrame([(i // 2, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, key string")
    got = judge(df)
    assert got.columns[:3] == ["page_id", "url", "key"]
    assert Counter((r.url[-5:] if r.url else None, r.rule, r.verdict) for r in got.collect()) == Counter([("/en/1", "com/en/", "block"), ("/en/1", None, "allow"), ("m/en/", "com/en/", "block"), ("//en/", None, "allow"), (None, None, "allow"), (".org/es/"[-5:], "org/es/", "block"), ("g/es/", "org/es/", "block")])
    many = tuple(Rule(f"h{i}.net", "/", "block" if i % 2 else "allow") for i in range(3000))
    pages = spark.createDataFrame([(i, f"http://x.h{i}.net/p") for i in range(4000)], "page_id int, url string")
    assert {r.page_id for r in judge(pages, many).collect() if r.verdict == "block"} == set(range(1, 3000, 2))
    assert {r.verdict for r in judge(pages, ()).collect()} == {"allow"}


def test_top_k_repeated_ids_and_large_numbers(spark):
    from citeforge.llm.topk import top_k

    rng = np.random.default_rng(5)
    v = [(int(i), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)] + [(50, [1.0, 2.0, 0.0, 0.0])] * 2 + [(None, [1.0])] + [(7, [9000.0, 0.0, 0.0, 0.0])]
    got = top_k(spark.createDataFrame([(*x, "own") for x in v], "vec_id long, embedding array<double>, score string")).collect()
    ok = [(i, [int(np.floor(256 * y)) for y in x]) for i, x in v if i is not None]
    for q in {r.query_id for r in got}:
        best = {}
        for vec in [x for i, x in ok if i == q]:
            best[tuple(vec)] = sorted((-sum(a * b for a, b in zip(vec, c)), i) for i, c in ok if i != q)[:5]
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        # Rows that repeat a query's id ask together: the best of all their answers.
        every = sorted({y for x in best.values() for y in x} if len(best) > 1 else next(iter(best.values())))[:5]
        assert [(s, i) for _, s, i in mine] == every[: len(mine)] if len(best) == 1 else mine[0][1] == every[0][0]
    assert {r.query_id for r in got} == {0, 50, 100}


def test_empty_tables_everywhere(spark, docs, labels):
    from citeforge.llm import bpe, jaccard, langid, mixing, quality, substring, tokenfile, topk, toxicity, urlfilter
    from citeforge.llm.queries import vocabulary

    none = docs.limit(0)
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert bpe.encode_decode(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0
    assert jaccard.keep_one(none).count() == jaccard.op_rows(none).count() == 0
    assert langid.identify(none, *langid.train(none)).count() == 0
    assert substring.remove_repeats(own(none, "n_words")).count() == 0
    assert quality.judge(none).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels, 1, 3)).count() == 0 and toxicity.train(docs, labels.limit(0), 1, 3) is None
    assert tokenfile.round_trip(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pipeline_of_an_empty_table(spark, docs, labels, tmp_path):
    import corpus_pipeline as p

    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_against_a_plain_chain(spark, docs, labels, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from citeforge.llm import mixing, toxicity
    from citeforge.llm.queries import vocabulary

    table = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.col(f"`{c}`") for c in ("doc", "row", "drop_id", "mix_doc_id", "score", "n_words")])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in p.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    assert all(stage(spark, table, str(tmp_path)).columns == table.columns for _, stage in p.STAGES[:-1])
    model = toxicity.train(table, labels, 1, 3)
    left = [(r.doc_id, r.text, r.source) for r in toxicity.score(table, model).where("predicted = 0").collect()]
    assert 0 < len(left) < len(rows())
    # One of each group of near copies: texts are compared with every other.
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = words((t or "").translate(low))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(t) for _, t, _ in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    order = lambda i: (left[i][0] is None, left[i][0] or 0)
    lead = {g: min((i for i in range(len(left)) if group[i] == g), key=order) for g in set(group)}
    left = [left[i] for i in range(len(left)) if lead[group[i]] == i]
    # Words of windows that start earlier too are cut.
    first, cut = {}, []
    for i, t, s in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        cover = [False] * len(w)
        for a in range(len(w) - 19):
            if first.setdefault(tuple(w[a : a + 20]), (i, a)) != (i, a):
                cover[a : a + 20] = [True] * 20
        cut.append((i, " ".join(x for x, c in zip(w, cover) if not c) if any(cover) else t, s))
    mixed = Counter()
    for r in mixing.mix(spark.createDataFrame(cut, "doc_id long, text string, source string")).collect():
        mixed[r.doc_id, r.th] += r.copies
    th = {(i, t): h for i, t, h in spark.createDataFrame(cut, "doc_id long, text string, source string").select("doc_id", "text", F.xxhash64("text")).collect()}
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in cut:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += mixed[i, th[i, t]]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, str(tmp_path)).collect())
    assert got == +want
