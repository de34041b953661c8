"""Notes and merged lists against plain versions on small fixtures."""

import random
import re

from pyspark.sql import functions as F


def test_notes(spark):
    from citeforge.operators.notes import link_notes, note_lines

    refs = [(1, 1, "Nguyễn", "Deep learning for medical images", None), (1, 2, "Smith", "Ancient pottery of Crete", None), (1, 3, "Smith", "Modern glass making", "10.1000/Glass"), (1, 4, "van Dijk", "Graphs and trees", None), (2, 1, "Solo", None, None)]
    text = """Body text of 3 things.
1 Jane Smith, Ancient pottery of Crete (Oxford, 1999), 12.
2 Ibid., 14.
3 A. Nguyen, Deep learning (2001).
4 Smith, op. cit., 3.
5. J. Smith, Modern glass making.
6 Smith, op. cit., 25.
7 Smith, Ancient pottery, op. cit., 30.
8 See supra note 3, at 5.
9 Ibid.
10 Nobody at all.
11 ibid
12 See https://doi.org/10.1000/glass.
13 van Dijk, Something else entirely.
14 Dijk, loc. cit.
15 Smith, In general.
16 supra note 40"""
    texts = spark.createDataFrame([(1, text), (2, "1 Ibid.\n2 Solo, A thing.\n2 Other line"), (3, None), (4, "")], "doc_id long, text string")
    got = link_notes(note_lines(texts), spark.createDataFrame(refs, "doc_id long, reference_id long, author string, title string, doi string")).collect()
    assert sorted((r.doc_id, r.note, r.reference_id, r.how) for r in got) == [
        (1, 1, 2, "full"), (1, 2, 2, "ibid"), (1, 3, 1, "full"), (1, 4, 2, "op_cit"), (1, 5, 3, "full"), (1, 6, 3, "op_cit"), (1, 7, 2, "op_cit"), (1, 8, 1, "supra"), (1, 9, 1, "ibid"), (1, 11, 1, "ibid"),
        (1, 12, 3, "full"), (1, 13, 4, "full"), (1, 14, 4, "op_cit"), (2, 2, 1, "full"),
    ]


def test_shuffled_lists_merge(spark):
    from citeforge.operators.merging import best_pairs, merge_lists

    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(14)]
    lefts, rights = [], []
    for doc in range(40):
        titles = [" ".join(rng.sample(vocab, rng.randint(2, 5))) for _ in range(rng.randint(1, 6))]
        lefts += [(doc, i, t, 2000 + rng.randint(0, 2), rng.choice(["Smith, J.", "Doe, A.", None])) for i, t in enumerate(titles)]
        rng.shuffle(titles)
        rights += [(doc, 100 + i, " ".join(w for w in t.split() if rng.random() < 0.8) or None, 2000 + rng.randint(0, 2), rng.choice(["J. Smith", "A. Doe"])) for i, t in enumerate(titles)]
    schema = "doc_id long, reference_id long, title string, year int, author string"
    left, right = spark.createDataFrame(lefts, schema), spark.createDataFrame(rights, schema)

    def score(a, b):
        x, y = set(a[2].split()), set((b[2] or "").split())
        last = lambda n: n and re.sub(r"[^a-z ]", "", n.lower()).split()[0 if "," in n else -1]
        return (100 * len(x & y) // len(x | y) if x & y else -99) + 20 * (a[3] == b[3]) + 30 * (last(a[4]) == last(b[4]))

    want = set()
    for doc in range(40):
        pairs = sorted((-score(a, b), a[1], b[1]) for a in lefts for b in rights if a[0] == b[0] == doc and score(a, b) >= 60)
        used = set()
        for _, a, b in pairs:
            if not {a, b} & used:
                used |= {a, b}
                want.add((doc, a, b))
    got = {tuple(r) for r in best_pairs(left, right).collect()}
    assert got == want and len(got) > 40
    # One-to-one, and every pair is the best of what either side has left.
    assert len({(d, a) for d, a, _ in got}) == len(got) == len({(d, b) for d, _, b in got})
    with_all = lambda df: df.withColumn("doi", F.lit(None).cast("string")).withColumn("venue", F.lit(None).cast("string"))
    merged = merge_lists(with_all(left), with_all(right)).collect()
    assert len({(r.doc_id, r.left_id) for r in merged if r.left_id is not None}) == len(lefts) == sum(r.left_id is not None for r in merged)
    assert sum(r.right_id is not None for r in merged) == len(rights)


def test_bridge(spark):
    from citeforge.operators.merging import bridge

    words = {"học máy": "machine learning", "học": "study"}
    rows = [("Chúng tôi dùng học máy với BERT-base và (SVM).", "A study", None), ("Chúng tôi", "A study", None), ("plain English", "A study", None), ("Chúng tôi dùng học máy", "Nghiên cứu về dữ liệu lớn", None), (None, None, None), ("ắ ằ ẳ", "A", None)]
    got = spark.createDataFrame(rows, "c string, t string, a string").select(bridge(F.col("c"), F.col("t"), F.col("a"), words).alias("b")).collect()
    assert [(r.b.cross, r.b.text) for r in got] == [(True, rows[0][0] + " (BERT-base SVM machine learning study)"), (False, ""), (False, ""), (False, ""), (False, ""), (True, "ắ ằ ẳ")]


def test_texts_from_positions(spark):
    from citeforge.operators.merging import from_positions

    rows = ['{"b": [1], "a": [0, 2]}', '{"a": "x", "c": [0, "y", 1.5, null], "d": 7}', "{}", "", None, "[1]", '{"a": [0', '{"b": [0], "a": [0]}', '{"a": []}']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(from_positions(F.col("x"))).collect()]
    assert got == ["a b a", "c", None, None, None, None, None, "a b", None]


def test_record_rules_in_the_chain(spark):
    """Rules on records found stand where they belong, read null as false, and leave the rest of the chain as it is."""
    from citeforge.operators.rules import EVIDENCE_RULES, FULL_RULES, RECORD_RULES, classify

    assert tuple(r for r in FULL_RULES if r not in [x[:4] for x in RECORD_RULES]) == EVIDENCE_RULES and len(FULL_RULES) == len(EVIDENCE_RULES) + len(RECORD_RULES)
    names = [r[0] for r in FULL_RULES]
    assert names.index("R-HF-VERIFIED") < names.index("R-GLOBAL-DOI-RA-VERIFIED") < names.index("R-LOCAL_DB_VERIFIED") < names.index("R-LOCAL_DB_GOOD_MATCH") < names.index("R-WELL-LINKED")
    assert names.index("R-AMBIGUOUS-MAPPING") < names.index("R-CONTENT-ALIGNMENT") < names.index("R-CONTENT-MISMATCH") < names.index("R-KNOWN-AUTHOR-TITLE-MISMATCH") < names.index("R-ABSTENTION-BORDER")
    base = dict(fake_url=False, fabricated_doi=False, fake_author=False, future_year=False, known_author=False, url_status=None, clean_sources=0, sources_queried=1, substantive=True, kind=None, best_source=None, linked=False, ambiguous=False, book=False, style_penalty=0.1, provenance_penalty=0.05, has_candidate=True, has_doi=False, doi_exact_match=False, title_sim=0.5, author_sim=0.0, year_distance=5, consensus=0, title_fuzzy=0.5, registered=False, local_only=False, live=False, arxiv_alias=False, both_dois=False, doi_conflict=False, content_score=0.0, content_aligned=False, missing_reference=False, matched=None, quality_candidate=False, url_only=False)
    cases = [
        (dict(registered=True, doi_exact_match=True, title_fuzzy=0.88, title_sim=0.88, year_distance=999), ("R-GLOBAL-DOI-RA-VERIFIED", "verified", 0.73)),
        (dict(local_only=True, title_fuzzy=0.95, title_sim=0.96, author_sim=0.9, year_distance=1), ("R-LOCAL_DB_VERIFIED", "verified", 0.7)),
        (dict(local_only=True, title_fuzzy=0.99, title_sim=0.99, author_sim=0.4, year_distance=0), ("R-LOCAL_DB_GOOD_MATCH", "verified", 0.65)),
        (dict(local_only=True, title_fuzzy=0.99, title_sim=0.99, author_sim=0.4, year_distance=0, both_dois=True), ("R-LOCAL_DB_METADATA_ERROR", "metadata_error", 0.68)),
        (dict(content_score=0.6, content_aligned=True, title_fuzzy=0.7, title_sim=0.7, author_sim=0.5, year_distance=0, matched=False), ("R-WEAK-EVIDENCE", "unresolved", 0.4)),
        (dict(content_score=0.6, content_aligned=True, title_fuzzy=0.7, title_sim=0.7, author_sim=0.5, year_distance=0), ("R-CONTENT-ALIGNMENT", "verified", 0.75)),
        (dict(content_score=0.3, title_fuzzy=0.8, title_sim=0.8, author_sim=0.5, year_distance=3), ("R-CONTENT-MISMATCH", "suspected_hallucination", 0.7)),
        (dict(content_score=0.25, title_fuzzy=0.3, title_sim=0.3, author_sim=0.3, year_distance=0), ("R-CONTENT-ALIGNMENT", "unresolved", 0.15)),
        (dict(live=True, consensus=1, title_fuzzy=0.7, title_sim=0.7, author_sim=0.3), ("R-SINGLE-SOURCE-PARTIAL", "metadata_error", 0.58)),
        (dict(known_author=True, quality_candidate=True, title_fuzzy=0.35, title_sim=0.35, author_sim=0.5), ("R-KNOWN-AUTHOR-TITLE-MISMATCH", "metadata_error", 0.65)),
        (dict(title_sim=None, title_fuzzy=None, author_sim=None, year_distance=None, content_score=None, live=None), ("R-WEAK-EVIDENCE", "unresolved", 0.4)),
    ]
    kinds = {bool: "boolean", float: "double", int: "int", type(None): "string"}
    schema = "i int, " + ", ".join(f"{k} {'boolean' if k == 'matched' else kinds[type(v)]}" for k, v in base.items())
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    got = {r.i: (r.rule, r.label, round(r.confidence, 6)) for r in classify(df, FULL_RULES).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
