"""Functions over citation texts and names against values written out by hand."""

import itertools

import pytest
from pyspark.sql import functions as F


def one(spark, values, kind, f):
    """f over a column of values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalised_identifiers(spark):
    from citeforge.functions.normalize import normalize_arxiv, normalize_doi, normalize_text, numeric_indices, title_tokens

    dois = [" https://doi.org/10.1000/ABC. ", "doi:10.1/x)}>", "１０.1/ｘ", "HTTP://DX.DOI.ORG/10.1/Y;", "", "  ", None]
    assert one(spark, dois, "string", normalize_doi) == ["10.1000/abc", "10.1/x", "10.1/x", "10.1/y", None, None, None]
    ids = ["arXiv:2101.00001v2.", "https://arxiv.org/abs/1706.03762v5?x=1", "2101.00001", "https://www.arxiv.org/pdf/2101.1#p", None]
    assert one(spark, ids, "string", normalize_arxiv) == ["2101.00001", "1706.03762", "2101.00001", "2101.1", None]
    assert one(spark, ["Ｄeep—Learning, et al.: a STUDY", "Große ﬁne (Straße)", "", None], "string", normalize_text) == ["deep learning a study", "grosse fine strasse", "", None]
    assert one(spark, ["A b graph of b cc b cc"], "string", title_tokens) == [["graph", "of", "cc"]]
    raw = ["Smith 2020 [4]", "[1–3]", "see [3], p. 12", "[1, 3-5]", "x^2-4", "[1-60]", "[5-3]", "none 12", "", None]
    assert one(spark, raw, "string", numeric_indices) == [[4], [1, 2, 3], [3], [1, 3, 4, 5], [2, 3, 4], [1, 60], [5, 3], [], [], []]


def test_found_in_texts(spark):
    from citeforge.functions import identifiers as ids

    assert one(spark, ["See https://doi.org/10.1000/xyz123", "DOI: 10.1016/s0140-6736(20)31180-6.", "No DOI here", None], "string", ids.extract_doi) == ["10.1000/xyz123", "10.1016/s0140-6736(20)31180-6", None, None]
    assert one(spark, ["Visit https://example.com for more", "http://arxiv.org/abs/1234.5678).", "http://nohost", "http://localhost/a", "none"], "string", ids.extract_url) == ["https://example.com", "http://arxiv.org/abs/1234.5678", None, "http://localhost/a", None]
    years = ["Published in 2020", "Vaswani et al. (2017)", "Smith (2020a) and Jones (2020b)", "No year here", "LNCS 1984, pp. 1901-1923, 1998.", "Retrieved 3 May 2021 from x. Made 2019", "Accessed 2022", "1895-1923 only 1920-1935"]
    assert one(spark, years, "string", ids.extract_year) == ["2020", "2017", "2020a", None, "1998", "2019", "2022", "1923"]
    files = ["Thesis_v2.docx", "a/b/My Paper (1).pdf", "report-final_fixed.txt", "draft.pdf", "", None, "v2.docx"]
    assert one(spark, files, "string", ids.manuscript_stem) == ["thesis", "my paper", "report", "draft", "essay", "essay", "v2"]
    assert one(spark, ["See 10.1000/AbC. and more", "Smith, J. (2020). Deep nets at it", "", None], "string", ids.verdict_key) == ["doi:10.1000/abc", "smith 2020 deep nets", "", ""]
    assert one(spark, ["https://doi.org/10.1/X.", "10.1/x", " DOI.org/10.1/x; "], "string", ids.merge_key) == ["10.1/x"] * 3
    forms = one(spark, ["A long title [Computer software]", "Titel der Arbeit [Title of the work]", "Short [x]", None], "string", ids.title_forms)
    assert [tuple(f) for f in forms] == [("A long title", None), ("Titel der Arbeit", "Title of the work"), ("Short [x]", None), ("", None)]
    pairs = [("10.1016/s0140-6736(20", "10.1016/s0140-6736(20)31180-6", True), ("https://doi.org/10.1/A.", "doi:10.1/a", True), ("10.18653/v1/N19-1423", "10.48550/arXiv.1810.04805", True), ("10.1/a", "10.1/b", False), (None, "10.1/a", False), ("", "", False)]
    assert [r.y for r in spark.createDataFrame(pairs, "a string, b string, w boolean").select(ids.same_doi(F.col("a"), F.col("b")).alias("y")).collect()] == [w for *_, w in pairs]
    same = [("thesis on graphs", "thesis on graphs_ch2", True), ("thesis", "thesis", True), ("short", "short_x", False), ("essay", "essay", False), (None, "a", False)]
    assert [r.y for r in spark.createDataFrame(same, "a string, b string, w boolean").select(ids.same_manuscript(F.col("a"), F.col("b")).alias("y")).collect()] == [w for *_, w in same]


def test_author_names(spark):
    from citeforge.functions.authors import author_key, author_list_score, author_match, corporate_keys, first_surname, fold_author, parse_authors

    names = ["Smith, J.", "J. Smith", "Smith et al.", "O'Connor", "WeiGuodong", "Jr., Brown", "Nguyễn, V. A.", "MacDonald", "", None]
    assert one(spark, names, "string", author_key) == ["smith", "smith", "smith", "oconnor", "wei", "brown", "nguyen", "macdonald", "", ""]
    assert one(spark, ["Łukasz Müller Jr.", "Đặng – Lê", "  Smith   III ", None], "string", fold_author) == ["lukasz muller", "dang-le", "smith", ""]
    lists = ["Smith, J.", "Smith, J. K.", "J. K. Smith", "van der Berg, J.", "O'Brien, M.", "Smith, John K.", "Smith J.", "Smith J. K.", "Doe", "Smith, J., & Jones, A.", "Smith, J.; Jones, A.", "Smith J., Jones A.", "LeCun, Y., Bengio, Y., & Hinton, G.", "Vaswani, A., Shazeer, N., et al.", "Smith JK, Lee A", "Trần, Gia Thành", "", None]
    got = [[(a["last"], ".".join(a["initials"])) for a in x] for x in one(spark, lists, "string", parse_authors)]
    assert got == [
        [("smith", "j")], [("smith", "j.k")], [("smith", "j.k")], [("van der berg", "j")], [("o'brien", "m")], [("smith", "j.k")], [("smith", "j")], [("smith", "j.k")], [("doe", "")],
        [("smith", "j"), ("jones", "a")], [("smith", "j"), ("jones", "a")], [("smith", "j"), ("jones", "a")], [("lecun", "y"), ("bengio", "y"), ("hinton", "g")], [("vaswani", "a"), ("shazeer", "n")], [("smith", "j.k"), ("lee", "a")], [("trần", "g.t")], [], [],
    ]
    assert one(spark, ["World Health Organization (WHO)", "WHO", "Centers for Disease Control and Prevention", "Jane Smith"], "string", lambda c: F.array_sort(corporate_keys(c))) == [["who", "world health organization"], ["who"], ["cdc", "cdcp", "centers disease control prevention"], []]
    rows = [(["Settles, B."], ["Settles, B.", "Other, A."], 1.0), (["WHO"], ["World Health Organization"], 1.0), (["Smith, J.", "Lee, A."], ["Smith, J.", "Kim, B."], 1 / 3), (["Lengleman"], ["Lengle"], 1.0), (["Smith"], ["Jones"], 0.0), ([], ["Jones"], 0.0), (["Smith, J.", "Editor, E."], ["Smith, J."], 1.0)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, w double")
    assert [r.y for r in df.select(author_list_score(F.col("a"), F.col("b")).alias("y")).collect()] == pytest.approx([w for *_, w in rows])
    over = [(["Smith, J.", "Lee, A."], ["A. Lee", "Kim", "Smith"], 1.0), (["L'Engle, M."], ["Lengleman"], 0.8), (["Smith"], [], 0.0), (["Smith, J."], ["Jones"], 0.0)]
    assert [r.y for r in spark.createDataFrame(over, "a array<string>, b array<string>, w double").select(author_match(F.col("a"), F.col("b")).alias("y")).collect()] == [w for *_, w in over]
    firsts = spark.createDataFrame([(["Smith, J."], None), (["Smith J."], None), (["J. Smith"], None), ([], "Brown, A. (2001)"), (None, "1. no"), (None, None)], "a array<string>, r string")
    assert [r.y for r in firsts.select(first_surname(F.col("a"), F.col("r")).alias("y")).collect()] == ["Smith", "Smith", "Smith", "Brown", None, None]


def test_guards(spark):
    from citeforge.functions import guards as g

    urls = ["https://example.com/x", "http://sub.test.com:80/", "http://127.0.0.1/a", "https://fake-portal.org", "https://www.placeholder-x.io", "https://notexample.com", "https://arxiv.org/abs/1", "", None]
    assert one(spark, urls, "string", g.fake_url) == [True] * 5 + [False] * 4
    dois = ["10.1234/fake1", "10.999/jmle", "10.5555/nonexistent.1", "10.0000/a", "10.5555/paper-12", "10.1038/nature14539", None]
    assert one(spark, dois, "string", g.fabricated_doi) == [True] * 5 + [False] * 2
    none = F.lit(None).cast("array<string>")
    raws = ["Fictional Scholar (2020). A title.", "Unknown (2019). Things", "Smith, J. (2020). The unknown author and fake research.", "Test Author et al. 2021", None, ""]
    assert one(spark, raws, "string", lambda c: g.fake_author(c, none)) == [True, True, False, True, False, False]
    kinds = ["ISO/IEC 27001 standard", "Plato, Republic", "A PhD thesis, X University", "An imaginary PhD thesis", "Knuth, MIT Press", "Journal of Things, 3(2), 1-9. MIT Press", "Nghị định 13/2023", "Plain words", ""]
    assert one(spark, kinds, "string", lambda c: g.source_kind(c, F.lit(None).cast("string"), F.lit(None).cast("string"))) == ["legal_or_standard", "classical_or_scriptural", "thesis_or_report", None, "book_or_monograph", None, "legal_or_standard", None, None]
    assert one(spark, ["https://blog.site/x", "https://doi.org/10.1/x", None], "string", lambda c: g.source_kind(F.lit("A page"), c, F.lit(None).cast("string"))) == ["web_resource", None, None]
    assert one(spark, ["Vaswani, A. (2017). Attention", "Smith (2017). On Vaswani", None], "string", lambda c: g.known_author(c, none)) == [True, False, False]
    rows = [("The book", ["Knuth"], "Book Review: The book", ["Lee"], True), ("The book", ["Knuth"], "On the book by Knuth", ["Lee"], True), ("A review of books", ["Knuth"], "Book review", ["Lee"], False), ("The book", ["Knuth"], "The book", ["Knuth"], False), (None, None, "", None, False)]
    df = spark.createDataFrame(rows, "t string, a array<string>, u string, b array<string>, w boolean")
    assert [r.y for r in df.select(g.book_review_mismatch(*[F.col(c) for c in "taub"]).alias("y")).collect()] == [w for *_, w in rows]


def test_occurrences(spark):
    from citeforge.operators.extraction import context, occurrences, own_spans, parse_entry, reference_entries, sections

    text = "Some claim (Smith, 2020). Jones et al. (2019) and [1, 2] and [3-5], in (May 2012), see (42, 2024).\n[9] Fellegi, I. (1969). A theory.\n[14] show that. 10.1038/nature14539."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "plain text [0] (x) only")], "doc_id int, text string")
    got = occurrences(df).orderBy("doc_id", "pos").collect()
    assert [(r.raw, r.pattern) for r in got] == [("(Smith, 2020)", "apa_intext_parenthetical"), ("Jones et al. (2019)", "apa_intext_narrative"), ("[1, 2]", "ieee_numeric"), ("[3-5]", "ieee_numeric"), ("(1969)", "numeric_parenthesized"), ("[14]", "ieee_numeric"), ("10.1038/nature14539", "doi")]
    assert all(text[r.start : r.end].startswith(r.raw) for r in got) and [r.year for r in got[:2]] == ["2020", "2019"] and got[-1].doi == "10.1038/nature14539" and got[0].confidence == 0.25
    spans = [(1, 0, 10, 1), (1, 5, 12, 0), (1, 11, 20, 2), (1, 30, 40, 1), (2, 0, 10, 1), (1, 300, 900, 3), (1, 700, 710, 4)]
    left = own_spans(spark.createDataFrame(spans, "doc_id int, start int, end int, priority int"))
    assert sorted(map(tuple, left.collect())) == [(1, 5, 12, 0), (1, 30, 40, 1), (1, 300, 900, 3), (2, 0, 10, 1)]
    doc = "Intro\nReferences are good\nBody\nREFERENCES\n[1] A, B. (2001). T. V.\nmore of it\n[2] C, D. (2002). U. W.\nAppendix A\nx"
    lines = sections(spark.createDataFrame([(1, doc), (2, "only body"), (3, "a\nb\n[1] x y\n[2] x y\n[3] x y"), (4, None)], "doc_id int, text string"))
    assert {(r.doc_id, r.section): r.n for r in lines.groupBy("doc_id", "section").agg(F.count("*").alias("n")).collect()} == {(1, "body"): 3, (1, "bibliography"): 4, (1, "appendix"): 2, (2, "body"): 1, (3, "body"): 2, (3, "bibliography"): 3, (4, "body"): 1}
    entries = reference_entries(lines.where("section = 'bibliography' and doc_id = 1").select("doc_id", "line", "text")).orderBy("entry").collect()
    assert [(r.marker, r.raw) for r in entries] == [(1, "A, B. (2001). T. V. more of it"), (2, "C, D. (2002). U. W.")]
    hanging = spark.createDataFrame([(1, 0, "Smith, J. (2001). One."), (1, 1, "goes on"), (1, 2, "Tran, A. (2002). Two.")], "doc_id int, line int, text string")
    assert [r.raw for r in reference_entries(hanging).orderBy("entry").collect()] == ["Smith, J. (2001). One. goes on", "Tran, A. (2002). Two."]
    assert one(spark, ["no entry at all", None], "string", lambda c: parse_entry(c)["style"]) == [None, None]
    words = " ".join(f"word{i}" for i in range(60))
    ctx = spark.createDataFrame([(words, 200, 205)], "t string, a int, b int").select(context(F.col("t"), F.col("a"), F.col("b"), 20, 10).alias("y")).first().y
    assert words[180:225] in ctx and all(w in words.split() for w in ctx.split())


def test_similar_references_against_the_greedy_scan(spark):
    from citeforge.operators.duplicates import similar_references

    titles = ["a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i z", "a b c d e f g h y z", "q r s t u v w x y z", "a b c d e f g h i j"]
    rows = [(1, i, i, ["Smith, J."] if i != 5 else ["Smithe, J."], None, t, 2001 if i != 9 else 1999) for i, t in enumerate(titles)]
    sim = lambda x, y: 0.2 + (0.4 if x[3] == y[3] else 0.3) + 0.4 * len(set(x[5].split()) & set(y[5].split())) / len(set(x[5].split()) | set(y[5].split()))
    leader, used = {}, set()
    for a in rows:
        if a[1] in used:
            continue
        group = [a] + [b for b in rows if b[2] > a[2] and b[1] not in used and sim(a, b) >= 0.92]
        if len(group) > 1:
            used |= {b[1] for b in group}
            leader |= {b[1]: a[1] for b in group}
    got = {r.reference_id: r.leader_id for r in similar_references(spark.createDataFrame(rows, "doc_id int, reference_id int, order_index int, authors array<string>, raw string, title string, year int")).collect()}
    assert got == leader and len(got) == 3
    with pytest.raises(ValueError):
        similar_references(spark.createDataFrame(rows, "doc_id int, reference_id int, order_index int, authors array<string>, raw string, title string, year int"), 0.8)


def test_rules_by_hand(spark):
    """Outcomes written out from the rules' definitions, not from the tables that the engine reads."""
    from citeforge.operators.rules import classify

    base = dict(has_candidate=True, has_doi=False, doi_exact_match=False, title_sim=0.0, author_sim=0.0, year_distance=999, consensus=0)
    cases = [
        (dict(has_candidate=False), "unresolved", 0.5, "R-NO-CANDIDATE"),
        (dict(doi_exact_match=True, title_sim=0.95, author_sim=0.6, year_distance=0), "verified", 0.95, "R-DOI-TITLE-AUTHOR"),
        (dict(consensus=2, title_sim=0.95, author_sim=0.6, year_distance=1), "verified", 0.8, "R-CONSENSUS-FULL"),
        (dict(consensus=2, title_sim=0.95, author_sim=0.6, year_distance=10), "metadata_error", 0.65, "R-CONSENSUS-PARTIAL"),
        (dict(title_sim=0.92, author_sim=0.9, year_distance=0, consensus=1), "verified", 0.78, "R-SINGLE-SOURCE-VERIFIED"),
        (dict(title_sim=0.5, author_sim=0.9), "unresolved", 0.5, "R-ABSTENTION-BORDER"),
        (dict(title_sim=0.44, author_sim=0.9), "unresolved", 0.44, "R-ABSTENTION-BORDER"),
        (dict(doi_exact_match=True, title_sim=0.3, consensus=2), "metadata_error", 0.5, "R-DOMAIN-EXCEPTION"),
        (dict(title_sim=0.1, author_sim=0.1), "suspected_hallucination", 0.8, "R-HALLUCINATED-SOURCE"),
        (dict(title_sim=0.7), "unresolved", 0.4, "R-WEAK-EVIDENCE"),
    ]
    df = spark.createDataFrame([tuple((base | c[0]).values()) for c in cases], "has_candidate boolean, has_doi boolean, doi_exact_match boolean, title_sim double, author_sim double, year_distance int, consensus int")
    got = [(r.label, round(r.confidence, 9), r.rule) for r in classify(df).collect()]
    assert got == [c[1:] for c in cases]


def test_alignment_and_order(spark):
    from citeforge.functions.alignment import alignment, stance
    from citeforge.functions.ordering import collation_key

    names = ["An", "Anh", "Ánh", "Ăn", "Ấn", "Bình", "Dung", "Đăng", "Em", "Ông", "Ở", "Uy", "Ưng", "Xuân"]
    keys = dict(zip(names, one(spark, names, "string", collation_key)))
    assert all(tuple(map(tuple, keys[a])) < tuple(map(tuple, keys[b])) for a, b in itertools.pairwise(names))
    rows = [(0.5, 0.0, 0.0, 0.0, 0.5), (0.2, 0.8, 0.0, 0.0, 0.736), (0.4, 0.4, 0.9, 0.0, 0.81)]
    df = spark.createDataFrame(rows, "t double, a double, s double, b double, w double")
    got = [r.y for r in df.select(alignment(*[F.col(c) for c in "tasb"])["score"].alias("y")).collect()]
    assert got == pytest.approx([r[-1] for r in rows], abs=1e-9)
    said = [("it guarantees success", "it cannot do that", 0.6, "contradiction_risk"), ("it is used", "it is used", 0.6, "supported"), ("it", "x", 0.4, "partially_supported"), ("it", "x", 0.1, "neutral"), ("", "x", 0.9, "neutral")]
    df = spark.createDataFrame(said, "s string, e string, v double, w string")
    assert [r.y for r in df.select(stance(F.col("s"), F.col("e"), F.col("v"), F.lit(None).cast("string"), F.lit(False)).alias("y")).collect()] == [w for *_, w in said]


def test_bootstrap_and_search(spark):
    from citeforge.operators.catalog_more import bootstrap, paper_predicate
    from citeforge.operators.routing import enrich, needs_second_round
    from citeforge.operators.search import fuzzy_search, title_ladder

    rows = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("double").alias("v"))
    b = bootstrap(rows, F.col("v"), "id")
    r = b.first()
    assert abs(r.mean - 0.25) < 1e-12 and 0.22 < r.low < 0.25 < r.high < 0.28 and tuple(bootstrap(rows, F.col("v"), "id").first()) == tuple(r)
    pairs = [("Deep Learning.", "deep learning", 1.0), ("Art of code", "Art of code, 2nd edition", 0.98), ("Attention is all", "Attention is all: a study of it", 0.95), ("", "x", 0.0), (None, "x", 0.0), ("Scikit-learn tools", "Scikitlearn tools", 1.0)]
    got = [x.y for x in spark.createDataFrame(pairs, "a string, b string, w double").select(title_ladder(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got == [w for *_, w in pairs]
    papers = spark.createDataFrame([(1, "graph kernels for text", ["Smith, J."], 2001), (2, "graph kernels for images", ["Lee, A."], 2001), (3, "kernels for text", ["Smith, J."], 2010)], "id int, title string, authors array<string>, year int")
    cites = spark.createDataFrame([(1, "Graph kernels for text", ["Smith"], 2002), (2, "Graphs kernels for text", ["Smith"], 2002), (3, "nothing like it", ["Smith"], 2001), (4, "kernels for text", ["Lee"], 2001)], "citation_id int, title string, authors array<string>, year int")
    assert [(x.citation_id, x.id) for x in fuzzy_search(cites, papers, least=0.5).orderBy("citation_id", "rank").collect()] == [(1, 1), (2, 1)]
    fits = [("Deep nets", ["A. Smith"], 2001, "deep", ["smith"], 2002, True), ("Deep nets", ["A. Smith"], 2001, "shallow", None, None, False), ("Deep nets", ["A. Smith"], 2001, None, ["lee"], None, False), ("Deep nets", None, 2001, None, ["lee"], 2005, False)]
    df = spark.createDataFrame(fits, "t string, a array<string>, y int, u string, b array<string>, z int, w boolean")
    assert [x.y for x in df.select(paper_predicate(*[F.col(c) for c in "tayubz"]).alias("y")).collect()] == [w for *_, w in fits]
    plan = spark.createDataFrame([(1, ["crossref", "openalex"], ["doaj"]), (2, ["crossref", "openalex"], ["doaj", "dblp"])], "citation_id int, first array<string>, second array<string>")
    answers = spark.createDataFrame([(1, s, True, 0.9, 0.9, 0, False) for s in ("crossref", "openalex")] + [(2, "crossref", True, 0.9, 0.9, 5, False)], "citation_id int, source_name string, found boolean, title_sim double, author_sim double, year_distance int, doi_match boolean")
    assert sorted(map(tuple, needs_second_round(plan, answers).collect())) == [(2, "dblp"), (2, "doaj")]
    cand = spark.createDataFrame([(1, 0, True, 0.9, 0.8, ""), (1, 1, True, 0.9, 0.5, "long text"), (1, 2, True, 0.2, 0.9, "a far longer text")], "citation_id int, seq int, found boolean, title_sim double, confidence double, abstract string")
    assert [tuple(x) for x in enrich(cand).collect()] == [(1, "long text")]


def test_every_way_of_linking(spark):
    from citeforge.operators.cascade import METHODS, link_all

    refs = [
        (1, 1, 1, 1, "Smith", "2001", "", "10.1000/AB", "One study of things"), (1, 2, 2, 2, "Jones", "2002", "a", None, "Two studies"), (1, 3, 3, 3, "Jones", "2002", "b", None, "Three studies"), (1, 4, 4, 4, "Nguyễn", "2010", "", None, None),
        (1, 5, 5, 5, "World Health Organization", "2015", "", None, "Report on health"), (1, 6, 6, 6, "Keller", "1999", "", None, "A very long title of words"), (1, 7, 7, 7, "Undated", None, "", None, "X"),
    ]
    occ = [
        (0, "(Smith, 2001)", 6, None), (1, "10.1000/ab", None, None), (2, "[2, 3]", None, None), (3, "(Jones, 2002b; Smith, 2001)", None, None), (4, "(Nguyen, 2010)", None, None), (5, "(Kellar, 1999)", None, None), (6, "(Keller, 2004)", None, None),
        (7, "(Keller 25-27)", None, None), (8, "(WHO, 2015)", None, None), (9, "“A very long title of the words”", None, "A very long title of words"), (10, "Ibid., 12", None, None), (11, "(Nobody, 1950)", None, None), (12, "(Undated, 2000)", None, None), (13, "ibid.", None, None),
    ]
    o = spark.createDataFrame([(1, *x) for x in occ], "doc_id long, pos int, raw string, parser_id long, title string")
    r = spark.createDataFrame(refs, "doc_id long, reference_id long, order_index int, numeric_index int, author string, year string, suffix string, doi string, title string")
    texts = spark.createDataFrame([(1, "The World Health Organization (WHO) says so.")], "doc_id long, text string")
    got = {}
    for x in link_all(o, r, texts).collect():
        got.setdefault((x.pos, x.method), []).append(x.reference_id)
        assert x.confidence == METHODS[x.method]
    assert {k: sorted(v) for k, v in got.items()} == {
        (0, "parser"): [6], (1, "doi"): [1], (2, "numeric"): [2, 3], (3, "author_year"): [1, 3], (4, "fuzzy_author_year"): [4], (5, "fuzzy_author_year"): [6], (6, "fuzzy_author_year"): [6], (7, "author_page"): [6], (8, "organisation"): [5],
        (9, "title"): [6], (10, "ibid"): [6], (12, "fuzzy_author_year"): [7], (13, "ibid"): [7],
    }
    assert link_all(o.where("false"), r).count() == 0 and link_all(o.drop("parser_id", "title"), r.where("false")).count() == 0
