"""What reviews found, each as a small table that failed before."""

import duckdb
import pytest

from citeforge.functions.alignment import argmax, logits
from citeforge.operators import discovery
from citeforge.operators.linking_fuzzy import acronyms
from citeforge.operators.routing import signals
from citeforge.plans.evidence import calibrated_labels
from citeforge.plans.passages import unmarked_entries
from citeforge.queries import ORACLE_SQL
from pyspark.sql import functions as F


def folder(tmp_path, select: str) -> str:
    duckdb.connect().execute(f"COPY ({select}) TO '{tmp_path}/documents.parquet'")
    return str(tmp_path)


def oracle(name: str, path: str) -> list:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    return sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def found(df) -> list:
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_scores_that_all_but_tie_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 1.0 + 2**-52],)], "f array<double>")
    assert df.select(argmax(logits(F.col("f"), [[1, 0], [0, 1]], [0, 0]), ["a", "b"])).first()[0] == "b"
    path = folder(tmp_path, "SELECT unnest([72720, 196236, 3])::BIGINT AS doc_id")
    assert found(calibrated_labels(spark, path)) == oracle("calibrated_labels", path)


def test_small_words_before_a_name_are_not_its_own(spark):
    rows = [(1, "and On The The The World Health Organization (WHO) said."), (2, "by De La Salle University (SU) they"), (3, "The World Health Organization (WHO)")]
    got = {tuple(r) for r in acronyms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "world health organization", "who"), (2, "de la salle university", "su"), (2, "salle university", "su"), (3, "world health organization", "who")} <= got
    assert [r for r in got if r[0] == 3] == [(3, "world health organization", "who")]


def test_windows_with_the_title_take_no_place_of_others():
    # Nine windows hold the title itself and are out; what is left has one word of it.
    head = "alpha bravo charlie delta echo"
    lows = [f"{head} foxtrot {i} and more" for i in range(9)] + ["foxtrot alone"]
    index = {}
    for i, p in enumerate(lows):
        for w in discovery._words(p):
            index.setdefault(w, []).append(i)
    hit = discovery._passage({"title": head + " foxtrot", "abstract": None, "authors": []}, list(range(10)), lows, index, [])
    assert hit and hit[0] == 9


def test_words_of_signals_go_on_over_any_letter(spark):
    df = spark.createDataFrame([("transformerñ",), ("neuralética, neuralón",), ("ñneural",)], "t string")
    none = F.lit(None).cast("string")
    assert [r[0] for r in df.select(signals(F.col("t"), none, none, none, none)["cs"]).collect()] == [True, True, False]


@pytest.mark.parametrize("first", ["ß", "ŉ", "ᾳ", "ﬁ", "ä", "ÿ"])
def test_first_letters_in_upper_case_as_sql_has_them(spark, tmp_path, first):
    path = folder(tmp_path, f"SELECT i::BIGINT AS doc_id, 30 + i AS n_chars, repeat('{first}ie word other more nine ten six ', 4) AS text FROM range(4) t(i)")
    got = found(unmarked_entries(spark, path))
    assert got and got == oracle("unmarked_entries", path)


def test_copies_of_titles_are_compared_once(spark, tmp_path):
    from citeforge.operators.search import _search, fuzzy_search, tokens

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, "One study of many things", ["Smith, J."], 2001) for i in range(150)] + [(200, "Another study of few things", ["Lee, A."], 2003), (201, "One study of many things", ["Smith, J."], 2009)]
    p = spark.createDataFrame(rows, "id long, title string, authors array<string>, year int")
    c = p.select(F.col("id").alias("citation_id"), "title", "authors", "year")
    got = sorted(tuple(r) for r in fuzzy_search(c, p, 3).select("citation_id", "rank", "id").collect())
    same = [(i, k + 1, k) for i in range(150) for k in range(3)]
    assert got == sorted(same + [(200, 1, 200), (201, 1, 201)])
    # No join meets a copy with a copy: its rows are those of kinds, not of their members.
    plan = _search(tokens(c, "citation_id"), tokens(p, "id"), 1, 0.7)
    assert plan.count() == 152
    assert "set" in tokens(p, "id").columns and tokens(p, "id").select("kind").distinct().count() == 3


def test_like_search_over_copies_and_empty_fields(spark):
    from citeforge.operators.catalog import like_search

    p = spark.createDataFrame([(1, "Deep Learning of Things", ["Smith"], 2001), (2, "Deep Learning of Things", ["Smith"], 2001), (3, "A deep learning of things, again", ["Lee"], None), (4, None, ["Lee"], 2001)], "id long, title string, authors array<string>, year int")
    q = spark.createDataFrame([(1, "learning OF", None, None), (2, "learning OF", None, None), (3, "learning of", "SMI", 2001), (4, "", None, None), (5, "earning of", None, None)], "query_id long, title string, author string, year int")
    assert sorted(tuple(r) for r in like_search(p, q).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]


def test_abstracts_are_made_without_a_shuffle(spark, tmp_path):
    from citeforge.plans.merges import restored_abstracts

    path = folder(tmp_path, """SELECT * FROM (VALUES (1::BIGINT, 'a b a "q" \\x c, ünd 7'), (1, 'other text of one id'), (3, 'broken one'), (5, 'with odd values'), (6, '  '), (8, NULL)) t(doc_id, text)""")
    df = restored_abstracts(spark, path)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted(rows, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert key(tuple(r) for r in df.collect()) == key(con.execute(ORACLE_SQL["restored_abstracts"]).fetchall())


def test_an_index_is_written_without_shuffling_texts(spark, tmp_path):
    from citeforge.operators import postings

    text = "common word of all texts " * 40
    docs = spark.createDataFrame([(i, f"{text} rare{i} also{i % 7}") for i in range(600)], "id long, text string").repartition(6).persist()
    docs.count()
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in [status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).apply(i) for i in range(status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).size())])
    before = written()
    postings.add(docs, f"{tmp_path}/i", block=50)
    # Only ids are dealt, to find those that repeat: some bytes each, where texts have a thousand.
    assert written() - before < 600 * 100
    # A further segment with an id that repeats: its rows are one document.
    postings.add(spark.createDataFrame([(1000, "twice told"), (1001, "told once"), (1000, "rare5 tale"), (None, "told")], "id long, text string").repartition(3), f"{tmp_path}/i", block=50)
    q = spark.createDataFrame([(1, "rare5 common"), (2, "twice tale"), (3, "told"), (4, "also3 word")], "query_id long, text string")
    got = sorted((r.query_id, r.rank, r.id) for r in postings.Index(spark, f"{tmp_path}/i").search(q, 3).collect())
    assert [g for g in got if g[0] < 4] == [(1, 1, 5), (2, 1, 1000), (3, 1, 1001), (3, 2, 1000)] and [g[2] for g in got if g[0] == 4] == [3, 10, 17]


def test_matches_of_frequent_words_are_not_shuffled(spark, tmp_path):
    from citeforge.operators import postings

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12) if (i * 31 + j * 17) % 5)) for i in range(3000)], "id long, text string").repartition(3)
    postings.add(docs, f"{tmp_path}/i", block=500)
    asked = spark.createDataFrame([(a * 100 + b * 10 + c, f"w{a} w{b} w{c}") for a in range(10) for b in range(10) for c in range(10)], "query_id long, text string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    records = lambda: sum(x.apply(i).shuffleWriteRecords() for x in [stages()] for i in range(x.size()))
    idle = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    idle()
    before = records()
    got = postings.Index(spark, f"{tmp_path}/i").search(asked, 3).collect()
    idle()
    # Each query matches more than a thousand texts. The queries have 220 different sets of words, and of each a task keeps three.
    assert records() - before < 220 * 3 * 12 + 2000
    assert len(got) == 1000 * 3 and {r["rank"] for r in got} == {1, 2, 3}
    assert sorted((r["rank"], r.id, r.score) for r in got if r.query_id == 123) == sorted((r["rank"], r.id, r.score) for r in got if r.query_id == 321)
