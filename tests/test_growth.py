"""What reviews found to grow too fast: inputs read once, few rows met."""

import random

import duckdb
import pytest

from citeforge.operators.cascade import link_all
from citeforge.operators.linking import by_title
from citeforge.operators.merging import merge_lists
from citeforge.operators.notes import link_notes
from citeforge.operators.spans import find_spans
from citeforge.plans.matching import title_links
from citeforge.queries import ORACLE_SQL
from pyspark.sql import functions as F


def counted(df, column: str):
    """df, and how often a value of column has been made."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(same)(F.col(column))), n


def test_references_of_occurrences_are_made_once(spark):
    occurrences = spark.createDataFrame([(1, 0, "(Smith, 2001)"), (1, 1, "[2]"), (1, 2, "(Lee, 2003)")], "doc_id long, pos int, raw string")
    references, n = counted(spark.createDataFrame([(1, 0, 0, 1, "Smith", "2001", "", None, "One"), (1, 1, 1, 2, "Tran", "2002", "", None, "Two"), (1, 2, 2, 3, "Lee", "2003", "", None, "Three")], "doc_id long, reference_id long, order_index int, numeric_index int, author string, year string, suffix string, doi string, title string"), "author")
    got = link_all(occurrences, references).select("pos", "reference_id", "method").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, "author_year"), (1, 1, "numeric"), (2, 2, "author_year")]
    assert n.value == 3


def test_notes_and_references_are_made_once(spark):
    notes, n = counted(spark.createDataFrame([(1, 1, "Jane Smith, Rivers of Europe (Press, 1999), 12."), (1, 2, "Ibid., 14."), (1, 3, "Smith, op. cit., 25."), (1, 4, "See supra note 1, at 4.")], "doc_id long, note int, text string"), "text")
    references, m = counted(spark.createDataFrame([(1, 0, "Smith", "Rivers of Europe", None)], "doc_id long, reference_id long, author string, title string, doi string"), "title")
    got = link_notes(notes, references).select("note", "how").collect()
    assert sorted(tuple(r) for r in got) == [(1, "full"), (2, "ibid"), (3, "op_cit"), (4, "supra")]
    assert (n.value, m.value) == (4, 1)


def test_lists_of_parsers_are_made_once(spark):
    schema = "doc_id long, reference_id long, doi string, title string, year int, venue string, author string"
    left, n = counted(spark.createDataFrame([(1, 1, "10.1/a", "One", 2001, None, "Lee"), (1, 2, None, "Two tales", 2002, None, "Tran")], schema), "title")
    right, m = counted(spark.createDataFrame([(1, 7, "10.1/A", "Other", 2001, "V", "Lee"), (1, 8, None, "Two tales", 2002, "V", "Tran"), (1, 9, None, "Three", 2003, "V", "Ho")], schema), "title")
    got = merge_lists(left, right).select("left_id", "right_id").collect()
    assert sorted(tuple(r) for r in got if r[0]) == [(1, 7), (2, 8)] and len(got) == 3
    assert (n.value, m.value) == (2, 3)


def test_rows_that_repeat_a_document_link_by_title_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([1, 1, 2, 2])::BIGINT AS doc_id, unnest([4, 4, 3, 8])::BIGINT AS n_chars) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    keep = lambda rows: sorted((r[0], r[1], r[2], r[3]) for r in rows)
    got = title_links(spark, str(tmp_path)).select("doc_id", "pos", "reference_id", "score").collect()
    assert keep(got) == keep(con.execute(ORACLE_SQL["title_links"]).fetchall()) and got


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_titles_meet_as_in_a_comparison_of_all(spark, least):
    rng = random.Random(7)
    some = lambda: sorted(rng.sample("abcdefghijklmnop", rng.randint(1, 12)))
    left, right = [(i % 3, i, some()) for i in range(90)], [(i % 3, i, i, some()) for i in range(90)]
    right += [(d, 100 + p, 100 + p, w[: max(1, len(w) - p % 3)]) for d, p, w in left]
    want = {}
    for d, p, a in left:
        met = [(-len(set(a) & set(b)) / len(set(a) | set(b)), o, r) for e, r, o, b in right if d == e]
        score, _, r = min(met)
        if -score >= least:
            want[d, p] = (r, -score)
    got = by_title(spark.createDataFrame(left, "doc_id int, pos int, words array<string>"), spark.createDataFrame(right, "doc_id int, reference_id int, order_index int, words array<string>"), least).collect()
    assert {(r.doc_id, r.pos): (r.reference_id, r.score) for r in got} == want


def test_rules_of_lines_hold_however_they_are_spelt():
    with_rule, without = "Reference: so [4] goes", "Referred: so [4] goes"
    assert not list(find_spans(with_rule)) and [x[2] for x in find_spans(without)] == ["[4]"]
