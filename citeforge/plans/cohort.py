"""Queries over classes, revisions, splits, references and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normalize import author_overlap, blend, sentences
from ..functions.render import apa, bibtex, ris
from ..operators import evaluation as ev
from ..operators.catalog import hashed_sample, page
from ..operators.revisions import class_members, diff, previous
from ..operators.rules import classify
from ..sources.tables import ESSAYS, LOG, PAPERS, PREDICTIONS, VERDICTS, essays, papers, predictions, query_log, table, verdicts
from ..streaming.log import windows
from . import analysis


def class_scores(spark, d):
    """Mean essay score of each class and its essays by score band; an essay without verdicts scores 0."""
    score = F.expr("100 * count_if(label = 'verified' or is_overridden) div count(*)")
    e = essays(spark, d).join(verdicts(spark, d).groupBy("essay_id").agg(score.alias("score")), "essay_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    band = lambda lo, hi: F.count_if(F.col("score").between(lo, hi - 1))
    return e.groupBy("class_id").agg(F.count("*").alias("essays"), F.avg("score").alias("mean_score"), band(85, 101).alias("excellent"), band(70, 85).alias("good"), band(50, 70).alias("fair"), band(0, 50).alias("poor"))


def top_rules(spark, d):
    return classify(analysis._features(spark, d)).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(8)


def shared_flagged(spark, d):
    """The ten suspected citations that most students share."""
    flagged = verdicts(spark, d).where("label = 'suspected_hallucination' and not is_overridden").select("essay_id", "key")
    per = flagged.join(essays(spark, d).select("essay_id", "user_id"), "essay_id").groupBy("key").agg(F.countDistinct("user_id").alias("students"), F.countDistinct("essay_id").alias("essays"))
    return per.where("students > 1").orderBy(F.desc("students"), "key").limit(10)


def students_per_class(spark, d):
    """Zero for the classes that nobody is in."""
    per = essays(spark, d).groupBy("class_id").agg(F.countDistinct("user_id").alias("n"))
    return spark.range(25).select(F.col("id").alias("class_id")).join(per, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("students"))


def revision_diff(spark, d):
    """For each essay with one before it by the same student: citations by what became of their label."""
    e = essays(spark, d)
    lines = verdicts(spark, d).select("essay_id", (F.col("key") % 50).alias("key"), "line", "label")
    return diff(previous(e, ["user_id"], ["uploaded_at", "essay_id"], "essay_id"), lines).groupBy("essay_id", "change").agg(F.count("*").alias("n"))


def class_essays(spark, d):
    """Essays of each class: those handed in for it, and those for none whose student is in it."""
    e = essays(spark, d).select("essay_id", "user_id", F.when(F.col("essay_id") % 3 != 0, F.col("class_id")).alias("class_id"))
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 20).alias("class_id"))
    return class_members(e, members)


def stratified_split(spark, d):
    return ev.hashed_split(predictions(spark, d).select("id", "y"), "id")


def _split(spark, d):
    return ev.stratified_split(papers(spark, d).select("id", "source"), "id", "source")


def audited_split(spark, d):
    """Each paper's split, exact shares of every source."""
    return _split(spark, d)


def split_overlaps(spark, d):
    """Rows and keys of each split of the papers, and keys that another one has too."""
    return ev.split_audit(_split(spark, d), "id")


def threshold_tuner(spark, d):
    return ev.threshold_metrics(predictions(spark, d), [500, 600, 700, 800, 900, 950])


def blended_confidence(spark, d):
    model = (F.col("id") * 31 % 1000) / 1000.0
    return predictions(spark, d).select("id", blend(F.col("p"), model).alias("blended"))


def reference_order(spark, d):
    """Entries of each list, and how many stand before one that should precede them."""
    before = F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("essay_id"), (F.col("l_suppkey") < before).alias("wrong"))
    return entries.groupBy("essay_id").agg(F.count("*").alias("entries"), F.count_if("wrong").alias("violations"))


def paper_page(spark, d):
    return page(papers(spark, d).select("id", "title", "year"), [F.desc("year"), "id"], 20, 10)


def paper_sample(spark, d):
    return hashed_sample(papers(spark, d).select("id", "title"), "id", 7, 20)


def author_match(spark, d):
    """Each paper's authors against the next one's."""
    p = papers(spark, d).select("id", "authors")
    got = p.join(p.select((F.col("id") - 1).alias("id"), F.col("authors").alias("other")), "id").select("id", author_overlap(F.col("authors"), F.col("other")).alias("m"))
    return got.select("id", "m.score", *[F.array_join(f"m.{c}", ",").alias(c) for c in ("matched", "only_cited", "only_candidate")])


def document_sentences(spark, d):
    s = table(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def bibliography(spark, d):
    cells = [F.col(c) for c in ("id", "doi", "title", "authors", "year")]
    return papers(spark, d).select("id", bibtex(*cells).alias("bibtex"), apa(*cells[1:]).alias("apa"), ris(*cells[1:]).alias("ris"))


def log_windows(spark, d):
    return windows(query_log(spark, d)).select("source", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n", "hits")


def source_status(spark, d):
    """What each source gave for each tenth of the papers."""
    per = query_log(spark, d).groupBy((F.col("paper_id") % 10).alias("part"), "source").agg(F.count("*").alias("n"), F.sum("found").alias("hits"))
    missed = (F.col("n") - F.col("hits")).cast("string")
    return per.select("part", "source", F.when(F.col("hits") == F.col("n"), "ok").when(F.col("hits") == 0, F.concat(F.lit("failed:"), missed)).otherwise(F.concat(F.lit("partial:"), missed)).alias("status"))


def cited_positions(spark, d):
    """How often and where the text of a document cites each reference."""
    got = analysis._cascade(spark, d).groupBy("doc_id", "reference_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("at"))
    return got.select("doc_id", "reference_id", "n", F.array_join(F.col("at").cast("array<string>"), ",").alias("positions"))


QUERIES = {f.__name__: f for f in (class_scores, top_rules, shared_flagged, students_per_class, revision_diff, class_essays, stratified_split, audited_split, split_overlaps, threshold_tuner, blended_confidence, reference_order, paper_page, paper_sample, author_match, document_sentences, bibliography, log_windows, source_status, cited_positions)}

_A, _B = ("list_filter({}.authors, lambda x: x IS NOT NULL)".format(t) for t in "pb")

_SPLIT = f"""WITH {PAPERS}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(id AS VARCHAR)), id) AS r, count(*) OVER (PARTITION BY source) AS n FROM papers),
        s AS (SELECT id, source, CASE WHEN r <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS split FROM r)"""

ORACLE_SQL = {
    "class_scores": f"""WITH {ESSAYS}, {VERDICTS}, v AS (SELECT essay_id, (100 * count_if(label = 'verified' OR is_overridden)) // count(*) AS s FROM verdicts GROUP BY 1),
        e AS (SELECT class_id, CAST(coalesce(s, 0) AS BIGINT) AS s FROM essays LEFT JOIN v USING (essay_id))
        SELECT class_id, count(*) AS essays, avg(s) AS mean_score, count(*) FILTER (s >= 85) AS excellent, count(*) FILTER (s >= 70 AND s < 85) AS good, count(*) FILTER (s >= 50 AND s < 70) AS fair, count(*) FILTER (s < 50) AS poor FROM e GROUP BY class_id""",
    "top_rules": f"SELECT rule, count(*) AS n FROM ({analysis.ORACLE_SQL['rule_labels']}) GROUP BY rule ORDER BY n DESC, rule LIMIT 8",
    "shared_flagged": f"""WITH {ESSAYS}, {VERDICTS} SELECT key, count(DISTINCT user_id) AS students, count(DISTINCT essay_id) AS essays FROM verdicts JOIN essays USING (essay_id)
        WHERE label = 'suspected_hallucination' AND NOT is_overridden GROUP BY key HAVING count(DISTINCT user_id) > 1 ORDER BY students DESC, key LIMIT 10""",
    "students_per_class": f"WITH {ESSAYS} SELECT c AS class_id, count(DISTINCT user_id) AS students FROM range(25) t(c) LEFT JOIN essays ON class_id = c GROUP BY c",
    "revision_diff": f"""WITH {ESSAYS}, {VERDICTS}, e AS (SELECT essay_id, lag(essay_id) OVER (PARTITION BY user_id ORDER BY uploaded_at, essay_id) AS prev FROM essays),
        k AS (SELECT essay_id AS of_id, key % 50 AS key, max(struct_pack(line := line, label := label)).label AS label FROM verdicts GROUP BY 1, 2),
        c AS (SELECT essay_id, key, label FROM e JOIN k ON of_id = essay_id WHERE prev IS NOT NULL), p AS (SELECT essay_id, key, label AS was FROM e JOIN k ON of_id = prev)
        SELECT essay_id, CASE WHEN was IS NULL THEN 'added' WHEN label IS NULL THEN 'removed' WHEN label = was THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM c FULL JOIN p USING (essay_id, key) GROUP BY ALL""",
    "class_essays": f"""WITH {ESSAYS}, e AS (SELECT essay_id, user_id, CASE WHEN essay_id % 3 <> 0 THEN class_id END AS class_id FROM essays), m AS (SELECT c_custkey AS user_id, c_custkey % 20 AS class_id FROM customer)
        SELECT DISTINCT essay_id, m.class_id FROM e JOIN m ON e.class_id = m.class_id OR (e.class_id IS NULL AND e.user_id = m.user_id)""",
    "audited_split": _SPLIT + " SELECT id, source, split FROM s",
    "split_overlaps": _SPLIT + ", k AS (SELECT id, count(DISTINCT split) AS many FROM s GROUP BY id) SELECT split, count(*) AS n, count(DISTINCT id) AS keys, count(DISTINCT CASE WHEN many > 1 THEN id END) AS shared FROM s JOIN k USING (id) GROUP BY split",
    "stratified_split": f"WITH {PREDICTIONS}, h AS (SELECT id, y, substr(md5(CAST(id AS VARCHAR)), 1, 4) AS h FROM predictions) SELECT id, y, CASE WHEN h < 'b333' THEN 'train' WHEN h < 'd99a' THEN 'validation' ELSE 'test' END AS split FROM h",
    "threshold_tuner": f"""WITH {PREDICTIONS}, c AS (SELECT t AS threshold, count(*) FILTER (round(p * 1000) >= t AND y = 1) AS tp, count(*) FILTER (round(p * 1000) >= t AND y = 0) AS fp,
            count(*) FILTER (round(p * 1000) < t AND y = 0) AS tn, count(*) FILTER (round(p * 1000) < t AND y = 1) AS fn FROM predictions, (VALUES (500), (600), (700), (800), (900), (950)) v(t) GROUP BY t)
        SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision_, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall_, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c""",
    "blended_confidence": f"""WITH {PREDICTIONS}, m AS (SELECT id, p, (id * 31 % 1000) / 1000.0 AS q FROM predictions), a AS (SELECT *, CASE WHEN abs(p - q) > 0.45::DOUBLE AND p >= 0.85::DOUBLE THEN 0.9::DOUBLE ELSE 0.72::DOUBLE END AS a FROM m)
        SELECT id, a * p + (1 - a) * q AS blended FROM a""",
    "reference_order": """WITH w AS (SELECT l_orderkey AS essay_id, l_suppkey < lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS wrong FROM lineitem)
        SELECT essay_id, count(*) AS entries, count(*) FILTER (wrong) AS violations FROM w GROUP BY essay_id""",
    "paper_page": f"WITH {PAPERS} SELECT id, title, year FROM papers ORDER BY year DESC, id LIMIT 10 OFFSET 20",
    "paper_sample": f"WITH {PAPERS} SELECT id, title FROM papers ORDER BY md5(CAST(id AS VARCHAR) || '-7'), id LIMIT 20",
    "author_match": f"""WITH {PAPERS}, m AS (SELECT p.id, list_distinct({_A}) AS a, list_distinct({_B}) AS b FROM papers p JOIN papers b ON b.id = p.id + 1)
        SELECT id, coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0.0) AS score, array_to_string(list_sort(list_intersect(a, b)), ',') AS matched,
            array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_cited, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_candidate FROM m""",
    "document_sentences": r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+([ \t\n\r]+|$)|\n+'), lambda x: length(trim(x)) >= 25) AS s FROM documents)
        SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s""",
    "bibliography": f"""WITH {PAPERS} SELECT id, concat_ws(chr(10), '@article{{paper' || id || ',', '  title = {{' || title || '}},', '  author = {{' || array_to_string(authors, ' and ') || '}},', '  year = {{' || year || '}},', '  doi = {{' || doi || '}},', '}}') AS bibtex,
        concat_ws(' ', array_to_string(authors, ', '), '(' || year || ').', title || '.', 'https://doi.org/' || doi) AS apa,
        concat_ws(chr(10), 'TY  - JOUR', 'AU  - ' || array_to_string(authors, chr(10) || 'AU  - '), 'TI  - ' || title, 'PY  - ' || year, 'DO  - ' || doi, 'ER  - ') AS ris FROM papers""",
    "log_windows": f"WITH {LOG} SELECT source, strftime(date_trunc('hour', queried_at), '%Y-%m-%d %H') AS hour, count(*) AS n, CAST(sum(found) AS BIGINT) AS hits FROM log GROUP BY ALL",
    "source_status": f"""WITH {LOG}, s AS (SELECT paper_id % 10 AS part, source, count(*) AS n, CAST(sum(found) AS BIGINT) AS hits FROM log GROUP BY ALL)
        SELECT part, source, CASE WHEN hits = n THEN 'ok' WHEN hits = 0 THEN 'failed:' || (n - hits) ELSE 'partial:' || (n - hits) END AS status FROM s""",
    "cited_positions": f"WITH {analysis._LINKS}, u AS (SELECT DISTINCT doc_id, pos, reference_id FROM links) SELECT doc_id, reference_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM u GROUP BY doc_id, reference_id",
}
