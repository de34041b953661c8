"""Queries over classes, members and essays, and counts of the whole system."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import csv_guard
from ..sources.tables import ESSAYS, LOG, PAPERS, VERDICTS, essays, papers, query_log, table, verdicts

# Sources that statistics list even if they gave nothing.
SOURCES = ("click", "error", "view", "purchase", "crossref", "openalex")


def system_counts(spark, d):
    """Rows by kind and value: users by role, essays, verdicts by label, and the range of paper ids."""
    e, v = essays(spark, d), verdicts(spark, d)
    role = F.when(F.col("user_id") % 10 == 0, "teacher").otherwise("student")
    one = lambda df, kind, value, n: df.select(F.lit(kind).alias("kind"), value.alias("value"), n.cast("long").alias("n"))
    users = e.select("user_id").distinct().groupBy(role.alias("role")).agg(F.count("*").alias("n"))
    ids = papers(spark, d).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    parts = [one(users, "role", F.col("role"), F.col("n")), one(e.agg(F.count("*").alias("n")), "essays", F.lit(""), F.col("n")), one(v.groupBy("label").agg(F.count("*").alias("n")), "label", F.col("label"), F.col("n"))]
    parts += [one(ids, "paper_id", F.lit("least"), F.col("least")), one(ids, "paper_id", F.lit("most"), F.col("most"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_counts(spark, d):
    """Log rows and hits of each source, zero for listed sources that the log lacks."""
    log = query_log(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("found").alias("hits"))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source"))
    return listed.join(log, "source", "full_outer").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce(F.round(F.try_divide("hits", "n"), 2), F.lit(0.0)).alias("rate"))


def in_text_counts(spark, d):
    """In-text citations of each essay: verdict lines stand for citations of three types, two of which count."""
    return verdicts(spark, d).where("line % 3 < 2").groupBy("essay_id").agg(F.count("*").alias("n"))


def teacher_dashboard(spark, d):
    """Classes, students, essays and open reviews of each teacher, who has every fifth class."""
    e = essays(spark, d).withColumn("teacher_id", F.col("class_id") % 5)
    pending = verdicts(spark, d).where(~F.col("is_overridden") & F.col("label").isin("suspected_hallucination", "unresolved")).groupBy("essay_id").agg(F.count("*").alias("open"))
    return e.join(pending, "essay_id", "left").groupBy("teacher_id").agg(F.countDistinct("class_id").alias("classes"), F.countDistinct("class_id", "user_id").alias("students"), F.count("*").alias("essays"), F.coalesce(F.sum("open"), F.lit(0)).alias("pending"))


def class_export(spark, d):
    """Cells of a class's export: an essay without verdicts has a row of its own."""
    e = essays(spark, d).where("class_id = 3").select("essay_id", F.concat(F.lit("=essay"), "essay_id").alias("filename"), F.concat(F.lit("student"), "user_id").alias("student"))
    v = verdicts(spark, d)
    cell = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return e.join(v, "essay_id", "left").select(csv_guard(F.col("filename")).alias("filename"), csv_guard(F.col("student")).alias("student"), cell(F.col("line")).alias("verdict"), cell(csv_guard(F.col("label"))).alias("label"), F.when(F.col("line").isNull(), "").when(F.col("is_overridden"), "yes").otherwise("no").alias("overridden"))


def accessible_essays(spark, d):
    """How many essays each of the users 1 to 40 may read: own ones, all for an admin, those of own classes and their members for a teacher."""
    e = essays(spark, d).select("essay_id", "user_id", F.when(F.col("essay_id") % 3 > 0, F.col("class_id")).alias("class_id"))
    members = essays(spark, d).select("class_id", "user_id").distinct()
    viewer = spark.range(1, 41).select(F.col("id").alias("viewer"), F.when(F.col("id") == 1, "admin").when(F.col("id") % 4 == 0, "teacher").otherwise("student").alias("role"))
    classes = viewer.where("role = 'teacher'").join(members.select("class_id").distinct().withColumn("viewer", F.col("class_id") * 4 % 40 + 4), "viewer").select("viewer", "class_id")
    own = viewer.join(e, F.col("viewer") == F.col("user_id")).select("viewer", "essay_id")
    named = classes.join(e, "class_id").select("viewer", "essay_id")
    through = classes.join(members, "class_id").join(e.select("essay_id", "user_id"), "user_id").select("viewer", "essay_id")
    some = own.union(named).union(through).distinct().groupBy("viewer").agg(F.count("*").alias("some"))
    every = e.agg(F.count("*").alias("every"))
    return viewer.join(some, "viewer", "left").join(F.broadcast(every)).select("viewer", F.when(F.col("role") == "admin", F.col("every")).otherwise(F.coalesce("some", F.lit(0))).alias("n"))


def revision_deltas(spark, d):
    """How the labels of an essay changed from the student's essay before it."""
    label = lambda name: F.count_if(F.col("label") == name).alias(name)
    names = ["verified", "metadata_error", "suspected_hallucination", "unresolved"]
    from pyspark.sql import Window

    per = essays(spark, d).join(verdicts(spark, d).select("essay_id", "label"), "essay_id", "left").groupBy("essay_id", "user_id").agg(F.count("label").alias("total"), *[label(n) for n in names])
    before = Window.partitionBy("user_id").orderBy("essay_id")
    return per.select("essay_id", *[(F.col(n) - F.lag(n).over(before)).alias(n) for n in ("total", *names)]).where("total is not null")


def recent_share(spark, d):
    """The share of cited works of each class's essays from the five years before a given one."""
    v = verdicts(spark, d).select("essay_id", (2000 + F.col("key") % 24).alias("year"))
    return v.join(essays(spark, d).select("essay_id", "class_id"), "essay_id").groupBy("class_id").agg((F.count_if(F.col("year") >= 2023 - 5) / F.count("*")).alias("recent"), F.count("*").alias("n"))


def confusion(spark, d):
    """Counts by true and predicted class, of all pairs of classes."""
    from ..sources.tables import predictions

    p = predictions(spark, d).groupBy("y", "pred").agg(F.count("*").alias("n"))
    pairs = spark.range(4).select((F.col("id") % 2).cast("int").alias("y"), F.floor(F.col("id") / 2).cast("int").alias("pred"))
    return pairs.join(p, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro_scores(spark, d):
    """Accuracy and macro F1 of the predictions; an absent class counts as F1 0."""
    c = confusion(spark, d)
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    acc = c.agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    f1 = c.select("y", "pred", "n").withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("label").agg(F.sum(F.when((F.col("y") == F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("predicted"))
    macro = f1.agg(F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))).alias("macro_f1"))
    return acc.join(F.broadcast(macro))


def log_totals(spark, d):
    """Log rows by source and by found, with subtotals."""
    return query_log(spark, d).rollup("source", "found").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"))


QUERIES = {f.__name__: f for f in (system_counts, source_counts, in_text_counts, teacher_dashboard, class_export, accessible_essays, revision_deltas, recent_share, confusion, macro_scores, log_totals)}

_PRED = "p AS (SELECT quality AS y, CASE WHEN (doc_id * 7919 % 1000) >= 500 THEN 1 ELSE 0 END AS pred FROM labels)"

ORACLE_SQL = {
    "system_counts": f"""WITH {ESSAYS}, {VERDICTS}, {PAPERS} SELECT 'role' AS kind, CASE WHEN user_id % 10 = 0 THEN 'teacher' ELSE 'student' END AS value, count(DISTINCT user_id) AS n FROM essays GROUP BY 2 UNION ALL
        SELECT 'essays', '', count(*) FROM essays UNION ALL SELECT 'label', label, count(*) FROM verdicts GROUP BY 2 UNION ALL SELECT 'paper_id', 'least', min(id) FROM papers UNION ALL SELECT 'paper_id', 'most', max(id) FROM papers""",
    "source_counts": f"""WITH {LOG}, s AS (SELECT DISTINCT source FROM log UNION SELECT unnest([{', '.join(repr(s) for s in SOURCES)}]))
        SELECT s.source, count(log.id) AS n, coalesce(sum(found), 0)::BIGINT AS hits, coalesce(round(sum(found) / nullif(count(log.id), 0), 2), 0) AS rate FROM s LEFT JOIN log ON log.source = s.source GROUP BY 1""",
    "in_text_counts": f"WITH {VERDICTS} SELECT essay_id, count(*) AS n FROM verdicts WHERE line % 3 IN (0, 1) GROUP BY 1",
    "teacher_dashboard": f"""WITH {ESSAYS}, {VERDICTS} SELECT class_id % 5 AS teacher_id, count(DISTINCT class_id) AS classes, count(DISTINCT (class_id, user_id)) AS students, count(DISTINCT essays.essay_id) AS essays,
        count_if(coalesce(NOT is_overridden AND label IN ('suspected_hallucination', 'unresolved'), false)) AS pending FROM essays LEFT JOIN verdicts ON verdicts.essay_id = essays.essay_id GROUP BY 1""",
    "class_export": f"""WITH {ESSAYS}, {VERDICTS} SELECT '''=essay' || essays.essay_id AS filename, 'student' || user_id AS student, coalesce(line::VARCHAR, '') AS verdict, coalesce(label, '') AS label,
        CASE WHEN line IS NULL THEN '' WHEN is_overridden THEN 'yes' ELSE 'no' END AS overridden FROM essays LEFT JOIN verdicts ON verdicts.essay_id = essays.essay_id WHERE class_id = 3""",
    "accessible_essays": f"""WITH {ESSAYS}, e AS (SELECT essay_id, user_id, CASE WHEN essay_id % 3 > 0 THEN class_id END AS named FROM essays), m AS (SELECT DISTINCT class_id, user_id FROM essays),
        t AS (SELECT DISTINCT class_id * 4 % 40 + 4 AS viewer, class_id FROM essays)
        SELECT v AS viewer, count(e.essay_id) AS n FROM range(1, 41) u(v) LEFT JOIN e ON v = 1 OR e.user_id = v OR (v % 4 = 0 AND (e.named IN (SELECT class_id FROM t WHERE t.viewer = v)
            OR EXISTS (SELECT 1 FROM m JOIN t ON t.class_id = m.class_id WHERE t.viewer = v AND m.user_id = e.user_id))) GROUP BY 1""",
    "revision_deltas": f"""WITH {ESSAYS}, {VERDICTS}, c AS (SELECT essays.essay_id, user_id, count(label) AS total, count_if(coalesce(label = 'verified', false)) AS v, count_if(coalesce(label = 'metadata_error', false)) AS m, count_if(coalesce(label = 'suspected_hallucination', false)) AS h, count_if(coalesce(label = 'unresolved', false)) AS u
            FROM essays LEFT JOIN verdicts ON verdicts.essay_id = essays.essay_id GROUP BY ALL)
        SELECT a.essay_id, a.total - b.total AS total, a.v - b.v AS verified, a.m - b.m AS metadata_error, a.h - b.h AS suspected_hallucination, a.u - b.u AS unresolved
        FROM c a JOIN c b ON b.user_id = a.user_id AND b.essay_id = (SELECT max(essay_id) FROM c x WHERE x.user_id = a.user_id AND x.essay_id < a.essay_id)""",
    "recent_share": f"WITH {ESSAYS}, {VERDICTS} SELECT class_id, avg(CASE WHEN key % 24 >= 18 THEN 1 ELSE 0 END) AS recent, count(*) AS n FROM verdicts JOIN essays USING (essay_id) GROUP BY 1",
    "confusion": f"WITH {_PRED}, a AS (SELECT y.range::INTEGER AS y, q.range::INTEGER AS pred FROM range(0, 2) y, range(0, 2) q) SELECT a.y, a.pred, count(p.y) AS n FROM a LEFT JOIN p ON p.y = a.y AND p.pred = a.pred GROUP BY ALL",
    "macro_scores": f"""WITH {_PRED}, f AS (SELECT 2 * count_if(y = l AND pred = l) / nullif(count_if(y = l) + count_if(pred = l), 0) AS f1 FROM p, (VALUES (0), (1)) t(l) GROUP BY l)
        SELECT (SELECT avg(CASE WHEN y = pred THEN 1 ELSE 0 END) FROM p) AS accuracy, (SELECT avg(coalesce(f1, 0)) FROM f) AS macro_f1""",
    "log_totals": f"WITH {LOG} SELECT source, found, count(*) AS n, count(DISTINCT paper_id) AS papers FROM log GROUP BY ROLLUP (source, found)",
}
