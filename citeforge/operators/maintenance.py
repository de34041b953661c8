"""Maintenance of the catalogue: rows without title and copies go, and the log points to what is left.

Copies are found by DOI, then by title and year among what is left, then curated rows fold onto the row that has
their DOI. Of copies the one that the log refers to most survives, references of earlier copies counted, then the smallest
id. Each step gives a table (id, survivor); a row that is dropped in favour of one that is dropped later
points to the last one, so chains are resolved and the log is rewritten once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import title_key
from ..functions.normalize import normalize_doi, present
from ..sources.store import written
from ..sources.versions import Versions


def _copies(papers: DataFrame, refs: DataFrame, key: Column) -> DataFrame:
    """(id, survivor) of the papers that share a key with a better one; refs: (id, refs)."""
    counted = papers.select("id", key.alias("key")).where("key is not null").join(refs, "id", "left").select("id", "key", F.coalesce("refs", F.lit(0)).alias("refs"))
    # The survivor is an aggregate, so a key with many papers is combined before the shuffle.
    best = counted.groupBy("key").agg(F.min_by("id", F.struct(-F.col("refs"), "id")).alias("survivor"), F.count("*").alias("n")).where("n > 1").drop("n")
    return written(counted.join(best, "key").where("id <> survivor").select("id", "survivor"), "maintenance-copies")


def _pointed(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """refs with those of dropped papers added to their survivors'."""
    return refs.join(gone, "id", "left").groupBy(F.coalesce("survivor", "id").alias("id")).agg(F.sum("refs").alias("refs"))


def dedupe(papers: DataFrame, log: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """papers (id, doi, title, year, source, ...) and log (paper_id, ...) after maintenance, and each step's (id, survivor).

    curated: (title, doi) of rows whose source is known_papers; one without a DOI of its own takes the curated one of its
    title, and folds onto the smallest live row that has it. A title alone never folds."""
    whole = papers.where(present(F.col("title")).isNotNull())
    empty = papers.where(present(F.col("title")).isNull()).select("id", F.lit(None).cast(papers.schema["id"].dataType).alias("survivor"))
    refs = written(log.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("refs")), "maintenance-refs")
    by_doi = _copies(whole, refs, F.lower(present(F.col("doi"))))
    left = whole.join(by_doi.select("id"), "id", "left_anti")
    by_title = _copies(left, _pointed(refs, by_doi), F.concat_ws("|", F.lower(F.trim("title")), F.coalesce("year", F.lit(-1)).cast("string")))
    left = left.join(by_title.select("id"), "id", "left_anti")
    known = curated.select(title_key(F.col("title")).alias("key"), normalize_doi(F.col("doi")).alias("known_doi")).where("key <> '' and known_doi is not null").groupBy("key").agg(F.min("known_doi").alias("known_doi"))
    asked = left.where("source = 'known_papers'").select("id", title_key(F.col("title")).alias("key"), normalize_doi(F.col("doi")).alias("own")).join(known, "key", "left").select("id", F.coalesce("own", "known_doi").alias("doi"))
    live = left.where("source <> 'known_papers'").select(F.lower(present(F.col("doi"))).alias("doi"), "id").where("doi is not null").groupBy("doi").agg(F.min("id").alias("survivor"))
    folded = written(asked.join(live, "doi").select("id", "survivor"), "maintenance-folded")
    left = left.join(folded.select("id"), "id", "left_anti")
    # Chains: what survived one step may be dropped by a later one.
    then = lambda first, later: first.join(later.select(F.col("id").alias("survivor"), F.col("survivor").alias("last")), "survivor", "left").select("id", F.coalesce("last", "survivor").alias("survivor"))
    resolved = then(then(by_doi, by_title), folded).unionByName(then(by_title, folded)).unionByName(folded)
    repointed = log.join(resolved.select(F.col("id").alias("paper_id"), "survivor"), "paper_id", "left").withColumn("paper_id", F.coalesce("survivor", "paper_id")).select(*log.columns)
    return left.select(*papers.columns), repointed, {"empty_title": empty, "doi": by_doi, "title": by_title, "known_papers": folded}


def maintain(versions: Versions, curated: DataFrame) -> dict[str, int]:
    """Dedupes the current version's ``papers`` and ``query_log`` into the next version; returns how many rows each step removed.

    Readers see the tables before or after, together. If another writer was faster nothing changes and Conflict is raised."""
    at = versions.current()
    now = versions.tables(at)
    papers, log, steps = dedupe(now["papers"], now["query_log"], curated)
    versions.commit({"papers": papers, "query_log": log}, after=at)
    return {name: df.count() for name, df in steps.items()}
