"""Which registries a citation is looked up in, and when the second round is not needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_doi

# Signals in title, venue, raw text and address, without regard to case.
SIGNALS = {
    "thesis": r"\b(?:thesis|dissertation|luận\s+văn|luận\s+án|khóa\s+luận|đồ\s+án\s+tốt\s+nghiệp|working\s+paper|technical\s+report|hal-\d+|openaire|institutional\s+repository|archives-ouvertes\.fr)\b",
    "regional": r"\b(?:doaj|open\s+access|tạp\s+chí\s+khoa\s+học|vietnam\s+journal|vnu\s+journal|tdtu|ton\s+duc\s+thang|ho\s+chi\s+minh\s+city|hanoi|southeast\s+asian|asian\s+journal)\b",
    "book": r"\b(?:(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|revised|updated)\s+(?:ed\.?|edition)|isbn(?:-1[03])?|o['’]reilly|addison-wesley|prentice\s+hall|pearson|wiley"
    r"|mcgraw-hill|manning\s+publications|apress|packt|no\s+starch|cambridge\s+university\s+press|oxford\s+university\s+press|mit\s+press|harvard\s+university\s+press|princeton\s+university\s+press|academic\s+press"
    r"|crc\s+press|morgan\s+kaufmann|definitive\s+guide|textbook|nhà\s+xuất\s+bản|nxb|zondervan|baker\s+academic|crossway|routledge|sage\s+publications|bloomsbury|eerdmans|palgrave\s+macmillan|de\s+gruyter|brill|edited\s+by)\b",
    "biomed": r"\b(?:pubmed|medline|lancet|jama|bmj|nejm|new\s+england\s+journal|plos\s+(?:one|medicine|biology)|nature\s+medicine|psychiatr\w*|psychol\w*|clinical|medical|medicine|patient\w*|health|depress\w*"
    r"|mental\s+disorder\w*|syndrome|therap\w*|disease\w*|epidemiol\w*|neuroimaging|pharmacol\w*|biomedical|cardiol\w*|oncol\w*|pediatr\w*)\b",
    "cs": r"\b(?:ieee|acm|neurips|nips|icml|iclr|acl|emnlp|naacl|coling|conll|cvpr|iccv|eccv|aaai|ijcai|kdd|sigir|usenix|vldb|sigmod|icse|fse|neural\w*|deep\s+learning|machine\s+learning|transformer\w*|language\s+model\w*"
    r"|llm\w*|bert|roberta|gpt|embedding\w*|attention|convolutional|reinforcement\s+learning|natural\s+language|computer\s+vision|sentiment|classification|algorithm\w*|software|database\w*|arxiv|data\s+mining"
    r"|cloud\s+computing|virtual\s+machine\w*|container\w*|microservice\w*|kubernetes|docker)\b",
    "periodical": r"\b(?:proceedings|conference|journal|transactions|symposium|workshop|procedia|vol\.\s*\d+|no\.\s*\d+|pp\.\s*\d+)\b",
}
# Beginnings of DOIs that repositories give out.
DATA_DOIS = ("10.5281/", "10.6084/", "10.5061/", "10.17605/", "10.7910/")


def signals(title: Column, venue: Column, raw: Column, url: Column, doi: Column) -> Column:
    """struct of flags: arxiv_doi, data_doi, bio_doi, arxiv, rfc, package, hub, thesis, regional, book, biomed, cs, periodical."""
    text = F.concat_ws(" ", title, venue, raw, url)
    key = F.coalesce(normalize_doi(doi), F.lit(""))
    # A word goes on over any letter: Java's \w knows ASCII alone, while its \b doesn't.
    word = r"[\p{L}\p{N}_]"
    has = lambda p: text.rlike("(?iu)" + p.replace(r"\w", word))
    arxiv_doi = key.startswith("10.48550/arxiv")
    data = reduce(lambda a, b: a | b, [key.startswith(p) for p in DATA_DOIS]) & ~arxiv_doi
    bio = key.startswith("10.1101/")
    arxiv = arxiv_doi | has(r"\barxiv\b|\bcorr\b|\barxiv:\d{4}\.\d{4,5}")
    thesis = has(SIGNALS["thesis"])
    book = has(SIGNALS["book"]) & ~arxiv & ~thesis
    flags = {
        "arxiv_doi": arxiv_doi, "data_doi": data, "bio_doi": bio, "arxiv": arxiv, "rfc": has(r"\brfc\s*\d{1,5}\b"), "package": has(r"pypi\.org/project/|npmjs\.com/package/|github\.com/[\w\-]+/[\w\-]+"),
        "hub": has(r"huggingface\.co/"), "thesis": thesis, "regional": has(SIGNALS["regional"]), "book": book, "biomed": bio | has(SIGNALS["biomed"]), "cs": has(SIGNALS["cs"]), "periodical": has(SIGNALS["periodical"]) & ~book,
    }
    return F.struct(*[v.alias(k) for k, v in flags.items()])


# For the first signal that holds, the registries of the first and of the second round.
PLAN = (
    ("s.rfc", "tech_standard crossref openalex", "dblp"),
    ("s.package", "tech_standard openalex", ""),
    ("s.hub", "huggingface arxiv dblp openalex", "datacite crossref"),
    ("s.arxiv_doi", "arxiv datacite dblp openalex", "huggingface"),
    ("s.data_doi", "datacite openalex crossref", "openaire_hal dblp arxiv"),
    ("s.bio_doi", "ncbi_biorxiv europepmc openalex", "crossref"),
    ("s.arxiv", "arxiv dblp openalex", "datacite huggingface crossref"),
    ("s.book and s.cs", "openlibrary crossref openalex", "dblp"),
    ("s.book", "openlibrary crossref openalex", ""),
    ("s.thesis", "openaire_hal openalex crossref", "datacite doaj dblp"),
    ("s.biomed and s.cs", "crossref openalex europepmc", "ncbi_biorxiv doaj dblp arxiv"),
    ("s.biomed and doi is null", "crossref openalex europepmc", "ncbi_biorxiv doaj openlibrary"),
    ("s.biomed", "crossref openalex europepmc", "ncbi_biorxiv doaj"),
    ("s.cs and doi is null and not s.periodical", "crossref openalex dblp", "arxiv datacite openaire_hal openlibrary"),
    ("s.cs", "crossref openalex dblp", "arxiv datacite openaire_hal"),
    ("s.regional and doi is not null", "crossref openalex doaj", "datacite doaj europepmc dblp"),
    ("s.regional and s.periodical", "crossref openalex doaj", "doaj dblp arxiv europepmc openaire_hal"),
    ("s.regional", "crossref openalex doaj", "doaj openaire_hal dblp arxiv openlibrary europepmc"),
    ("doi is not null", "crossref openalex", "datacite doaj europepmc dblp"),
    ("s.periodical", "crossref openalex", "doaj dblp arxiv europepmc openaire_hal"),
    ("true", "crossref openalex", "doaj openaire_hal dblp arxiv openlibrary europepmc"),
)


def plan(citations: DataFrame) -> DataFrame:
    """citations with first and second: arrays of registries; reads s (:func:`signals`) and doi."""
    pick = lambda i: F.expr("case " + " ".join(f"when {row[0]} then array({', '.join(repr(x) for x in row[i].split())})" if row[i] else f"when {row[0]} then cast(array() as array<string>)" for row in PLAN) + " end")
    return citations.withColumns({"first": pick(1), "second": pick(2)})


def needs_second_round(planned: DataFrame, answers: DataFrame, least_title: float = 0.85, least_author: float = 0.5, sources: int = 2) -> DataFrame:
    """(citation_id, source) to ask in the second round: those of citations that fewer than ``sources`` first-round sources confirm.

    answers: (citation_id, source_name, found, title_sim, author_sim, year_distance, doi_match)."""
    strong = F.col("found") & ((F.col("title_sim") >= least_title) & ((F.col("author_sim") >= least_author) | F.col("doi_match")) & ((F.col("year_distance") <= 1) | F.col("doi_match")))
    asked = planned.select("citation_id", F.explode("first").alias("source_name"))
    sure = answers.where(strong).join(asked, ["citation_id", "source_name"], "left_semi").groupBy("citation_id").agg(F.countDistinct("source_name").alias("n")).where(F.col("n") >= sources)
    return planned.join(sure, "citation_id", "left_anti").select("citation_id", F.explode("second").alias("source"))


def enrich(candidates: DataFrame, field: str = "abstract", least: float = 0.85) -> DataFrame:
    """(citation_id, field): the longest value among found candidates whose title agrees, for citations whose best one lacks it."""
    ok = candidates.where(F.col("found") & (F.col("title_sim") >= least))
    got = ok.groupBy("citation_id").agg(F.max_by(field, F.struct("confidence", -F.col("seq"))).alias("own"), F.max_by(field, F.struct(F.length(field), -F.col("seq"))).alias("other"))
    return got.select("citation_id", F.coalesce(F.nullif("own", F.lit("")), "other").alias(field))
