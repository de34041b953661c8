"""Bibliography entries as column expressions; a part that is null leaves its line or phrase out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(before: str, x: Column, after: str = "") -> Column:
    return F.concat(F.lit(before), x.cast("string"), F.lit(after))


def bibtex(id_: Column, doi: Column, title: Column, authors: Column, year: Column) -> Column:
    return F.concat_ws(
        "\n", _part("@article{paper", id_, ","), _part("  title = {", title, "},"), _part("  author = {", F.array_join(authors, " and "), "},"), _part("  year = {", year, "},"), _part("  doi = {", doi, "},"), F.lit("}")
    )


def apa(doi: Column, title: Column, authors: Column, year: Column) -> Column:
    return F.concat_ws(" ", F.array_join(authors, ", "), _part("(", year, ")."), _part("", title, "."), _part("https://doi.org/", doi))


def ris(doi: Column, title: Column, authors: Column, year: Column) -> Column:
    return F.concat_ws("\n", F.lit("TY  - JOUR"), _part("AU  - ", F.array_join(authors, "\nAU  - ")), _part("TI  - ", title), _part("PY  - ", year), _part("DO  - ", doi), F.lit("ER  - "))


def _clean(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(x), r"\.+$", ""), F.lit(""))


def initials_first(author: Column) -> Column:
    """"Smith, John K." as "J. K. Smith"; a name without a comma stays."""
    last, first = F.trim(F.substring_index(author, ",", 1)), F.trim(F.regexp_replace(author, "^[^,]*,", ""))
    letters = F.transform(F.regexp_extract_all(first, F.lit(r"(\p{L})[\p{L}'’]*\.?"), F.lit(1)), lambda c: F.concat(F.upper(c), F.lit(".")))
    return F.when(author.contains(","), F.concat_ws(" ", F.array_join(letters, " "), last)).otherwise(author)


def joined(authors: Column, last: str, most: int) -> Column:
    """Authors as a list with ``last`` before the last one; more than ``most`` become the first and "et al."."""
    n = F.size(authors)
    return F.when(n == 1, authors[0]).when(n > most, F.concat(authors[0], F.lit(" et al."))).otherwise(F.concat(F.array_join(F.slice(authors, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(last), F.element_at(authors, -1)))


def ieee(index: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column) -> Column:
    """[1] J. Smith and A. Lee, "Title," Venue, 2001, doi: 10.1/x."""
    names = F.coalesce(joined(F.transform(F.filter(authors, lambda a: a.isNotNull()), initials_first), " and ", 6), F.lit("Anonymous"))
    head = F.concat(F.lit("["), index.cast("string"), F.lit("] "), names, F.lit(', "'), F.coalesce(_clean(title), F.lit("Untitled Source")), F.lit(',"'))
    when_ = F.coalesce(year.cast("string"), F.lit("n.d."))
    tail = F.when(_clean(doi).isNotNull(), F.concat(when_, F.lit(", doi: "), doi, F.lit("."))).otherwise(F.concat_ws(" ", F.concat(when_, F.lit(".")), F.concat(F.lit("[Online]. Available: "), F.nullif(url, F.lit("")))))
    return F.concat_ws(" ", head, F.concat(_clean(venue), F.lit(",")), tail)


def harvard(title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column) -> Column:
    """Smith, J. and Lee, A. (2001), 'Title', Venue, DOI: 10.1/x."""
    names = F.coalesce(joined(F.filter(authors, lambda a: a.isNotNull()), " and ", 3), F.lit("Anonymous"))
    head = F.concat(names, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("), '"), F.coalesce(_clean(title), F.lit("Untitled Source")), F.lit("'"))
    place = F.coalesce(F.concat(F.lit("DOI: "), F.nullif(doi, F.lit(""))), F.concat(F.lit("URL: "), F.nullif(url, F.lit(""))))
    return F.concat(F.concat_ws(", ", head, _clean(venue), place), F.lit("."))


def cite_key(authors: Column, year: Column, title: Column) -> Column:
    """smith2001deep: first surname, year, first word of four letters or more."""
    last = F.regexp_replace(F.lower(F.substring_index(F.coalesce(authors[0], F.lit("anonymous")), ",", 1)), r"[^\p{L}]", "")
    word = F.regexp_extract(F.lower(F.coalesce(title, F.lit(""))), r"\b(\p{L}{4,})\b", 1)
    return F.concat(last, F.coalesce(year.cast("string"), F.lit("nd")), word)


def explanation(label: Column, rule: Column, confidence: Column, title_sim: Column, consensus: Column) -> Column:
    """One sentence on why a citation got its label."""
    percent = F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit(" %"))
    why = F.when(label == "verified", F.concat(F.lit("The work was found in "), consensus.cast("string"), F.lit(" source(s)"))).when(label == "metadata_error", F.lit("The work exists, but details differ")).when(label == "suspected_hallucination", F.lit("No such work was found")).when(label == "resource", F.lit("A resource that no registry lists")).otherwise(F.lit("The evidence does not decide"))
    return F.concat(why, F.lit(" (title "), F.round(title_sim * 100).cast("int").cast("string"), F.lit(" % alike); rule "), rule, F.lit(", sure to "), percent, F.lit("."))
