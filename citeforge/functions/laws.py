"""Citations of Vietnamese laws: numbers, years, authorities and what replaced them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and the constitution: name in lower case, years of enactment, those in force, their numbers, and what replaces the others.
STATUTES = (
    ("hiến pháp", ("1946", "1959", "1980", "1992", "2013"), ("2013",), {}, "Hiến pháp 2013"),
    ("bộ luật dân sự", ("1995", "2005", "2015"), ("2015",), {"2005": "33/2005/QH11", "2015": "91/2015/QH13"}, "91/2015/QH13"),
    ("bộ luật hình sự", ("1985", "1999", "2015", "2017"), ("2015", "2017"), {"2015": "100/2015/QH13"}, "100/2015/QH13"),
)
_NUMBER = r"\b(\d{1,4})/((?:19|20)\d{2})/([A-ZĐ]+(?:-[A-ZĐ]+)*\d*)"


def legal_check(raw: Column, statutes=STATUTES) -> Column:
    """struct(code, year, mismatches, fabricated, statute, superseded) of a legal citation.

    A number's year has to be the date's; parliament enacts codes and QH numbers, the government decrees; a
    statute needs one of its years and the number of that year; other codes, dates that no calendar has
    and numbers out of range were made up."""
    text = F.coalesce(raw, F.lit(""))
    low = F.lower(text)
    part = lambda i: F.nullif(F.regexp_extract(text, _NUMBER, i), F.lit(""))
    code, number, code_year, suffix = part(0), part(1).cast("int"), part(2), F.coalesce(F.upper(part(3)), F.lit(""))
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))
    date = r"ngày\s+(\d{1,2})[/\-](\d{1,2})[/\-]((?:19|20)\d{2})"
    day, month, date_year = (F.regexp_extract(low, date, i) for i in (1, 2, 3))
    d, m = day.try_cast("int"), month.try_cast("int")
    odd_date = F.coalesce((m < 1) | (m > 12) | (d < 1) | (d > 31) | ((m == 2) & (d > 29)) | (m.isin(4, 6, 9, 11) & (d > 30)), F.lit(False))
    other_year = code.isNotNull() & (date_year != "") & (date_year != code_year)
    high = low.rlike(r"hiến\s+pháp|bộ\s+luật") | suffix.startswith("QH")
    of_others = F.when(high, low.rlike(r"của\s+(chính\s+phủ|bộ\s+(?!luật)\p{L}+|thủ\s+tướng)")).when(suffix == "NĐ-CP", low.rlike(r"của\s+(quốc\s+hội|bộ\s+\p{L}+|tòa\s+án)")).otherwise(False)
    name, wrong_year, wrong_code, old = F.lit(None).cast("string"), F.lit(False), F.lit(False), F.lit(None).cast("string")
    for title, valid, active, numbers, newest in reversed(statutes):
        hit = low.contains(title)
        cited = F.array_intersect(years, F.array(*[F.lit(y) for y in valid]))
        year = F.try_element_at(cited, F.lit(-1))
        expected = F.lit(None).cast("string")
        for y, n in numbers.items():
            expected = F.when(F.coalesce(year, F.lit(active[-1])) == y, n).otherwise(expected)
        name = F.when(hit, title).otherwise(name)
        wrong_year = F.when(hit, (F.size(years) > 0) & (F.size(cited) == 0)).otherwise(wrong_year)
        wrong_code = F.when(hit, F.coalesce(F.lower(expected) != F.lower(code), F.lit(False))).otherwise(wrong_code)
        old = F.when(hit, F.when(year.isNotNull() & (F.size(F.array_intersect(cited, F.array(*[F.lit(y) for y in active]))) == 0), newest)).otherwise(old)
    plain = name.isNull()
    no_code = plain & low.contains("bộ luật")
    range_ = plain & F.coalesce((suffix.startswith("QH") & (number > 200)) | ((suffix == "NĐ-CP") & (number >= 400)), F.lit(False))
    fabricated = no_code | (plain & odd_date) | range_
    fields = F.array_compact(F.array(F.when(other_year | wrong_year | (plain & odd_date), "year"), F.when(F.coalesce(of_others, F.lit(False)), "venue"), F.when(wrong_code | no_code | range_, "title")))
    return F.struct(code.alias("code"), F.coalesce(F.nullif(date_year, F.lit("")), F.try_element_at(years, F.lit(-1))).alias("year"), fields.alias("mismatches"), fabricated.alias("fabricated"), name.alias("statute"), F.when(F.size(fields) == 0, old).alias("superseded"))


def legal_label(check: Column) -> Column:
    """fabricated, mismatch, superseded, verified (a statute or a number) or unverified."""
    return F.when(check["fabricated"], "fabricated").when(F.size(check["mismatches"]) > 0, "mismatch").when(check["superseded"].isNotNull(), "superseded").when(check["statute"].isNotNull() | check["code"].isNotNull(), "verified").otherwise("unverified")
