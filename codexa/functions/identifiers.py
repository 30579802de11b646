"""Column expressions that find and normalise identifiers, dates, page ranges and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what an identifier is.
DOI = r"10\.\d{4,5}/\S+[^;,.\s]"
ARXIV = r"arXiv\s?(?:\.org)?\s?:\s?(\d{4}\s?\.\s?\d{4,5}(?:v\d+)?)"
PMID = r"(?:PMID|Pub\s?Med\s?(?:ID)?)\s?:?\s*(\d{1,8})"
PMCID = r"(?:PMC\s?(?:ID)?|Pub\s?Med\s?(?:Central)?\s?(?:ID)?)\s?:?\s*(\d{1,9})"
ORCID = r"(\d{4})-?(\d{4})-?(\d{4})-?(\d{3}[\dX])"
EMAIL = r"[\w.+-]+@\w[\w-]*(?:\.\w[\w-]*)+"
URL = r"(?i)(?:https?|ftp)://[-A-Z0-9+&@#/%?=~_()|!:.;]*[-A-Z0-9+&@#/%=~_()]"
HONORIFICS = r"(?i)^(?:(?:mrs?|ms|dr|prof|sir|rev)\.?(?:\s+|$))+"
MONTHS = (
    r"jan", r"feb|fév|fev", r"mar|mär|mrz", r"apr|avr|abr", r"may|mai", r"jun|juin", r"jul|juil", r"aug|août|aou|ago",
    r"sep", r"oct|okt", r"nov", r"dec|déc|dez|dic",
)


def clean_doi(text: Column) -> Column:
    """A DOI without resolver, scheme and closing marks."""
    text = F.regexp_replace(F.trim(text), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    text = F.regexp_replace(text, r"(?i)^doi\s*[:.]?\s*", "")
    return F.regexp_replace(text, r"[\])}>.,;]+$", "")


def identifier_kind(text: Column) -> Column:
    """The first kind that fits: DOI, arXiv, PMID, PMCID, ISSN, ISBN."""
    return (
        F.when(text.rlike(DOI), "doi").when(text.rlike(f"(?i){ARXIV}"), "arxiv").when(text.rlike(r"PMID\s?:?\s*\d"), "pmid")
        .when(text.rlike(r"PMC\s?(?:ID)?\s?:?\s*\d"), "pmcid").when(text.rlike(r"(?:^|\D)\d{4}-\d{3}[\dX](?:$|\D)"), "issn")
        .when(text.rlike(r"(?:97[89][- ]?)?(?:\d[- ]?){9}[\dXx]"), "isbn")
    )


def month_number(text: Column) -> Column:
    """The first month that fits, by names in several languages or by number; null if none does."""
    low = F.lower(text)
    out = None
    for k, pattern in enumerate(MONTHS, 1):
        out = F.when(low.rlike(f"^(?:{pattern})"), k) if out is None else out.when(low.rlike(f"^(?:{pattern})"), k)
    number = F.regexp_extract(text, r"^(\d{1,2})$", 1).try_cast("int")
    return out.when(number.between(1, 12), number)


def pivot_year(text: Column) -> Column:
    """A year of four digits, or of two: from 20 on in the 1900s, below in the 2000s."""
    full = F.regexp_extract(text, r"(?:^|\D)(\d{4})(?:\D|$)", 1).try_cast("int")
    short = F.regexp_extract(text, r"^\D*(\d{2})\D*$", 1).try_cast("int")
    return F.coalesce(full, F.when(short >= 20, short + 1900).otherwise(short + 2000))


def page_range(text: Column) -> Column:
    """struct(first, last): '123-7' means 123 to 127; a last page below the first takes over its leading digits."""
    first, last = F.regexp_extract(text, r"(\d+)\D+(\d+)", 1), F.regexp_extract(text, r"(\d+)\D+(\d+)", 2)
    short = F.length(last) < F.length(first)
    whole = F.when(short, F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(last)), last)).otherwise(last)
    return F.struct(first.try_cast("long").alias("first"), whole.try_cast("long").alias("last"))


def volume_issue(text: Column) -> Column:
    """struct(volume, issue) of forms like '12(3)'."""
    pattern = r"^\D*(\d+)\D+(\d+)"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("volume"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("issue"))


def person_name(text: Column) -> Column:
    """A name without honorifics in front and marker digits or symbols behind."""
    text = F.regexp_replace(F.trim(text), HONORIFICS, "")
    return F.trim(F.regexp_replace(text, r"[\d*†‡§,;]+$", ""))


def callout_type(text: Column, superscript: Column) -> Column:
    """The kind of a citation marker, by the first rule that fits."""
    t = F.regexp_replace(text, " ", "")
    number = t.rlike(r"^\d+(?:[,\-–]\d+)*$")
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "UNKNOWN").when(number & superscript, "SUPERSCRIPT_NUMBER")
        .when(t.rlike(r"^\[\d+(?:[,;\-–]\d+)*\]$"), "BRACKET_NUMBER").when(t.rlike(r"^\(\d+(?:[,;\-–]\d+)*\)$"), "PARENTHESIS_NUMBER")
        .when(t.rlike(r"^\[.+\]$"), "BRACKET_TEXT").when(t.rlike(r"^\(.+\)$"), "PARENTHESIS_TEXT").when(number, "NUMBER")
        .when(t.rlike(r"^[IVXivx]+$"), "ROMAN").otherwise("UNKNOWN")
    )


def email_variants(first: Column, last: Column) -> Column:
    """Local parts that a person's address often has."""
    f, s = F.lower(first), F.lower(last)
    a, b = F.substring(f, 1, 1), F.substring(s, 1, 1)
    return F.array_distinct(F.array(F.concat(f, F.lit("."), s), F.concat(f, s), F.concat(a, s), F.concat(s, f), F.concat(f, b), s, f))


def keyword_parts(text: Column) -> Column:
    """Keywords by the first separator, in order of priority, that gives more than two parts; else the whole."""
    body = F.trim(F.regexp_replace(text, r"(?i)^(?:key\s?words?(?:\s+and\s+phrases)?|index terms)\s*[:\-—.]?\s*", ""))
    out = None
    for mark in (";", "·", "•", ",", "\n"):
        parts = F.split(body, f"[{mark}]")
        out = F.when(F.size(parts) > 2, parts) if out is None else out.when(F.size(parts) > 2, parts)
    return F.filter(F.transform(out.otherwise(F.array(body)), lambda x: F.trim(x)), lambda x: x != "")
