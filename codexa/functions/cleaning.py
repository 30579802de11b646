"""Column expressions that clean and judge extracted fields: markers, abstracts, e-mail addresses, identifiers, replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions import text as T

#: Fixed values.
ABSTRACT_PREFIXES = ("abstract", "summary", "résumé", "abrégé", "a b s t r a c t")
STOPWORDS = ("the", "of", "and", "du", "de le", "de la", "des", "der", "an", "und", "for")
BARRED_ADDRESS_PARTS = (
    "firstname lastname publication theses thesis editor press contact info feedback journal please pubs iza@iza admin help subs news archives order postmaster@ informa reprint "
    "comunicacion@ revista digitalcommons group@ root@ deposit@ studies permiss print paper report support pedocs investigaciones@ medicin copyright rights sales@ pacific@ redaktion "
    "publicidad surface@ comstat@ service@ omnia@ letter scholar staff delivery epubs office technolog compute elsevier"
).split()
SCRIPT_LANGUAGES = {"cyrillic": "ru", "greek": "el", "arabic": "ar", "hebrew": "he", "cjk": "zh", "devanagari": "hi", "thai": "th"}
YEAR = r"[12][0-9]{3}"
NUMBERED = r"[(\[]?\s*(?:[0-9]+[-−–][0-9]+,|[0-9]+,[ ]*)*[ ]*(?:[0-9]+[-–][0-9]+|[0-9]+)\s*[)\]]?"
AUTHOR = r"[A-Z]\p{L}+"
ARXIV_NEW, ARXIV_OLD = r"([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", r"([a-zA-Z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?"


def without_spaces(text: Column) -> Column:
    """The normal form without spaces and line feeds."""
    return F.translate(T.normalise(text), " \n", "")


def shadowed_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "X")


def first_token(text: Column) -> Column:
    """What stands before the first space, leading spaces aside."""
    return F.substring_index(F.ltrim(text), " ", 1)


def last_token(text: Column) -> Column:
    """What stands after the last space; empty if the text ends in one."""
    return F.substring_index(text, " ", -1)


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in the text without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def capitalised(text: Column, delimiters: str) -> Column:
    """Each run of characters other than ``delimiters`` with its first upper-cased and the rest lower-cased."""
    kind = T.char_class(delimiters)[1:-1]
    parts = F.regexp_extract_all(text, F.lit(f"(?s)[{kind}]+|[^{kind}]+"), F.lit(0))
    return F.concat_ws("", F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))))


def stripped(text: Column, leading: str, trailing: str) -> Column:
    return F.rtrim(F.ltrim(text, F.lit(leading)), F.lit(trailing))


def without_stopwords(text: Column) -> Column:
    """Tokens that aren't stop-words, without possessive endings, commas and full stops; runs of spaces as one."""
    kept = F.concat_ws("", F.filter(T.tokens(text), lambda t: ~t.isin(*STOPWORDS)))
    return F.regexp_replace(F.translate(F.replace(kept, F.lit("'s"), F.lit(" ")), ",.", "  "), " +", " ")


def is_noise_line(line: Column) -> Column:
    """Empty lines and those that hold an image or page mark."""
    return F.coalesce(F.length(line) == 0, F.lit(True)) | line.contains("@IMAGE") | line.contains("@PAGE")


def json_escaped(text: Column) -> Column:
    """Quotes and line feeds with a backslash before them."""
    return F.regexp_replace(text, '(["\n])', r"\\$1")


def sql_escaped(text: Column) -> Column:
    """Null for an empty text; quotes and wildcards with a backslash before them."""
    return F.when(F.length(text) > 0, F.regexp_replace(text, "(['%_])", r"\\$1"))


def isbn(text: Column) -> Column:
    """Without hyphens, spaces and apostrophes, white space folded; empty for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "- '", ""), r"\s+", " "))


def abstract(text: Column) -> Column:
    """White space folded, a heading word and one mark after it taken off, brackets closed up."""
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = reduce(lambda rest, p: F.when(F.lower(folded).startswith(p), folded.substr(F.lit(len(p) + 1), F.length(folded))).otherwise(rest), reversed(ABSTRACT_PREFIXES), folded)
    marked = F.when(F.substring(bare, 1, 1).isin(".", ":", ")"), F.trim(bare.substr(F.lit(2), F.length(bare)))).otherwise(bare)
    return F.replace(F.replace(F.replace(marked, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")")), F.lit("  "), F.lit(" "))


def is_author_style(marker: Column) -> Column:
    return F.trim(marker).rlike(YEAR) & F.trim(marker).rlike(AUTHOR)


def is_numbered_style(marker: Column) -> Column:
    """A number or list of numbers as a whole, or any number beside a name."""
    t = F.trim(marker)
    return t.rlike(f"^(?:{NUMBERED})$") | (t.rlike(NUMBERED) & t.rlike(AUTHOR))


def language_of_script(script: Column) -> Column:
    """The language most written in a script; null for Latin and unknown ones."""
    return F.create_map(*(F.lit(x) for pair in SCRIPT_LANGUAGES.items() for x in pair))[script]


def arxiv_id(raw: Column) -> Column:
    """The bare id, new or old form, without prefix, version and category; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "^(?i:arxiv:)", ""), r"(?s)\[.*$", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, ARXIV_NEW, 1), F.lit("")), F.nullif(F.regexp_extract(bare, ARXIV_OLD, 1), F.lit("")))


def better_text(found: Column, known: Column) -> Column:
    """Whether ``known`` should replace ``found``: that is empty, under 80 % as long, or under 0.9 alike by words."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    a, b = plain(found), plain(known)
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    both = F.size(F.array_intersect(x, y))
    differ = F.when(a == b, False).when(F.length(a) < F.length(b) * 0.8, True).otherwise(both / (F.size(x) + F.size(y) - both) < 0.9)
    return F.when(found.isNull() | (F.length(found) == 0), True).otherwise(differ)


def better_names(found: Column, known: Column) -> Column:
    """Whether ``known`` surnames should replace ``found``: none were found, two more or fewer, or under 70 % agree."""
    agree = F.size(F.filter(known, lambda x: F.array_contains(found, x)))
    return F.when(F.size(known) == 0, False).when(F.size(found) == 0, True).when(F.abs(F.size(found) - F.size(known)) > 1, True).otherwise(agree / F.size(known) < 0.7)


def addresses(raw: Column) -> Column:
    """The e-mail addresses of a text, cleaned, each once; null if there is none.

    Addresses parted by commas, semicolons, slashes or "or" share the domain of the last if only that has one.
    """
    bare = F.trim(F.translate(raw, "{}()", ""))
    for pattern in (r"[Ee]lectronic\s[Aa]ddress:?", r"^[eE]?-?mail:?\s[Aa]ddress:?", r"^[eE]?-?mail:?\s?", r"^[A-Z][a-z]+\s+[A-Z][a-z]+\*?\s*-\s*"):
        bare = F.regexp_replace(bare, pattern, "")
    low = F.lower(bare)
    parts = F.filter(F.split(low, r"\sor\s|,|;|/"), lambda x: x != "")
    domain = F.regexp_extract(F.element_at(parts, -1), "(?s)^[^@]*@?(.*)$", 1)
    share = (F.size(parts) > 1) & (F.size(F.filter(F.split(low, "@"), lambda x: x != "")) == 2)
    last = F.size(parts) - 1
    parts = F.when(share, F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, F.lit("@"), domain)).otherwise(x))).otherwise(parts)

    def cleaned(x):
        x = F.trim(F.lower(F.try_url_decode(F.regexp_replace(x, "%[Ee]2%80%90", "-"))))
        for pattern in (r"^(e-mail|email|e\smail|mail):", "[\r\n\t ]", r"\(.*\)$"):
            x = F.regexp_replace(x, pattern, "")
        for pattern in ("&#64;", r"@\.", r"\.@"):
            x = F.regexp_replace(x, pattern, "@")
        return x

    barred = "|".join(x.replace(".", r"\.") for x in BARRED_ADDRESS_PARTS)
    good = F.array_distinct(F.filter(F.transform(parts, cleaned), lambda x: x.contains("@") & ~x.rlike(barred)))
    return F.when(F.size(good) > 0, good)
