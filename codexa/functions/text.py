"""Column expressions on text: normalising, tokenising, shapes, classes, cleaning. All run inside Catalyst.

Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets that decide what the tokens and normal forms are.
SPACES = "\u0009\u0020\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS = "\u000c\u000a\u000d\u000b\u0085\u2029\u2028"
LOW_LINES = "_\u203f\u2040\u2054\ufe4d\ufe4e\ufe4f\uff3f\ufe33\ufe34"
BARS = "|\u01c0\u05c0\u2223\u2758"
BULLETS = "\u2022\u2023\u25e6\u2043\u204c\u204d\u2219\u25d8\u29be\u29bf\u23fa\u25cf\u26ab\u2b24\u00b7"
OPEN_PARENTHESES = "(\uff08\u27ee\u2985\u2768\u276a\u27ec"
CLOSE_PARENTHESES = ")\uff09\u27ef\u2986\u2769\u276b\u27ed"
DASHES = "[\\p{Pd}\u2212]"
PUNCTUATION = "(\uff08[\u0020\u2022*,:;?.!/)\uff09-\u2212\u2013\u2010\u00ab\u00bb\u201e\"\u201c\u201d\u2018\u2019'`$#@]*\u2666\u2665\u2663\u2660\u00a0\u3002\u3001\uff0c\u30fb"
DELIMITERS = "\n\r\t\f\u00a0\u200c" + PUNCTUATION


def char_class(chars: str, negated: bool = False) -> str:
    """A regular expression for one of these characters, valid in Java and in RE2."""
    inner = "".join("\\" + c if c in r"\]^-[&" else c for c in dict.fromkeys(chars))
    return f"[{'^' if negated else ''}{inner}]"


TOKEN = f"{char_class(DELIMITERS)}|{char_class(DELIMITERS, True)}+"


def normalise(text: Column) -> Column:
    """One form for spaces, line breaks, dashes, low lines, bars, bullets and parentheses."""
    for pattern, to in (
        (char_class(SPACES), " "), ("\r\n", "\n"), (char_class(LINE_BREAKS), "\n"), (DASHES, "-"), (char_class(LOW_LINES), "_"),
        (char_class(BARS), "|"), (char_class(BULLETS), "•"), (char_class(OPEN_PARENTHESES), "("), (char_class(CLOSE_PARENTHESES), ")"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def tokens(text: Column) -> Column:
    """All tokens in order; each delimiter is a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def alphanumeric_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def subdigit_parts(token: Column) -> Column:
    """A token cut between digits and anything else."""
    return F.regexp_extract_all(token, F.lit(r"\d+|\D+"), F.lit(0))


def shape_letters(word: Column) -> Column:
    """X, x and d for capitals, other letters and digits; other characters stay."""
    word = F.regexp_replace(word, r"\p{Lu}", "\u0001")
    word = F.regexp_replace(word, r"\p{L}", "x")
    return F.translate(F.regexp_replace(word, r"\p{Nd}", "d"), "\u0001", "X")


def word_shape(word: Column) -> Column:
    """First letter's class, the middle with runs folded, and the last two as they are."""
    shape = shape_letters(word)
    n = F.length(word)
    middle = F.regexp_replace(F.substring(shape, F.lit(2), F.greatest(n - 3, F.lit(0))), r"(.)\1+", "$1")
    return F.concat(F.substring(shape, 1, 1), F.when(n > 3, middle).otherwise(F.lit("")), F.when(n > 2, F.right(shape, F.lit(2))).when(n > 1, F.right(shape, F.lit(1))).otherwise(F.lit("")))


def punctuation_profile(line: Column) -> Column:
    """The line's punctuation marks, in order."""
    return F.regexp_replace(line, char_class(PUNCTUATION.replace(" ", ""), True), "")


def letters_pattern(line: Column) -> Column:
    """What tells a running head: the line's ASCII letters, in lower case."""
    return F.lower(F.regexp_replace(line, "[^a-zA-Z]", ""))


def punctuation_type(token: Column) -> Column:
    """The class of a token; a later rule wins over an earlier one."""
    return (
        F.when(token.isin("'", '"', "`", "“", "”", "‘", "’"), "QUOTE")
        .when(token.isin("-", "–"), "HYPHEN")
        .when(token == ",", "COMMA")
        .when(token == ".", "DOT")
        .when(token.isin(")", "]"), "ENDBRACKET")
        .when(token.isin("(", "["), "OPENBRACKET")
        .when(token.rlike(r"^[,:;?.]+$"), "PUNCT")
        .otherwise("NOPUNCT")
    )


def predicates(token: Column) -> dict[str, Column]:
    """Character-class tests of a token. ``all_capital`` asks only that no letter is lower-case."""
    return {
        "first_capital": token.rlike(r"^\p{Lu}"),
        "all_capital": ~token.rlike(r"\p{Ll}"),
        "single_char": F.length(token) == 1,
        "has_digit": token.rlike(r"[0-9]"),
        "all_digit": token.rlike(r"^[0-9]+$"),
        "complex_number": token.rlike(r"^[0-9.,]*[0-9][0-9.,]*$"),
        "year": token.rlike(r"[1,2][0-9][0-9][0-9]"),
        "http": token.rlike(r"https?"),
        "acronym": token.rlike(r"[A-Z]\.([A-Z]\.)*"),
    }


def linear_scaling(pos: Column, total: Column, bins: int) -> Column:
    """0 up to position 0, ``bins`` from the total on, and in between the whole part of pos / total * bins."""
    return F.when(pos <= 0, 0).when(pos >= total, bins).otherwise((pos / total * bins).cast("int"))


def log_scaling(pos: Column, total: Column, bins: int) -> Column:
    return F.when(pos <= 0, 0).when(pos >= total, bins).otherwise((F.log(pos + 1) / F.log(total + 1) * bins).cast("int"))


def dehyphenated(text: Column) -> Column:
    """Words joined that a hyphen parts at the end of a line, where the next line goes on in lower case."""
    return F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll}+)", "$1$2")


def clean_field(text: Column) -> Column:
    """A metadata field without punctuation at its ends, out of parentheses around it all."""
    text = F.regexp_replace(F.regexp_replace(text, ",,", ","), ", ,", ",")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[, .\-_/:]+$", ""), r"^[, .;\-_:]+", ""))
    text = F.when(text.startswith("(") & text.endswith(")"), F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    return F.trim(F.regexp_replace(text, r"( (the|of|and|du|de le|de la|des|der|an|und|for))+$", ""))


#: Code point ranges by script (Unicode blocks), in the order of precedence.
SCRIPTS = {
    "latin": r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}",
    "greek": r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}",
    "cyrillic": r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C8F}",
    "hebrew": r"\x{590}-\x{5FF}\x{FB1D}-\x{FB4F}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "devanagari": r"\x{900}-\x{97F}",
    "thai": r"\x{E00}-\x{E7F}",
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{20000}-\x{2FFFF}\x{30000}-\x{3134F}",
}
SCRIPT_SAMPLE, SCRIPT_MINIMUM = 200, 8


def script_counts(text: Column) -> Column:
    """struct of counts by script over the first characters that belong to any script (the feature is a sample)."""
    known = F.substring(F.regexp_replace(text, f"[^{''.join(SCRIPTS.values())}]", ""), 1, SCRIPT_SAMPLE)
    return F.struct(*(F.regexp_count(known, F.lit(f"[{r}]")).alias(name) for name, r in SCRIPTS.items()))


def script(counts: Column) -> Column:
    """The script with most characters; Latin unless at least eight characters are of others, and on ties."""
    others = [n for n in SCRIPTS if n != "latin"]
    total = sum((counts[n] for n in others), F.lit(0))
    best = F.lit("latin")
    top = counts["latin"]
    for n in others:
        best, top = F.when(counts[n] > top, F.lit(n)).otherwise(best), F.greatest(top, counts[n])
    return F.when(total < SCRIPT_MINIMUM, F.lit("latin")).otherwise(best)


SENTENCE = r"(?s).*?[.?!](?:\s+|$)|.+$"


def sentences(text: Column) -> Column:
    """Sentences end at a full stop, question or exclamation mark before white space; trailing space is cut off."""
    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"(?<=[.?!])\s+$", ""))
