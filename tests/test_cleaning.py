"""Values of the cleaning expressions, and their results for nulls and empty texts."""

import pytest
from pyspark.sql import functions as F

from codexa.functions import cleaning as C


def value(spark, column, kind="string", text=None):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "make,text,want",
    [
        (C.first_token, "   ", ""), (C.first_token, " a b", "a"), (C.last_token, "a b ", ""), (C.last_token, "ab", "ab"),
        (lambda c: C.capitalised(c, " -"), "mcdonald-SMITH o'neil", "Mcdonald-Smith O'neil"), (lambda c: C.stripped(c, "([", ".,"), "([a].,", "a]"),
        (C.abstract, "Abstract", ""), (C.abstract, "ABSTRACT: We ( do )  it", "We (do) it"), (C.abstract, None, None), (C.isbn, None, ""), (C.isbn, "978-0 1'2", "978012"),
        (C.sql_escaped, "", None), (C.sql_escaped, "a'b%c_", r"a\'b\%c\_"), (C.json_escaped, 'a"b\n', 'a\\"b\\\n'),
        (C.arxiv_id, "arXiv:2602.08668v3[cs.CR]", "2602.08668"), (C.arxiv_id, "hep-th/9901001v2", "hep-th/9901001"), (C.arxiv_id, "none", None), (C.arxiv_id, None, None),
        (C.is_numbered_style, "[1, 2, 5-7]", True), (C.is_numbered_style, "Naze et al. [5]", True), (C.is_numbered_style, "in 5 cases", False), (C.is_author_style, "(Meier, 2001)", True),
        (C.language_of_script, "thai", "th"), (C.language_of_script, "latin", None), (lambda c: C.occurrences(c, "aa"), "aaaa a", 2), (C.is_noise_line, None, True), (C.is_noise_line, "x @IMAGE y", True), (C.is_noise_line, " ", False),
    ],
)
def test_values(spark, make, text, want):
    assert value(spark, make(F.col("t")), text=text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("jiglesia,cmt@ll.iac.es", ["jiglesia@ll.iac.es", "cmt@ll.iac.es"]), ("Bono/caputo/vittorio@mporzio.astro.it", ["bono@mporzio.astro.it", "caputo@mporzio.astro.it", "vittorio@mporzio.astro.it"]),
        ("E-mail: a@b.org", ["a@b.org"]), ("a@b.org; a@b.org", ["a@b.org"]), ("editor@b.org", None), ("", None), (None, None), ("%zz@b.org", None),
    ],
)
def test_addresses(spark, text, want):
    assert value(spark, C.addresses(F.col("t")), text=text) == want


@pytest.mark.parametrize("found,known,want", [(None, "A title", True), ("a title!", "A title", False), ("A", "A title", True), ("a b c d e f g h i x", "a b c d e f g h i j", True)])
def test_better_text(spark, found, known, want):
    assert spark.createDataFrame([(found, known)], "a string, b string").select(C.better_text(F.col("a"), F.col("b")).alias("v")).first()["v"] is want


@pytest.mark.parametrize("found,known,want", [(["a"], [], False), ([], ["a"], True), (["a"], ["a", "b", "c"], True), (["a", "b", "x"], ["a", "b", "c"], True), (["a", "b", "c"], ["a", "b", "c"], False)])
def test_better_names(spark, found, known, want):
    assert spark.createDataFrame([(found, known)], "a array<string>, b array<string>").select(C.better_names(F.col("a"), F.col("b")).alias("v")).first()["v"] is want
