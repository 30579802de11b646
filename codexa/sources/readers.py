"""Scans: page-layout XML, HTML text nodes, plain text documents, feature files; sinks: TEI-like XML, BibTeX, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Explicit, as inference would turn single children into structs.
_STRING = "struct<_CONTENT:string,_HPOS:double,_VPOS:double,_WIDTH:double,_HEIGHT:double,_STYLEREFS:string>"
ALTO_PAGE = f"_ID string, _PHYSICAL_IMG_NR int, _WIDTH double, _HEIGHT double, PrintSpace struct<TextBlock:array<struct<_ID:string,TextLine:array<struct<String:array<{_STRING}>>>>>>"


def alto_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Layout tokens of ALTO files: page, block, line and place in the line, text, box and style reference."""
    pages = spark.read.format("xml").option("rowTag", "Page").schema(ALTO_PAGE).load(path)
    blocks = pages.select(F.col("_PHYSICAL_IMG_NR").alias("page"), F.posexplode("PrintSpace.TextBlock").alias("block", "b"))
    lines = blocks.select("page", "block", F.posexplode("b.TextLine").alias("line", "l"))
    words = lines.select("page", "block", "line", F.posexplode("l.String").alias("ord", "s"))
    return words.select("page", "block", "line", "ord", *(F.col(f"s._{a}").alias(b) for a, b in (("CONTENT", "text"), ("HPOS", "x"), ("VPOS", "y"), ("WIDTH", "w"), ("HEIGHT", "h"), ("STYLEREFS", "style"))))


def alto_styles(spark: SparkSession, path: str) -> DataFrame:
    """Fonts by style reference."""
    raw = spark.read.format("xml").option("rowTag", "TextStyle").schema("_ID string, _FONTFAMILY string, _FONTSIZE double, _FONTSTYLE string").load(path)
    style = F.coalesce("_FONTSTYLE", F.lit(""))
    return raw.select(F.col("_ID").alias("style"), F.col("_FONTFAMILY").alias("font"), F.col("_FONTSIZE").alias("size"), style.contains("bold").alias("bold"), style.contains("italics").alias("italic"), style.contains("superscript").alias("superscript"))


def html_text_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> page_id, place, text: the text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    nodes = F.filter(F.split(bare, r"(?s)<[^>]*>"), lambda x: F.trim(x) != "")
    return pages.select("page_id", F.posexplode(nodes).alias("place", "text"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: their path as doc_id, and their text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """Feature files (a row a line, blank lines between sequences): file, seq_id, rows array<array<string>>."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("seq_id", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    return raw.select("file", "seq_id", F.transform(lines, lambda x: F.split(x, "[ \t]+")).alias("rows")).where(F.size("rows") > 0)


def xml_escaped(text: Column) -> Column:
    """Text for XML: control characters left out, the five characters as references."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tei_record(title: Column, authors: Column, year: Column, identifier: Column) -> Column:
    """One bibliographic record as a biblStruct element."""
    people = F.array_join(F.transform(authors, lambda a: F.concat(F.lit("<author><persName><surname>"), xml_escaped(a), F.lit("</surname></persName></author>"))), "")
    return F.concat(
        F.lit('<biblStruct xml:id="'), xml_escaped(identifier), F.lit('"><analytic><title level="a">'), xml_escaped(F.coalesce(title, F.lit(""))), F.lit("</title>"), people,
        F.lit("</analytic><monogr><imprint>"), F.coalesce(F.concat(F.lit('<date type="published" when="'), year.cast("string"), F.lit('"/>')), F.lit("")), F.lit("</imprint></monogr></biblStruct>"),
    )


def bibtex_record(identifier: Column, title: Column, authors: Column, year: Column) -> Column:
    """One record as a BibTeX entry; fields without a value are left out."""
    fields = F.array_compact(F.array(F.concat(F.lit("  author = {"), F.array_join(authors, " and "), F.lit("}")), F.concat(F.lit("  title = {"), title, F.lit("}")), F.concat(F.lit("  year = {"), year.cast("string"), F.lit("}"))))
    return F.concat(F.lit("@article{"), identifier, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))
