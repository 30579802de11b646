"""Queries on records and features, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.operators import records as R
from codexa.plans.text_queries import D, _tokens, read


def _spans(spark, sf_dir):
    labels = F.array(*(F.lit(x) for x in ("title", "author", "journal", "date", "volume", "pages", "other")))
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey")).alias("doc_id"), F.element_at(labels, (F.col("l_partkey") % 7 + 1).cast("int")).alias("label"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("pos"), F.repeat(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("text"),
    ).distinct()


def citation_fields(spark, sf_dir):
    return R.merged_fields(_spans(spark, sf_dir), ["doc_id"], "citation").select("doc_id", "title", "author", "journal", "date", "volume", "pages")


def header_fields(spark, sf_dir):
    return R.merged_fields(_spans(spark, sf_dir), ["doc_id"], "header").select("doc_id", "title", "author", "journal", "date", "page")


def date_features(spark, sf_dir):
    rows = R.feature_rows(_tokens(read(spark, sf_dir, "documents")), ["doc_id"], "pos", "tok")
    c = lambda k: F.element_at("cols", k)
    return rows.groupBy(c(11).alias("line_status"), c(12).alias("caps"), c(13).alias("digits"), c(17).alias("punct")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c(6)).alias("n_prefixes"))


def iso_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    y, m, d = F.year("o_orderdate"), F.when(F.col("o_orderkey") % 4 != 0, F.month("o_orderdate")), F.when(F.col("o_orderkey") % 4 > 1, F.day("o_orderdate"))
    return o.select("o_orderkey", R.iso_date(y, m, d).alias("iso"))


def best_date(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    y, m, d = F.year("o_orderdate"), F.when(F.col("o_orderkey") % 4 != 0, F.month("o_orderdate")), F.when(F.col("o_orderkey") % 4 > 1, F.day("o_orderdate"))
    return o.groupBy("o_custkey").agg(F.min_by(R.iso_date(y, m, d), R.date_order(y, m, d)).alias("best"))


def crossref_works(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    work = F.concat(F.lit('{"DOI":"10.1/A'), k, F.lit('","title":["T '), k, F.lit('"],"author":[{"given":"A","family":"F'), k, F.lit('"}],"page":"'), k, F.lit('-9","issued":{"date-parts":[['), F.year("o_orderdate").cast("string"), F.lit(",1]]}}"))
    message = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"message":{"items":['), work, F.lit("]}}"))).otherwise(F.concat(F.lit('{"message":'), work, F.lit("}")))
    w = R.works(o.select(message.alias("json")))
    return w.select("doi", "title", F.element_at("surnames", 1).alias("surname"), "first_page", F.col("year").cast("long").alias("year"))


def openurl_emit(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", R.openurl({"title": F.col("p_name"), "volume": F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))}).alias("url"))


def section_numbers(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(". "), (k % 5 + 1).cast("string"), F.lit(" "), F.col("p_name"))).when(k % 3 == 1, F.concat(F.lit("IV. "), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", R.section_number(head).alias("s")).select("p_partkey", "s.number", "s.title")


def coordinate_strings(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    box = F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("w"), F.lit(1.5).alias("h"))
    return li.groupBy("l_orderkey").agg(F.max_by(R.coordinates(F.lit(1), F.array(box, box)), F.struct("l_quantity", "l_discount", "l_tax")).alias("coords"))


_L = "['title', 'author', 'journal', 'date', 'volume', 'pages', 'other'][(l_partkey % 7 + 1)::INT]"
_SPANS = f"SELECT DISTINCT l_orderkey AS doc_id, {_L} AS label, (l_linenumber * 1000000 + l_partkey)::BIGINT AS pos, repeat('t' || l_suppkey, (l_suppkey % 3 + 1)::INT) AS text FROM lineitem"
_FIRST, _LAST = "arg_min(text, (pos, text)) FILTER (label = '{0}')", "arg_max(text, (pos, text)) FILTER (label = '{0}')"
_LONGEST = "arg_max(text, (length(text), -pos, text)) FILTER (label = '{0}')"
_JOIN = "string_agg(text, '{1}' ORDER BY pos, text) FILTER (label = '{0}')"
_SOLID = "trim(tok, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) <> ''"

SQL = {
    "citation_fields": f"SELECT doc_id, {_LONGEST.format('title')} AS title, {_JOIN.format('author', ' ; ')} AS author, {_LONGEST.format('journal')} AS journal, {_JOIN.format('date', '. ')} AS date, {_FIRST.format('volume')} AS volume, {_LAST.format('pages')} AS pages FROM ({_SPANS}) GROUP BY doc_id",
    "header_fields": f"SELECT doc_id, {_FIRST.format('title')} AS title, string_agg(text, chr(9) ORDER BY pos, text) FILTER (label = 'author') AS author, {_FIRST.format('journal')} AS journal, {_LONGEST.format('date')} AS date, NULL::VARCHAR AS page FROM ({_SPANS}) GROUP BY doc_id",
    "date_features": rf"""WITH t AS (SELECT *, lag(tok) OVER o AS p, lead(tok) OVER o AS n FROM ({D}) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
      s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t WHERE {_SOLID})
      SELECT CASE WHEN coalesce(p = chr(10), true) OR k = 1 THEN 'LINESTART' WHEN coalesce(n = chr(10), true) THEN 'LINEEND' ELSE 'LINEIN' END AS line_status,
      CASE WHEN regexp_full_match(tok, '[0-9]+') THEN 'NOCAPS' WHEN NOT regexp_matches(tok, '\p{{Ll}}') THEN 'ALLCAP' WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'INITCAP' ELSE 'NOCAPS' END AS caps,
      CASE WHEN regexp_full_match(tok, '[0-9]+') THEN 'ALLDIGIT' WHEN regexp_matches(tok, '[0-9]') THEN 'CONTAINSDIGITS' ELSE 'NODIGIT' END AS digits,
      CASE WHEN tok IN ('''', '"', '`', '“', '”', '‘', '’') THEN 'QUOTE' WHEN tok IN ('-', '–') THEN 'HYPHEN' WHEN tok = ',' THEN 'COMMA' WHEN tok = '.' THEN 'DOT' WHEN tok IN (')', ']') THEN 'ENDBRACKET' WHEN tok IN ('(', '[') THEN 'OPENBRACKET' WHEN regexp_full_match(tok, '[,:;?.]+') THEN 'PUNCT' ELSE 'NOPUNCT' END AS punct,
      count(*) AS n, count(DISTINCT left(tok, 4)) AS n_prefixes FROM s GROUP BY 1, 2, 3, 4""",
    "iso_dates": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "best_date": "SELECT o_custkey, arg_min(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END, (year(o_orderdate), CASE WHEN o_orderkey % 4 = 0 THEN 99 ELSE month(o_orderdate) END, CASE WHEN o_orderkey % 4 < 2 THEN 99 ELSE day(o_orderdate) END)) AS best FROM orders GROUP BY o_custkey",
    "crossref_works": "SELECT '10.1/a' || o_orderkey AS doi, 'T ' || o_orderkey AS title, 'F' || o_orderkey AS surname, o_orderkey::VARCHAR AS first_page, year(o_orderdate) AS year FROM orders",
    "openurl_emit": "SELECT p_partkey, 'title=' || replace(replace(url_encode(p_name), '%20', '+'), '#', '%23') || CASE WHEN p_size > 25 THEN '&volume=' || p_size ELSE '' END AS url FROM part",
    "section_numbers": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 9 + 1) || '.' || (p_partkey % 5 + 1) WHEN 1 THEN 'IV' ELSE '' END AS number, p_name AS title FROM part",
    "coordinate_strings": "SELECT l_orderkey, arg_max(c || ';' || c, (l_quantity, l_discount, l_tax)) AS coords FROM (SELECT *, printf('1,%.2f,%.2f,%.2f,1.50', l_quantity, l_discount, l_tax) AS c FROM lineitem) GROUP BY l_orderkey",
}
QUERIES = {name: globals()[name] for name in SQL}
