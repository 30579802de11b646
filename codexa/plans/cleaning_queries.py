"""Queries on field cleaning, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.functions import cleaning as C
from codexa.functions import text as T
from codexa.plans.text_queries import _LINES, TOKEN_SQL, _normal_sql, read


def _texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


def _lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.explode(F.split("t", "\n")).alias("line"))


def text_without_spaces(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.without_spaces(F.col("t"))).alias("digest"))


def shadow_numbers(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.shadowed_numbers(F.col("t"))).alias("digest"))


def edge_tokens(spark, sf_dir):
    t = F.concat(F.lit("  "), F.col("line"))
    return _lines(spark, sf_dir).groupBy(C.first_token(t).alias("first"), C.last_token(t).alias("last")).agg(F.count(F.lit(1)).alias("n"))


def text_counts(spark, sf_dir):
    t = F.col("t")
    return _texts(spark, sf_dir).select("doc_id", C.digit_count(t).cast("long").alias("n_digits"), C.occurrences(t, "the").alias("n_the"), F.size(T.tokens(t)).cast("long").alias("n_tokens"))


def capitalise_fully(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.capitalised(F.col("t"), " -\n")).alias("digest"))


def strip_edges(spark, sf_dir):
    line = F.concat(F.lit(".,( "), F.col("line"), F.lit(" ;.)"))
    return _lines(spark, sf_dir).select("doc_id", C.stripped(line, ".,( ", ");. ").alias("line")).groupBy("doc_id").agg(F.sum(F.length("line")).alias("n_chars"), F.min("line").alias("least"))


def remove_field_stopwords(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.without_stopwords(F.concat(F.col("t"), F.lit(" the author's, and. for")))).alias("digest"))


def filter_lines(spark, sf_dir):
    marked = _lines(spark, sf_dir).withColumn("line", F.when(F.col("line").rlike("^[A-D]"), F.concat(F.lit("@PAGE "), F.col("line"))).otherwise(F.col("line")))
    return marked.where(~C.is_noise_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("n_chars"))


def escape_text(spark, sf_dir):
    t = F.concat(F.col("t"), F.lit(" \"it's\" 5% a_b\n"))
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.json_escaped(t)).alias("json"), F.md5(C.sql_escaped(t)).alias("sql"), F.sha1(t).alias("sha1"))


def clean_isbn(spark, sf_dir):
    k = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    raw = F.concat(F.lit(" 978-"), F.substring(k, 1, 1), F.lit("-"), F.substring(k, 2, 4), F.lit(" "), F.substring(k, 6, 4), F.lit("'-X"))
    return read(spark, sf_dir, "part").select("p_partkey", C.isbn(raw).alias("isbn"))


def clean_abstract(spark, sf_dir):
    heads = F.array(*(F.lit(x) for x in ("Abstract: ", "SUMMARY", "Résumé. ", "A b s t r a c t) ", "")))
    t = F.concat(F.element_at(heads, F.pmod(F.col("doc_id"), F.lit(5)).cast("int") + 1), F.col("t"), F.lit(" ( x )"))
    return _texts(spark, sf_dir).select("doc_id", F.md5(C.abstract(t)).alias("digest"))


def citation_styles(spark, sf_dir):
    k, y = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    forms = F.array(F.concat(F.lit("(Meier, "), y, F.lit(")")), F.concat(F.lit("["), k, F.lit("]")), F.concat(F.lit("Naze et al. ["), k, F.lit("]")), F.concat(F.lit("see "), k), F.concat(F.lit("("), k, F.lit("-"), k, F.lit(","), k, F.lit(")")), F.lit("ibid."))
    m = F.element_at(forms, (F.col("o_orderkey") % 6).cast("int") + 1)
    return read(spark, sf_dir, "orders").select("o_orderkey", C.is_author_style(m).alias("by_author"), C.is_numbered_style(m).alias("numbered"))


def script_languages(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in (*C.SCRIPT_LANGUAGES, "latin", "unknown")))
    script = F.element_at(names, (F.col("l_partkey") % 9).cast("int") + 1)
    return read(spark, sf_dir, "lineitem").groupBy(C.language_of_script(script).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def arxiv_ids(spark, sf_dir):
    k = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    forms = F.array(F.concat(F.lit("arXiv:2101."), k, F.lit("v3[cs.CR]")), F.concat(F.lit("ARXIV:math.AG/01"), k, F.lit("v1")), F.concat(F.lit("1999."), k), F.concat(F.lit("doi "), k))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.arxiv_id(F.element_at(forms, (F.col("o_orderkey") % 4).cast("int") + 1)).alias("arxiv"))


def replace_fields(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.upper("p_name"), F.lit("!"))).when(F.col("p_size") % 4 == 2, F.substring("p_name", 1, 4)).otherwise(F.lit(""))
    words = F.split("p_name", " ")
    return p.select("p_partkey", C.better_text(found, F.col("p_name")).alias("text"), C.better_names(F.slice(words, 1, 2), F.concat(words, F.split("p_brand", " "))).alias("names"))


def email_addresses(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    forms = F.array(
        F.concat(F.lit("{Ann"), k, F.lit(", Bob"), k, F.lit("}@Lab.Example.org")), F.concat(F.lit("E-mail: a"), k, F.lit("@x.org or b"), k, F.lit("@y.org; a"), k, F.lit("@x.org")),
        F.concat(F.lit("Electronic Address: c"), k, F.lit("&#64;z.org")), F.concat(F.lit("Peter Pan* - p"), k, F.lit("@.q.org")), F.concat(F.lit("editor"), k, F.lit("@x.org")), F.concat(F.lit("none"), k),
    )
    found = C.addresses(F.element_at(forms, (F.col("c_custkey") % 6).cast("int") + 1))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, " ").alias("addresses"))


_TEXTS = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
_STOP = ", ".join(f"'{x}'" for x in C.STOPWORDS)
# an escaped at-sign holds a semicolon, where addresses part, so form 2 has none
_ADDRESS = "CASE c_custkey % 6 WHEN 0 THEN 'ann' || c_custkey || '@lab.example.org bob' || c_custkey || '@lab.example.org' WHEN 1 THEN 'a' || c_custkey || '@x.org b' || c_custkey || '@y.org' WHEN 3 THEN 'p' || c_custkey || '@q.org' END"

SQL = {
    "text_without_spaces": "SELECT doc_id, md5(translate(n, ' ' || chr(10), '')) AS digest FROM (SELECT doc_id, " + _normal_sql("t") + f" AS n FROM ({_TEXTS}))",
    "shadow_numbers": f"SELECT doc_id, md5(translate(t, '0123456789', 'XXXXXXXXXX')) AS digest FROM ({_TEXTS})",
    "edge_tokens": f"SELECT string_split(ltrim('  ' || line, ' '), ' ')[1] AS first, string_split('  ' || line, ' ')[-1] AS last, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2",
    "text_counts": f"SELECT doc_id, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, len(string_split(t, 'the')) - 1 AS n_the, len(regexp_extract_all(t, '{TOKEN_SQL}'))::BIGINT AS n_tokens FROM ({_TEXTS})",
    "capitalise_fully": f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(t, '[ \\-\\n]+|[^ \\-\\n]+'), lambda x: replace(upper(left(x, 1)), 'ẞ', 'SS') || lower(substr(x, 2))), '')) AS digest FROM ({_TEXTS})",
    "strip_edges": f"SELECT doc_id, sum(length(l))::BIGINT AS n_chars, min(l) AS least FROM (SELECT doc_id, rtrim(ltrim('.,( ' || line || ' ;.)', '.,( '), ');. ') AS l FROM ({_LINES})) GROUP BY doc_id",
    "remove_field_stopwords": f"SELECT doc_id, md5(regexp_replace(translate(replace(array_to_string(list_filter(regexp_extract_all(t || ' the author''s, and. for', '{TOKEN_SQL}'), lambda x: x NOT IN ({_STOP})), ''), '''s', ' '), ',.', '  '), ' +', ' ', 'g')) AS digest FROM ({_TEXTS})",
    "filter_lines": f"SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS n_chars FROM ({_LINES}) WHERE line <> '' AND NOT regexp_matches(line, '^[A-D]') AND NOT contains(line, '@IMAGE') AND NOT contains(line, '@PAGE') GROUP BY doc_id",
    "escape_text": "SELECT doc_id, md5(replace(replace(t, '\"', '\\\"'), chr(10), '\\' || chr(10))) AS json, md5(replace(replace(replace(t, '''', '\\'''), '%', '\\%'), '_', '\\_')) AS sql, sha1(t) AS sha1 FROM (SELECT doc_id, coalesce(text, '') || ' \"it''s\" 5% a_b' || chr(10) AS t FROM documents)",
    "clean_isbn": "SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') || 'X' AS isbn FROM part",
    "clean_abstract": f"""WITH a AS (SELECT doc_id, doc_id % 5 AS k, trim(regexp_replace(t || ' ( x )', '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t, t AS raw FROM ({_TEXTS})),
      b AS (SELECT doc_id, CASE WHEN k = 4 THEN t WHEN k = 1 THEN trim(regexp_replace('SUMMARY' || raw || ' ( x )', '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))[8:] ELSE '.' || ' ' || t END AS t FROM a),
      c AS (SELECT doc_id, CASE WHEN left(t, 1) IN ('.', ':', ')') THEN trim(substr(t, 2)) ELSE t END AS t FROM b)
      SELECT doc_id, md5(replace(replace(replace(t, '( ', '('), ' )', ')'), '  ', ' ')) AS digest FROM c""",
    "citation_styles": "SELECT o_orderkey, o_orderkey % 6 = 0 OR (o_orderkey % 6 = 2 AND regexp_matches(o_orderkey::VARCHAR, '[12][0-9]{3}')) AS by_author, o_orderkey % 6 IN (0, 1, 2, 4) AS numbered FROM orders",
    "script_languages": "SELECT ['ru', 'el', 'ar', 'he', 'zh', 'hi', 'th', NULL, NULL][(l_partkey % 9 + 1)::INT] AS lang, count(*) AS n FROM lineitem GROUP BY 1",
    "arxiv_ids": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2101.' || k WHEN 1 THEN 'math.AG/01' || k WHEN 2 THEN '1999.' || k END AS arxiv FROM (SELECT o_orderkey, lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS k FROM orders)",
    "replace_fields": "SELECT p_partkey, p_size % 4 = 3 OR (p_size % 4 = 2 AND length(p_name) > 5) AS text, TRUE AS names FROM part",
    "email_addresses": f"SELECT c_custkey, {_ADDRESS} AS addresses FROM customer",
}
QUERIES = {name: globals()[name] for name in SQL}
