"""Queries on text columns, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.functions import identifiers as I
from codexa.functions import text as T
from codexa.operators import sequences as S


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(text: str) -> str:
    return text.replace("'", "''")


TOKEN_SQL = _sql(T.TOKEN)
SOLID = "trim(tok, chr(9) || chr(10) || chr(12) || chr(13) || ' ' || chr(160) || chr(8204)) <> ''"


def _solid(tok):
    return F.trim(tok, F.lit("\t\n\f\r  ‌")) != ""


def _tokens(docs):
    return docs.select("doc_id", "lang", F.posexplode(T.tokens(F.coalesce("text", F.lit("")))).alias("pos", "tok"))


def token_stats_by_lang(spark, sf_dir):
    t = _tokens(read(spark, sf_dir, "documents")).where(_solid(F.col("tok")))
    caps = F.col("tok").rlike(r"^\p{Lu}{2,}$")
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.lower("tok")).alias("n_distinct"), F.sum(caps.cast("long")).alias("n_all_caps"))


def normalise_text(spark, sf_dir):
    dressed = F.concat(F.coalesce("text", F.lit("")), F.lit("  —‐ a\r\nb c （x） •· ∣"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(dressed)).alias("digest"), F.length(T.normalise(dressed)).alias("n"))


def _normal_sql(expr: str) -> str:
    for pattern, to in ((T.char_class(T.SPACES), " "), ("\r\n", "\n"), (T.char_class(T.LINE_BREAKS), "\n"), (T.DASHES, "-"), (T.char_class(T.LOW_LINES), "_"), (T.char_class(T.BARS), "|"), (T.char_class(T.BULLETS), "•"), (T.char_class(T.OPEN_PARENTHESES), "("), (T.char_class(T.CLOSE_PARENTHESES), ")")):
        expr = f"regexp_replace({expr}, '{_sql(pattern)}', '{to}', 'g')"
    return expr


def tokenize_keep_delims(spark, sf_dir):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "\u0001")).alias("digest"))


def token_offsets(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    t = _tokens(read(spark, sf_dir, "documents")).withColumn("len", F.length("tok").cast("long"))
    t = t.withColumn("offset", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nl", F.coalesce(F.lead("tok").over(w) == "\n", F.lit(False)))
    return t.groupBy("doc_id").agg(F.max("offset").alias("last_offset"), F.sum(F.col("nl").cast("long")).alias("line_ends"), F.sum(F.col("offset") % 1009).alias("offset_sum"))


def subdigit_split(spark, sf_dir):
    name = F.concat("p_name", F.lit("x"), F.col("p_size").cast("string"), F.lit("mm2"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.subdigit_parts(name), "|").alias("parts"))


def word_shape(spark, sf_dir):
    t = _tokens(read(spark, sf_dir, "documents")).where(_solid(F.col("tok"))).select("tok").distinct()
    return t.groupBy(T.word_shape(F.col("tok")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("tok").alias("example"))


def token_predicates(spark, sf_dir):
    t = _tokens(read(spark, sf_dir, "documents")).where(_solid(F.col("tok")))
    p = T.predicates(F.col("tok"))
    return t.groupBy("lang", T.punctuation_type(F.col("tok")).alias("punct_type")).agg(*(F.sum(c.cast("long")).alias(k) for k, c in p.items()), F.count(F.lit(1)).alias("n"))


def prefix_suffix_features(spark, sf_dir):
    t = _tokens(read(spark, sf_dir, "documents")).where(_solid(F.col("tok"))).select("lang", "tok").distinct()
    cols = [F.left("tok", F.lit(k)).alias(f"p{k}") for k in (1, 2, 3, 4)] + [F.right("tok", F.lit(k)).alias(f"s{k}") for k in (1, 2, 3, 4)]
    return t.select("lang", *cols).groupBy("lang").agg(*(F.count_distinct(c).alias(c) for c in ("p1", "p2", "p3", "p4", "s1", "s2", "s3", "s4")))


def punct_profile(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.punctuation_profile(F.coalesce("text", F.lit(""))).alias("profile"))


def line_pattern_repeats(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    p = lines.select("doc_id", T.letters_pattern(F.col("line")).alias("pattern")).where(F.length("pattern") > 8)
    return p.groupBy("pattern").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.md5("pattern").alias("pattern"), "n_docs", "n")


def linear_log_scaling(spark, sf_dir):
    pos, total = F.col("l_extendedprice"), F.lit(100000.0)
    a, b = T.linear_scaling(pos, total, 12).cast("long"), T.log_scaling(pos, total, 12).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(a.alias("linear_bin"), b.alias("log_bin")).agg(F.count(F.lit(1)).alias("n"))


def script_detect(spark, sf_dir):
    text = F.when(F.col("doc_id") % 7 == 0, F.translate("text", "abcdefghijklmn", "абвгдежзийклмн")).when(F.col("doc_id") % 7 == 1, F.translate("text", "abcdefghijklmnopqrst", "αβγδεζηθικλμνξοπρστυ")).otherwise(F.col("text"))
    counted = read(spark, sf_dir, "documents").select("doc_id", T.script_counts(F.coalesce(text, F.lit(""))).alias("c"))
    return counted.select("doc_id", T.script(F.col("c")).alias("script"), F.col("c.latin").cast("long").alias("latin"), F.col("c.greek").cast("long").alias("greek"), F.col("c.cyrillic").cast("long").alias("cyrillic"))


def sentence_split(spark, sf_dir):
    s = T.sentences(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\u0001")).alias("digest"))


def identifier_extract(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("see doi:10.1234/ab"), k, F.lit("., or mail a.b"), k, F.lit("@lab.example.org; https://x.example.org/p?q="), k, F.lit(", PMID: "), k)
    o = read(spark, sf_dir, "orders").withColumn("line", line)
    return o.select("o_orderkey", F.regexp_extract("line", I.DOI, 0).alias("doi"), F.regexp_extract("line", I.EMAIL, 0).alias("email"), F.regexp_extract("line", I.URL, 0).alias("url"), F.regexp_extract("line", I.PMID, 1).alias("pmid"), I.clean_doi(F.concat(F.lit("https://doi.org/10.1234/AB"), k, F.lit("]."))).alias("clean_doi"))


def clean_field(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    cleaned = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.clean_field(F.concat(F.lit(", ("), F.col("line"), F.lit(")., -"))).alias("c"))
    return cleaned.select("doc_id", "line_no", F.md5("c").alias("digest"))


def date_normalise(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    raw = F.element_at(F.array(F.date_format("o_orderdate", "d MMM yy"), F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format("o_orderdate", "d MM yyyy")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    parts = F.split(raw, " ")
    return o.select("o_orderkey", F.element_at(parts, 1).cast("long").alias("day"), I.month_number(F.element_at(parts, 2)).cast("long").alias("month"), I.pivot_year(F.element_at(parts, 3)).cast("long").alias("year"))


def page_range_expand(spark, sf_dir):
    a, b = F.col("l_partkey") % 900 + 100, F.col("l_suppkey") % 90 + 1
    raw = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", I.page_range(raw).alias("r"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "r.first", "r.last")


def keyword_segment(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "; ").when(F.col("p_partkey") % 3 == 1, ", ").otherwise(" and ")
    return p.select("p_partkey", F.posexplode(I.keyword_parts(F.concat(F.lit("Keywords: "), F.concat(F.col("p_name"), mark, F.col("p_brand"), mark, F.col("p_type"))))).alias("n", "keyword")).withColumn("n", F.col("n").cast("long"))


def dehyphenize_text(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" t-\nhe "))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenated(text)).alias("digest"))


def doc_stats(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    n = F.length("line").cast("long")
    return lines.groupBy("doc_id").agg(F.sum(n).alias("length"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count(F.lit(1)).alias("n_lines"))


def volume_issue(spark, sf_dir):
    raw = F.concat(F.lit("vol. "), (F.col("p_size")).cast("string"), F.lit("("), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", I.volume_issue(raw).alias("v")).select("p_partkey", F.col("v.volume").cast("long").alias("volume"), F.col("v.issue").cast("long").alias("issue"))


def person_names(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(F.lit("Prof. Dr. "), F.lit("Mr "), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_name"), F.lit("*,"))
    return read(spark, sf_dir, "customer").select("c_custkey", I.person_name(raw).alias("name"))


def callout_types(spark, sf_dir):
    k = F.col("l_linenumber").cast("string")
    forms = F.array(F.concat(F.lit("["), k, F.lit("]")), F.concat(F.lit("("), k, F.lit(")")), F.concat(F.lit("[Smith "), k, F.lit("]")), F.concat(F.lit("(Smith, "), k, F.lit(")")), k, F.lit("iv"), F.lit("?"))
    raw = F.element_at(forms, (F.col("l_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").groupBy(I.callout_type(raw, F.col("l_returnflag") == "R").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def identifier_kinds(spark, sf_dir):
    k = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    forms = F.array(F.concat(F.lit("doi 10.1234/"), k, F.lit("x")), F.concat(F.lit("arXiv:1234."), k), F.concat(F.lit("PMID: "), k), F.concat(F.lit("PMC"), k), F.concat(F.lit("1234-"), F.substring(k, 2, 3), F.lit("X")), F.concat(F.lit("978-12345"), k, F.lit("-1")), F.lit("none"))
    return read(spark, sf_dir, "part").select("p_partkey", I.identifier_kind(F.element_at(forms, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("kind"))


def range_label_expand(spark, sf_dir):
    a = F.col("l_linenumber")
    b = a + (F.col("l_orderkey") % 25).cast("int")
    marker = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("["), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("("), a.cast("string"), F.lit(", "), b.cast("string"), F.lit(")")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(S.expanded_range(marker)).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


D = "SELECT doc_id, lang, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '" + TOKEN_SQL + "') AS t FROM documents)"
_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents"
_SHAPE = r"translate(regexp_replace(regexp_replace(regexp_replace(tok, '\p{Lu}', chr(1), 'g'), '\p{L}', 'x', 'g'), '\p{Nd}', 'd', 'g'), chr(1), 'X')"
_SCRIPT_ALL = "".join(T.SCRIPTS.values())

SQL = {
    "token_stats_by_lang": rf"SELECT lang, count(*) AS n_tokens, count(DISTINCT lower(tok)) AS n_distinct, sum(CASE WHEN regexp_full_match(tok, '\p{{Lu}}{{2,}}') THEN 1 ELSE 0 END)::BIGINT AS n_all_caps FROM ({D}) WHERE {SOLID} GROUP BY lang",
    "normalise_text": "SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, " + _normal_sql("(coalesce(text, '') || '  —‐ a\r\nb c （x） •· ∣')") + " AS t FROM documents)",
    "tokenize_keep_delims": f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS t FROM documents)",
    "token_offsets": f"SELECT doc_id, max(o)::BIGINT AS last_offset, sum(nl)::BIGINT AS line_ends, sum(o % 1009)::BIGINT AS offset_sum FROM (SELECT doc_id, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, CASE WHEN coalesce(lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) = chr(10), false) THEN 1 ELSE 0 END AS nl FROM ({D})) GROUP BY doc_id",
    "subdigit_split": r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name || 'x' || p_size || 'mm2', '\d+|\D+'), '|') AS parts FROM part",
    "word_shape": f"""WITH s AS (SELECT tok, {_SHAPE} AS sh FROM (SELECT DISTINCT tok FROM ({D}) WHERE {SOLID})),
      m AS (SELECT tok, sh, CASE WHEN length(tok) > 3 THEN substr(sh, 2, length(tok) - 3) ELSE '' END AS mid FROM s),
      f AS (SELECT tok, sh, array_to_string([mid[i] FOR i IN range(1, length(mid) + 1) IF i = 1 OR mid[i] <> mid[i - 1]], '') AS mid FROM m)
      SELECT substr(sh, 1, 1) || mid || CASE WHEN length(tok) > 2 THEN right(sh, 2) WHEN length(tok) > 1 THEN right(sh, 1) ELSE '' END AS shape, count(*) AS n, min(tok) AS example FROM f GROUP BY 1""",
    "token_predicates": rf"""SELECT lang, CASE WHEN tok IN ('''', '"', '`', '“', '”', '‘', '’') THEN 'QUOTE' WHEN tok IN ('-', '–') THEN 'HYPHEN' WHEN tok = ',' THEN 'COMMA' WHEN tok = '.' THEN 'DOT' WHEN tok IN (')', ']') THEN 'ENDBRACKET' WHEN tok IN ('(', '[') THEN 'OPENBRACKET' WHEN regexp_full_match(tok, '[,:;?.]+') THEN 'PUNCT' ELSE 'NOPUNCT' END AS punct_type,
      sum(regexp_matches(tok, '^\p{{Lu}}')::INT)::BIGINT AS first_capital, sum((NOT regexp_matches(tok, '\p{{Ll}}'))::INT)::BIGINT AS all_capital, sum((length(tok) = 1)::INT)::BIGINT AS single_char,
      sum(regexp_matches(tok, '[0-9]')::INT)::BIGINT AS has_digit, sum(regexp_full_match(tok, '[0-9]+')::INT)::BIGINT AS all_digit, sum(regexp_full_match(tok, '[0-9.,]*[0-9][0-9.,]*')::INT)::BIGINT AS complex_number,
      sum(regexp_matches(tok, '[1,2][0-9][0-9][0-9]')::INT)::BIGINT AS year, sum(regexp_matches(tok, 'https?')::INT)::BIGINT AS http, sum(regexp_matches(tok, '[A-Z]\.([A-Z]\.)*')::INT)::BIGINT AS acronym, count(*) AS n
      FROM ({D}) WHERE {SOLID} GROUP BY 1, 2""",
    "prefix_suffix_features": f"SELECT lang, {', '.join(f'count(DISTINCT left(tok, {k})) AS p{k}, count(DISTINCT right(tok, {k})) AS s{k}' for k in (1, 2, 3, 4))} FROM ({D}) WHERE {SOLID} GROUP BY lang",
    "punct_profile": f"SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '{_sql(T.char_class(T.PUNCTUATION.replace(' ', ''), True))}', '', 'g') AS profile FROM conversations",
    "line_pattern_repeats": f"SELECT md5(pattern) AS pattern, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, lower(regexp_replace(line, '[^a-zA-Z]', '', 'g')) AS pattern FROM ({_LINES})) WHERE length(pattern) > 8 GROUP BY pattern HAVING count(*) > 1",
    "linear_log_scaling": "SELECT CASE WHEN p <= 0 THEN 0 WHEN p >= 100000 THEN 12 ELSE trunc(p / 100000.0::DOUBLE * 12)::BIGINT END AS linear_bin, CASE WHEN p <= 0 THEN 0 WHEN p >= 100000 THEN 12 ELSE trunc(ln(p + 1) / ln(100001.0::DOUBLE) * 12)::BIGINT END AS log_bin, count(*) AS n FROM (SELECT l_extendedprice AS p FROM lineitem) GROUP BY 1, 2",
    "script_detect": rf"""WITH d AS (SELECT doc_id, left(regexp_replace(coalesce(CASE WHEN doc_id % 7 = 0 THEN translate(text, 'abcdefghijklmn', 'абвгдежзийклмн') WHEN doc_id % 7 = 1 THEN translate(text, 'abcdefghijklmnopqrst', 'αβγδεζηθικλμνξοπρστυ') ELSE text END, ''), '[^{_SCRIPT_ALL}]', '', 'g'), 200) AS k FROM documents),
      c AS (SELECT doc_id, {', '.join(f"length(regexp_replace(k, '[^{r}]', '', 'g')) AS {n}" for n, r in T.SCRIPTS.items())} FROM d)
      SELECT doc_id, CASE WHEN greek + cyrillic + hebrew + arabic + devanagari + thai + cjk < 8 THEN 'latin' WHEN latin >= greatest(greek, cyrillic) THEN 'latin' WHEN greek >= cyrillic THEN 'greek' ELSE 'cyrillic' END AS script, latin, greek, cyrillic FROM c""",
    "sentence_split": rf"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string([CASE WHEN regexp_matches(x, '[.?!]\s+$') THEN rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE x END FOR x IN s], chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.SENTENCE}') AS s FROM documents)",
    "identifier_extract": rf"SELECT o_orderkey, regexp_extract(line, '{I.DOI}') AS doi, regexp_extract(line, '{I.EMAIL}') AS email, regexp_extract(line, '{I.URL}') AS url, regexp_extract(line, '{I.PMID}', 1) AS pmid, '10.1234/AB' || o_orderkey AS clean_doi FROM (SELECT o_orderkey, 'see doi:10.1234/ab' || o_orderkey || '., or mail a.b' || o_orderkey || '@lab.example.org; https://x.example.org/p?q=' || o_orderkey || ', PMID: ' || o_orderkey AS line FROM orders)",
    "clean_field": rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
      a AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(replace(replace(', (' || line || ')., -', ',,', ','), ', ,', ','), '[, .\-_/:]+$', ''), '^[, .;\-_:]+', '')) AS t FROM l),
      b AS (SELECT doc_id, line_no, CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN trim(substr(t, 2, length(t) - 2)) ELSE t END AS t FROM a)
      SELECT doc_id, line_no, md5(trim(regexp_replace(t, '( (the|of|and|du|de le|de la|des|der|an|und|for))+$', ''))) AS digest FROM b""",
    "date_normalise": "SELECT o_orderkey, day(o_orderdate) AS day, month(o_orderdate) AS month, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN year(o_orderdate) % 100 >= 20 THEN 1900 + year(o_orderdate) % 100 ELSE 2000 + year(o_orderdate) % 100 END ELSE year(o_orderdate) END AS year FROM orders",
    "page_range_expand": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, a AS first, CASE WHEN length(b::VARCHAR) < length(a::VARCHAR) THEN (left(a::VARCHAR, length(a::VARCHAR) - length(b::VARCHAR)) || b)::BIGINT ELSE b END AS last FROM (SELECT *, l_partkey % 900 + 100 AS a, l_suppkey % 90 + 1 AS b FROM lineitem)",
    "keyword_segment": "SELECT p_partkey, generate_subscripts(k, 1) - 1 AS n, unnest(k) AS keyword FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN [trim(p_name), trim(p_brand), trim(p_type)] ELSE [p_name || ' and ' || p_brand || ' and ' || p_type] END AS k FROM part)",
    "dehyphenize_text": r"SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), ' the ', ' t-' || chr(10) || 'he '), '(\p{L})-[ \t]*\n[ \t]*(\p{Ll}+)', '\1\2', 'g')) AS digest FROM documents",
    "doc_stats": f"SELECT doc_id, sum(length(line))::BIGINT AS length, min(length(line)) AS shortest, max(length(line)) AS longest, count(*) AS n_lines FROM ({_LINES}) GROUP BY doc_id",
    "volume_issue": "SELECT p_partkey, p_size::BIGINT AS volume, p_partkey % 12 + 1 AS issue FROM part",
    "person_names": "SELECT c_custkey, regexp_replace(c_name, '[0-9]+$', '') AS name FROM customer",
    "callout_types": "SELECT CASE k WHEN 0 THEN 'BRACKET_NUMBER' WHEN 1 THEN 'PARENTHESIS_NUMBER' WHEN 2 THEN 'BRACKET_TEXT' WHEN 3 THEN 'PARENTHESIS_TEXT' WHEN 4 THEN CASE WHEN r THEN 'SUPERSCRIPT_NUMBER' ELSE 'NUMBER' END WHEN 5 THEN 'ROMAN' ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM (SELECT l_orderkey % 7 AS k, l_returnflag = 'R' AS r FROM lineitem) GROUP BY 1",
    "identifier_kinds": "SELECT p_partkey, [NULL, 'doi', 'arxiv', 'pmid', 'pmcid', 'issn', 'isbn'][((p_partkey % 7 + 1) % 7 + 1)::INT] AS kind FROM part",
    "range_label_expand": "WITH m AS (SELECT l_linenumber AS a, (l_linenumber + l_orderkey % 25)::INT AS b, l_orderkey % 2 = 0 AS wide FROM lineitem), x AS (SELECT '[' || unnest(range(a, b + 1)) || ']' AS label FROM m WHERE wide AND b - a < 20 UNION ALL SELECT '(' || unnest([a, b]) || ')' FROM m WHERE NOT wide) SELECT label, count(*) AS n FROM x GROUP BY label",
}
QUERIES = {name: globals()[name] for name in SQL}
