"""Queries on sequences, intervals, joins, layout, models and plain relations, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.operators import crf, layout, matching
from codexa.operators import sequences as S
from codexa.plans.text_queries import SOLID, TOKEN_SQL, D, _solid, _tokens, read
from codexa.sources import readers
from codexa.streaming import events as E


def label_islands(spark, sf_dir):
    runs = S.clusters(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_islands"), F.max("n").alias("longest"), F.sum("n").alias("n_events"))


def prev_label_fix(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(w))
    fixed = F.when((F.col("event_type") == "purchase") & F.coalesce(F.col("prev") == "view", F.lit(False)), F.col("prev")).otherwise(F.col("event_type"))
    return e.groupBy(fixed.alias("label"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def align_by_ordinal(spark, sf_dir):
    raw = _tokens(read(spark, sf_dir, "documents")).select("doc_id", "pos", "tok")
    labels = raw.where(F.trim("tok") != "").withColumn("label", F.when(F.col("tok").rlike("^[0-9]"), "<number>").otherwise("<word>"))
    joined = S.aligned(labels, raw, ["doc_id"], "pos", "tok")
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("agrees")).cast("long")).alias("n_wrong"), F.sum("pos").alias("pos_sum"))


def interval_coalesce(spark, sf_dir):
    days = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    spans = read(spark, sf_dir, "lineitem").select("l_suppkey", days.alias("start"), (days + F.col("l_linenumber")).alias("stop"))
    return S.coalesced(spans, ["l_suppkey"], "start", "stop").select("l_suppkey", "start", "stop", "parts")


def interval_token_flags(spark, sf_dir):
    tokens = read(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("place"))
    spans = tokens.where("event_id % 10 = 3").select("user_id", F.col("place").alias("start"), (F.col("place") + 2).alias("stop"))
    flagged = S.flag_inside(tokens, spans, ["user_id"], "place", "start", "stop", "inside")
    return flagged.groupBy("user_id").agg(F.sum(F.col("inside").cast("long")).alias("n_inside"), F.count(F.lit(1)).alias("n"))


def _boxes(spark, sf_dir, *more):
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 500).alias("doc_id"), (c("l_linenumber") % 4 + 1).cast("long").alias("page"), c("l_partkey").alias("block"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 1000000 + c("l_partkey")).alias("ord"),
        (c("l_suppkey") % 50 * 10).cast("double").alias("x"), F.floor(c("l_quantity")).cast("double").alias("y"), (c("l_partkey") % 30 + 5).cast("double").alias("w"), (c("l_partkey") % 20 + 10).cast("double").alias("h"), *more,
    )


_BOXES = "SELECT l_orderkey % 500 AS doc_id, (l_linenumber % 4 + 1)::BIGINT AS page, l_partkey AS block, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, (l_suppkey % 50 * 10)::DOUBLE AS x, floor(l_quantity)::DOUBLE AS y, (l_partkey % 30 + 5)::DOUBLE AS w, (l_partkey % 20 + 10)::DOUBLE AS h FROM lineitem"
_ROLES = _BOXES.replace(" FROM lineitem", ", coalesce(l_linestatus = 'O', false) AS role FROM lineitem")


def box_union(spark, sf_dir):
    return layout.united(_boxes(spark, sf_dir), ["doc_id", "page"])


def box_lines(spark, sf_dir):
    return layout.line_boxes(_boxes(spark, sf_dir), ["doc_id", "page"], ["ord", "x", "y", "w", "h"], drop=12, gap=200)


def page_main_area(spark, sf_dir):
    big = _boxes(spark, sf_dir).withColumn("w", F.col("w") * 10).withColumn("h", F.col("h") * 2)
    return layout.main_areas(big)


def block_spacing(spark, sf_dir):
    b = _boxes(spark, sf_dir).groupBy("doc_id", "page", "block").agg(F.min("y").alias("y"), F.max("h").alias("h"))
    return layout.block_spacing(b).groupBy("doc_id", "page").agg(F.count("spacing").alias("n"), F.min("spacing").alias("least"), F.max("spacing").alias("most"))


def _roles(spark, sf_dir):
    """All boxes, each a caption (or block) or a graphic."""
    return _boxes(spark, sf_dir, F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).alias("caption"))


def connected_boxes(spark, sf_dir):
    b = _roles(spark, sf_dir)
    up = b.where("caption").select("doc_id", "page", F.col("ord").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xywh"))
    down = b.where("not caption").select("doc_id", "page", F.col("ord").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xywh"))
    near = F.least(F.abs(F.col("by") - F.col("ay") - F.col("ah")), F.abs(F.col("ay") - F.col("by") - F.col("bh"))) < 100
    return layout.paired(up, down, ["doc_id", "page"], ["bx", "by"]).where(near).select("doc_id", "page", "a", "b", layout.intersects("a", "b").alias("overlap"))


def nearest_graphic(spark, sf_dir):
    b = _roles(spark, sf_dir)
    left = b.where("caption").select("doc_id", "page", F.col("ord").alias("caption"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = b.where("not caption").select("doc_id", "page", F.col("ord").alias("graphic"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return layout.nearest(left, right, ["doc_id", "page"], "caption", "graphic", 300).select("doc_id", "page", "caption", "graphic", "distance")


def marker_majority(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("doc_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("marker"))
    return S.majority(rows, ["doc_id"], "kind", "marker")


def gazetteer_match(spark, sf_dir):
    tokens = _tokens(read(spark, sf_dir, "documents")).where(_solid(F.col("tok")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    tokens = tokens.select("doc_id", F.row_number().over(w).cast("long").alias("place"), "tok")
    words = F.filter(T.tokens(F.lower("text")), lambda x: F.trim(x) != "")
    b = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    terms = b.select((F.col("item_id") * 10 + 1).alias("term_id"), F.slice("w", 1, 2).alias("words")).unionByName(b.select((F.col("item_id") * 10 + 2).alias("term_id"), F.slice("w", 3, 3).alias("words")))
    hits = matching.gazetteer(tokens, terms, ["doc_id"], "place", "tok", longest=3)
    return hits.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("first").alias("first_sum"), F.sum("last").alias("last_sum"))


def inverted_index_topk(spark, sf_dir):
    terms = T.alphanumeric_terms(F.coalesce("text", F.lit("")))
    docs = read(spark, sf_dir, "documents").select("doc_id", terms.alias("terms"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return matching.index_search(docs, asked, 0.6, 10).select("query_id", "doc_id", "matched", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


def marker_linking(spark, sf_dir):
    refs = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("label"), F.col("o_orderkey").alias("target"))
    markers = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5000).alias("label"))
    linked = matching.unique_match(markers, refs, ["label"], "target")
    return linked.groupBy(F.col("target").isNotNull().alias("linked")).agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum"))


def consolidate_join(spark, sf_dir):
    records = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("key"), F.lit(None).cast("string").alias("place"), F.col("c_mktsegment").alias("segment"))
    works = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("place"), F.when(F.col("n_regionkey") == 1, F.lit("CHECKED")).alias("segment"))
    return matching.consolidated(records, works, "key", ["place", "segment"], accept=F.col("key") % 4 != 3).select("c_custkey", "place", "segment", "consolidated")


def token_jaccard(spark, sf_dir):
    terms = F.array_distinct(T.alphanumeric_terms(F.coalesce("text", F.lit(""))))
    posted = read(spark, sf_dir, "benchmark").select("item_id", terms.alias("b")).select("item_id", F.size("b").alias("nb"), F.explode("b").alias("term"))
    docs = read(spark, sf_dir, "documents").select("doc_id", terms.alias("d")).select("doc_id", F.size("d").alias("nd"), F.explode("d").alias("term"))
    shared = docs.join(F.broadcast(posted), "term").groupBy("doc_id", "item_id", "nd", "nb").agg(F.count(F.lit(1)).alias("c"))
    return shared.select("doc_id", "item_id", F.round(F.col("c") / (F.col("nd") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


def ratcliff_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", matching.ratcliff_obershelp(F.col("p_name"), F.concat("p_brand", F.lit(" "), "p_name")).alias("similarity"))
    return p.withColumn("similarity", F.round("similarity", 6))


def author_email_assign(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("key", F.floor(F.col("c_custkey") / 3).cast("long"))
    authors = c.select("key", F.concat(F.lit("Ann "), F.substring("c_mktsegment", 1, 4), F.col("c_name")).alias("author"))
    emails = c.select("key", F.concat(F.lower(F.concat(F.lit("ann"), F.substring("c_mktsegment", 1, 4), F.regexp_replace("c_name", "[^A-Za-z]", ""))), F.lit("@x.org")).alias("email"))
    return matching.assigned_emails(authors, emails, "key")


#: A small model: words after a capitalised word tend to stay in the name.
MODEL = "p u01:%x[0,1]\np u02:%X[0,0]\np b07:%x[-1,1]/%x[0,1]\nl <other>\nl <name>\nu u01:CAP <name> 1.5\nu u01:LOW <other> 1.0\nb b07:CAP/CAP <name> <name> 0.75\nb b07:CAP/LOW <name> <other> 0.5\nu u02:the <other> 2.0"


def crf_viterbi_synth(spark, sf_dir):
    terms = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""), 1, 2**30)
    rows = F.transform(terms, lambda x: F.array(x, F.when(x.rlike(r"^\p{Lu}"), "CAP").otherwise("LOW")))
    found = crf.label(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), rows.alias("rows")), crf.read_model(MODEL))
    return found.select("seq_id", F.size(F.filter("labels", lambda x: x == "<name>")).cast("long").alias("n_names"), F.size("labels").cast("long").alias("n"), F.round("score", 6).alias("score"))


def html_text_nodes(spark, sf_dir):
    nodes = readers.html_text_nodes(read(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("text").cast("long")).alias("n_chars"))


def bibtex_emit(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.md5(readers.bibtex_record(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_size") + 1990)).alias("digest"))


def tei_emit(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.md5(readers.tei_record(F.concat("p_name", F.lit(" <&> '\"")), F.array("p_brand"), F.col("p_size") + 1990, F.concat(F.lit("b"), F.col("p_partkey").cast("string")))).alias("digest"))


def events_session(spark, sf_dir):
    s = E.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def tumbling_windows(spark, sf_dir):
    t = E.tumbling_counts(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def star_rollup(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.rollup("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping_id().cast("long").alias("level"))


def cube_counts(spark, sf_dir):
    return read(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("n_types"), F.grouping_id().cast("long").alias("level"))


def element_counter(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def semi_anti_join(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    same = c.c_custkey == o.o_custkey
    have, lack = c.join(o, same, "left_semi"), c.join(o, same, "left_anti")
    return have.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("has")).unionByName(lack.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("lacks")))


def full_outer_join(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = read(spark, sf_dir, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full_outer").select(F.col("k").cast("long").alias("k"), "n_customers", "n_suppliers")


def as_of_join(spark, sf_dir):
    """The last earlier view of the same user for each purchase: one window over both, no join of pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = read(spark, sf_dir, "events").withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "last_view")


def set_operations(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    a, b = o.select(F.col("o_custkey").alias("k")), li.select(F.col("l_suppkey").alias("k"))
    rows = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = None
    for name, df in rows:
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.ntile(3).over(w).cast("long").alias("third"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 2)), 4).alias("near_mean"), F.lead("o_orderkey").over(w).alias("next_order"))


def top_k_by_group(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return read(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "rank")


def approx_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 10000).alias("median"))


def repeated_heads(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    flagged = layout.repeated_heads(lines.withColumn("pattern", T.letters_pattern(F.col("line"))), ["doc_id"], "pattern")
    return flagged.groupBy("doc_id").agg(F.sum(F.col("repetitive").cast("long")).alias("n_repetitive"), F.sum(F.col("first_repetitive").cast("long")).alias("n_first"))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents"
_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x))"
_ISLANDS = "SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events)"

SQL = {
    "label_islands": f"SELECT event_type, count(*) AS n_islands, max(n) AS longest, sum(n)::BIGINT AS n_events FROM (SELECT user_id, island, event_type, count(*) AS n FROM ({_ISLANDS}) GROUP BY ALL) GROUP BY event_type",
    "prev_label_fix": "SELECT CASE WHEN event_type = 'purchase' AND prev = 'view' THEN prev ELSE event_type END AS label, event_type, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1, 2",
    "align_by_ordinal": f"SELECT CASE WHEN regexp_matches(tok, '^[0-9]') THEN '<number>' ELSE '<word>' END AS label, count(*) AS n, 0::BIGINT AS n_wrong, sum(pos)::BIGINT AS pos_sum FROM ({D}) WHERE trim(tok) <> '' GROUP BY 1",
    "interval_coalesce": """WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_linenumber AS stop FROM lineitem),
      m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
      r AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT l_suppkey, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM r GROUP BY l_suppkey, run""",
    "interval_token_flags": "WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events), s AS (SELECT user_id, place AS a FROM t WHERE event_id % 10 = 3) SELECT user_id, sum(CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND t.place BETWEEN s.a AND s.a + 2) THEN 1 ELSE 0 END)::BIGINT AS n_inside, count(*) AS n FROM t GROUP BY user_id",
    "box_union": f"SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({_BOXES}) GROUP BY doc_id, page",
    "box_lines": f"""WITH g AS (SELECT *, x - lag(x + w) OVER o AS ahead, abs(y - lag(y) OVER o) AS drop_ FROM ({_BOXES}) WINDOW o AS (PARTITION BY doc_id, page ORDER BY ord, x, y, w, h)),
      m AS (SELECT *, sum(CASE WHEN drop_ < 12 AND ahead >= 0 AND ahead < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord, x, y, w, h ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM g)
      SELECT doc_id, page, line, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM m GROUP BY doc_id, page, line""",
    "page_main_area": f"""WITH b AS (SELECT doc_id, page, x, y, w * 10 AS w, h * 2 AS h FROM ({_BOXES})), f AS (SELECT * FROM b WHERE x <> 0 AND h >= 20 AND w >= 20 AND w * h >= 3000),
      y AS (SELECT doc_id, min(floor(y))::BIGINT AS y1, max(floor(y + h))::BIGINT AS y2 FROM f GROUP BY doc_id)
      SELECT f.doc_id, page % 2 AS parity, min(floor(x))::BIGINT AS x1, max(floor(x + w))::BIGINT AS x2, any_value(y1) AS y1, any_value(y2) AS y2 FROM f JOIN y ON y.doc_id = f.doc_id GROUP BY f.doc_id, page % 2""",
    "block_spacing": f"WITH b AS (SELECT doc_id, page, block, min(y) AS y, max(h) AS h FROM ({_BOXES}) GROUP BY ALL), s AS (SELECT *, y - lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY block) AS sp FROM b) SELECT doc_id, page, count(sp) AS n, min(sp) AS least, max(sp) AS most FROM s GROUP BY doc_id, page",
    "connected_boxes": f"WITH b AS ({_ROLES}) SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b, (a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) AS overlap FROM b AS a JOIN b AS b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.role AND NOT b.role AND least(abs(b.y - a.y - a.h), abs(a.y - b.y - b.h)) < 100",
    "nearest_graphic": f"WITH b AS ({_ROLES}), p AS (SELECT a.doc_id, a.page, a.ord AS caption, b.ord AS graphic, abs(a.x - b.x) + abs(a.y - b.y) AS distance FROM b AS a JOIN b AS b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.role AND NOT b.role) SELECT * FROM p WHERE distance <= 300 QUALIFY row_number() OVER (PARTITION BY doc_id, page, caption ORDER BY distance, graphic) = 1",
    "marker_majority": "SELECT doc_id, kind, n FROM (SELECT l_orderkey % 300 AS doc_id, l_returnflag AS kind, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind) = 1",
    "gazetteer_match": f"""WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, lower(tok) AS tok FROM ({D}) WHERE {SOLID}),
      b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{TOKEN_SQL}'), lambda x: trim(x) <> '') AS w FROM benchmark),
      terms AS (SELECT item_id * 10 + 1 AS term_id, w[1:2] AS words FROM b UNION ALL SELECT item_id * 10 + 2, w[3:5] FROM b),
      g AS (SELECT doc_id, place, tok, lead(tok, 1) OVER o AS t2, lead(tok, 2) OVER o AS t3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY place))
      SELECT term_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(place)::BIGINT AS first_sum, sum(place + len(words) - 1)::BIGINT AS last_sum FROM g JOIN terms ON words[1] = tok AND (len(words) < 2 OR words[2] = t2) AND (len(words) < 3 OR words[3] = t3) GROUP BY term_id""",
    "inverted_index_topk": f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), q AS (SELECT item_id AS query_id, ({_TERMS}) AS terms FROM benchmark),
      p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
      a AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q),
      s AS (SELECT query_id, doc_id, n_terms, count(*) AS matched, sum(tf * ln(1 + (SELECT count(*) FROM d)::DOUBLE / (1 + df))) AS score FROM a JOIN p USING (term) JOIN f USING (term) GROUP BY ALL)
      SELECT query_id, doc_id, matched, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE matched >= floor(n_terms * 0.6)) WHERE rank <= 10""",
    "marker_linking": "WITH r AS (SELECT o_orderkey % 4000 AS label, count(*) AS c, min(o_orderkey) AS target FROM orders GROUP BY 1), m AS (SELECT CASE WHEN c = 1 THEN target END AS target FROM lineitem LEFT JOIN r ON l_partkey % 5000 = label) SELECT target IS NOT NULL AS linked, count(*) AS n, sum(target)::BIGINT AS target_sum FROM m GROUP BY 1",
    "consolidate_join": "SELECT c_custkey, CASE WHEN ok THEN n_name END AS place, CASE WHEN ok AND n_regionkey = 1 THEN 'CHECKED' ELSE c_mktsegment END AS segment, ok AS consolidated FROM (SELECT *, n_nationkey IS NOT NULL AND c_nationkey % 4 <> 3 AS ok FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)",
    "token_jaccard": f"""WITH d AS (SELECT doc_id, list_distinct({_TERMS}) AS t FROM documents), b AS (SELECT item_id, list_distinct({_TERMS}) AS t FROM benchmark),
      c AS (SELECT doc_id, item_id, count(*) AS c FROM (SELECT doc_id, unnest(t) AS x FROM d) JOIN (SELECT item_id, unnest(t) AS x FROM b) USING (x) GROUP BY ALL)
      SELECT doc_id, item_id, round(c / (len(d.t) + len(b.t) - c), 6) AS jaccard FROM c JOIN d USING (doc_id) JOIN b USING (item_id)""",
    "ratcliff_names": None,
    "author_email_assign": None,
    "crf_viterbi_synth": None,
    "html_text_nodes": r"WITH p AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<[^>]*>'), lambda x: trim(x) <> '') AS n FROM pages) SELECT page_id, len(n)::BIGINT AS n_nodes, list_sum(list_transform(n, lambda x: length(x)))::BIGINT AS n_chars FROM p WHERE len(n) > 0",
    "bibtex_emit": "SELECT p_partkey, md5('@article{p' || p_partkey || ',' || chr(10) || '  author = {' || p_brand || ' and ' || p_type || '},' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  year = {' || (p_size + 1990) || '}' || chr(10) || '}') AS digest FROM part",
    "tei_emit": "SELECT p_partkey, md5('<biblStruct xml:id=\"b' || p_partkey || '\"><analytic><title level=\"a\">' || p_name || ' &lt;&amp;&gt; &apos;&quot;</title><author><persName><surname>' || p_brand || '</surname></persName></author></analytic><monogr><imprint><date type=\"published\" when=\"' || (p_size + 1990) || '\"/></imprint></monogr></biblStruct>') AS digest FROM part",
    "events_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id",
    "tumbling_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "star_rollup": "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping(o_orderpriority, l_returnflag)::BIGINT AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority, l_returnflag)",
    "cube_counts": "SELECT p_brand, p_size, count(*) AS n, count(DISTINCT p_type) AS n_types, grouping(p_brand, p_size)::BIGINT AS level FROM part GROUP BY CUBE (p_brand, p_size)",
    "element_counter": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "semi_anti_join": "SELECT c_mktsegment, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'has' ELSE 'lacks' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2",
    "full_outer_join": "WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_nationkey < 15 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_nationkey > 8 GROUP BY 1) SELECT k::BIGINT AS k, n_customers, n_suppliers FROM a FULL JOIN b USING (k)",
    "as_of_join": "SELECT event_id, user_id, last_view FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) WHERE event_type = 'purchase'",
    "set_operations": "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT l_suppkey AS k FROM lineitem), u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), e AS (SELECT * FROM a EXCEPT SELECT * FROM b) SELECT 'union' AS kind, count(*) AS n, sum(k)::BIGINT AS total FROM u UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM i UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM e",
    "window_frames": "SELECT o_orderkey, rank() OVER w AS rank, ntile(3) OVER w AS third, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS near_mean, lead(o_orderkey) OVER w AS next_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "top_k_by_group": "SELECT l_returnflag, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10",
    "approx_aggregates": None,
    "repeated_heads": f"WITH l AS (SELECT doc_id, line_no, lower(regexp_replace(line, '[^a-zA-Z]', '', 'g')) AS p FROM ({_LINES})), c AS (SELECT doc_id, line_no, length(p) > 8 AND count(*) OVER (PARTITION BY doc_id, p) > 1 AS r, row_number() OVER (PARTITION BY doc_id, p ORDER BY line_no) AS k FROM l) SELECT doc_id, sum(r::INT)::BIGINT AS n_repetitive, sum((r AND k = 1)::INT)::BIGINT AS n_first FROM c GROUP BY doc_id",
}
QUERIES = {name: globals()[name] for name in SQL}
