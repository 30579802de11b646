import pytest
from pyspark.sql import functions as F

from codexa.functions import identifiers as I
from codexa.functions import text as T
from codexa.operators import crf, matching, sequences
from codexa.sources import readers
from codexa.streaming import events


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_word_shape(spark):
    assert column(spark, ["Bachelor", "USA", "USA123", "Ph.D.", "", None, "a", "ab"], T.word_shape) == ["Xxxx", "XXX", "XXddd", "Xx.X.", "", None, "x", "xx"]


def test_normalise_and_tokens(spark):
    assert column(spark, ["a b—c\r\nd●"], T.normalise) == ["a b-c\nd•"]
    assert column(spark, ["ab, c-d\n"], T.tokens) == [["ab", ",", " ", "c", "-", "d", "\n"]]
    assert column(spark, ["Ab-1 c"], T.alphanumeric_terms) == [["ab", "1", "c"]]


def test_sentences(spark):
    assert column(spark, ["One. Two?  Three", "", "v1.2 is.\nnew!"], T.sentences) == [["One.", "Two?", "Three"], [], ["v1.2 is.", "new!"]]


def test_script(spark):
    got = column(spark, ["plain text", "Это русский текст", "Ελληνικό κείμενο", "a αβγ", "", "123", "日本語の文章です。漢字", "שלום עולם טוב"], lambda c: T.script(T.script_counts(c)))
    assert got == ["latin", "cyrillic", "greek", "latin", "latin", "latin", "cjk", "hebrew"]


def test_scaling(spark):
    assert column(spark, [-1.0, 0.0, 50.0, 100.0, 200.0], lambda c: T.linear_scaling(c, F.lit(100.0), 10), "double") == [0, 0, 5, 10, 10]


def test_names_and_identifiers(spark):
    assert column(spark, ["Mr. Loganathan", "Prof. Dr. Hans", "King Jr.", "Pandit1", "O'Brien"], I.person_name) == ["Loganathan", "Hans", "King Jr.", "Pandit", "O'Brien"]
    assert column(spark, ["https://doi.org/10.1/x.", "doi: 10.1/y)", "10.1/z"], I.clean_doi) == ["10.1/x", "10.1/y", "10.1/z"]
    assert [tuple(r) for r in column(spark, ["123-7", "12 - 15", "x"], I.page_range)] == [(123, 127), (12, 15), (None, None)]
    assert column(spark, ["Jul", "février", "Dez", "7", "x"], I.month_number) == [7, 2, 12, 7, None]
    assert column(spark, ["2008", "98", "05", "x"], I.pivot_year) == [2008, 1998, 2005, None]
    assert column(spark, ["key words: a; b; c", "Keywords - a, b, c", "x and y"], I.keyword_parts) == [["a", "b", "c"], ["a", "b", "c"], ["x and y"]]
    assert column(spark, ["[3]", "(3)", "[Smith 3]", "iv"], lambda c: I.callout_type(c, F.lit(False))) == ["BRACKET_NUMBER", "PARENTHESIS_NUMBER", "BRACKET_TEXT", "ROMAN"]


def test_ranges(spark):
    got = column(spark, ["[1-3]", "(2-3)", "[1, 3, 5]", "[1-100]"], sequences.expanded_range)
    assert got == [["[1]", "[2]", "[3]"], ["(2)", "(3)"], ["[1]", "[3]", "[5]"], []]


def test_clean_field(spark):
    assert column(spark, [", (a title)., ", "x of the", "a,,b."], T.clean_field) == ["a title", "x", "a,b"]


def test_gazetteer(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("The New York Times of new york".split())], "doc_id long, place long, tok string")
    terms = spark.createDataFrame([(1, ["new", "york"]), (2, ["new", "york", "times"]), (3, ["york"])], "term_id long, words array<string>")
    got = sorted(tuple(r) for r in matching.gazetteer(tokens, terms, ["doc_id"], "place", "tok").collect())
    assert got == [(1, 1, 2, 1), (1, 1, 3, 2), (1, 2, 2, 3), (1, 5, 6, 1), (1, 6, 6, 3)]


def test_ratcliff(spark):
    df = spark.createDataFrame([("Jones", "jones"), ("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(matching.ratcliff_obershelp(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 0.0, 0.0]


MODEL = "p u01:%x[0,0]\np b07:%x[-1,0]/%x[0,0]\nl A\nl B\nu u01:up A 2\nu u01:up B -1\nu u01:down A -0x1p0\nu u01:down B 0x1.0p+1\nb b07:up/down A B 3"


def test_crf(spark):
    model = crf.read_model(MODEL)
    assert model.decode([["up"], ["down"]]) == (["A", "B"], 7.0)
    assert model.decode([["up"]]) == (["A"], 2.0) and model.decode([]) == ([], 0.0)
    assert model.decode([["other"]]) == (["A"], 0.0)
    t = crf.Template("u:%x[-1,0]/%x[1,0]/%X[@0,0]/%x[@-1,0]")
    assert t.observation([["Ab"], ["c"]], 0) == "u:_x-1/c/ab/c" and t.observation([["Ab"], ["c"]], 1) == "u:Ab/_x+1/ab/c"
    assert crf.Template("u:%x[0,3]").observation([["a"]], 0) is None
    df = spark.createDataFrame([(1, [["up"], ["down"]]), (2, []), (3, None)], "seq_id long, rows array<array<string>>")
    assert {r["seq_id"]: r["labels"] for r in crf.label(df, model).collect()} == {1: ["A", "B"], 2: [], 3: []}


def test_crf_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        labels = [f"l{k}" for k in range(rng.integers(2, 5))]
        m = crf.Crf([crf.Template("u:%x[0,0]"), crf.Template("b:%x[0,0]")], labels, {f"u:{c}": rng.normal(size=len(labels)) for c in "xyz"}, {f"b:{c}": rng.normal(size=(len(labels),) * 2) for c in "xyz"})
        rows = [[c] for c in rng.choice(list("xyzw"), rng.integers(1, 6))]
        one, two = m.scores(rows)
        score = lambda p: sum(one[t, p[t]] + (two[t, p[t - 1], p[t]] if t else 0) for t in range(len(p)))  # noqa: B023, E731
        best = max(itertools.product(range(len(labels)), repeat=len(rows)), key=score)
        assert m.decode(rows)[1] == pytest.approx(score(best)) and m.decode(rows)[0] == [labels[k] for k in best]


ALTO = """<alto><Styles><TextStyle ID="f0" FONTFAMILY="times" FONTSIZE="10.0" FONTSTYLE="bold"/><TextStyle ID="f1" FONTFAMILY="times" FONTSIZE="8.0"/></Styles><Layout>
<Page ID="P1" PHYSICAL_IMG_NR="1" WIDTH="612" HEIGHT="792"><PrintSpace><TextBlock ID="b1"><TextLine><String CONTENT="Hello" HPOS="10.5" VPOS="20" WIDTH="30" HEIGHT="10" STYLEREFS="f0"/><String CONTENT="world" HPOS="45" VPOS="20" WIDTH="30" HEIGHT="10" STYLEREFS="f1"/></TextLine></TextBlock></PrintSpace></Page>
<Page ID="P2" PHYSICAL_IMG_NR="2" WIDTH="612" HEIGHT="792"><PrintSpace><TextBlock ID="b2"><TextLine><String CONTENT="Two" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4" STYLEREFS="f0"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""


def test_alto(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ALTO)
    rows = readers.alto_tokens(spark, str(tmp_path)).orderBy("page", "block", "line", "ord").collect()
    assert [(r["page"], r["text"], r["x"], r["style"]) for r in rows] == [(1, "Hello", 10.5, "f0"), (1, "world", 45.0, "f1"), (2, "Two", 1.0, "f0")]
    styles = {r["style"]: r for r in readers.alto_styles(spark, str(tmp_path)).collect()}
    assert styles["f0"]["bold"] and not styles["f1"]["bold"] and styles["f1"]["size"] == 8.0


def test_feature_rows(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a X\nb Y\n\nc Z\n")
    rows = readers.feature_rows(spark, str(tmp_path)).orderBy("seq_id").collect()
    assert [r["rows"] for r in rows] == [[["a", "X"], ["b", "Y"]], [["c", "Z"]]]


def test_incremental_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = events.stream_of(spark, f"{tmp_path}/in", df.schema)
    each = lambda s: s.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    for _ in range(2):
        events.run_available(stream, each, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 3), (2, 1)]
