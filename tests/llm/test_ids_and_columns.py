"""Large ids beside nulls, columns with clashing names, repeated rows and empty tables, for every operator on texts."""

import pytest

from codexa.llm import decontaminate, extract, jaccard, language, mixing, ogg, quality, suffixes, toxicity

LARGE = 2**53 + 1
EXTRA = "row long, spans string, _row long, class int, hash long, score double, n long, copies string, name string"
ROWS = [(LARGE, "one two three four five six"), (None, "seven eight"), (LARGE + 2, None), (4, ""), (LARGE, "one two three four five six"), (None, "seven eight")]


def docs(spark, rows=ROWS):
    columns = "doc_id long, text string, lang string, source string, " + EXTRA
    return spark.createDataFrame([(*r, "en", "s", 1, "x", 2, 3, 4, 0.5, 6, "c", "d") for r in rows], columns)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(LARGE, "one two three four five six"), (None, "x")], "item_id long, text string")


BY_ROW = {
    "ogg": lambda s, d: ogg.digest(ogg.store(d)),
    "suffixes": lambda s, d: suffixes.removed(d),
    "jaccard": lambda s, d: jaccard.components(d),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "language": lambda s, d: language.classify(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_ids(spark, name):
    got = BY_ROW[name](spark, docs(spark)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in ROWS), key=str)
    rows = [tuple(r) for r in got if r["doc_id"] == LARGE]
    assert len(rows) == 2 and rows[0] == rows[1]
    assert BY_ROW[name](spark, docs(spark, [])).count() == 0


def test_searched_ids(spark):
    found = decontaminate.search(docs(spark), bench(spark)).select("doc_id", "item_id").collect()
    assert [tuple(r) for r in found] == [(LARGE, LARGE)] * 2
    assert decontaminate.search(docs(spark, []), bench(spark)).count() == 0


STAGES = {
    "quality": lambda s, d: quality.kept(d, labels(s), threshold=0.0),
    "near duplicates": lambda s, d: jaccard.one_of_each(d),
    "passages": lambda s, d: suffixes.deduplicated(d),
    "benchmark": lambda s, d: decontaminate.clean(d, bench(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns(spark, name):
    frame = docs(spark)
    got = STAGES[name](spark, frame)
    assert got.columns == frame.columns
    want = {"quality": set(ROWS), "passages": set(ROWS), "near duplicates": set(ROWS), "benchmark": set(ROWS[1:4])}[name]
    rows = got.collect()
    assert {tuple(r)[:2] for r in rows} == want and {tuple(r)[4:] for r in rows} == {tuple(frame.first())[4:]}
    empty = STAGES[name](spark, docs(spark, []))
    assert empty.columns == frame.columns and empty.count() == 0


def test_mixed_columns(spark):
    got = mixing.mixed(docs(spark))
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and {"row", "_row", "spans", "class", "hash", "name"} <= set(got.columns)
    assert {r["doc_id"] for r in got.collect()} <= {i for i, _ in ROWS}


def test_pages(spark):
    rows = [(LARGE, "https://a.org/1", "<p>One</p>"), (None, None, None), (LARGE + 2, "", ""), (LARGE, "https://a.org/1", "<p>One</p>")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, part int")
    got = sorted((tuple(r) for r in extract.extract(pages).collect()), key=str)
    assert got == sorted([(LARGE, "https://a.org/1", "One", 3)] * 2 + [(None, None, "", 0), (LARGE + 2, "", "", 0)], key=str)


def test_damaged_media(spark):
    media = spark.createDataFrame([(LARGE, 3, bytearray(b"no ogg")), (None, None, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in ogg.digest(media).collect()}
    assert got[LARGE]["payload_bytes"] == got[None]["payload_bytes"] == 0 and got[LARGE]["media_bytes"] == 6
