import os
import random

import pytest

from codexa.llm import decontaminate, extract, urls

SF = "/root/testdata/sf0.1"


def test_item_in_a_third_of_all_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(2000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item, short = say(30), ["few", "of", "them", "of", "few", "of", "them", "few", "few", "them"]
    copies = say(40) + item + say(46)
    docs = [(i, " ".join(copies if i % 3 == 0 else say(rng.randint(20, 200)))) for i in range(300)]
    docs += [(900, " ".join(say(50) + item + say(5))), (901, " ".join(item)), (902, " ".join(say(70) + short + say(9))), (903, " ".join(short))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(frame, bench).collect()}
    assert got == {(i, 1) for i in range(0, 300, 3)} | {(900, 1), (901, 1), (902, 2), (903, 2)}


def test_words_of_many_documents_weigh_something(spark):
    docs = spark.createDataFrame([(i, f"all of these stand here {i}") for i in range(50)], "doc_id long, text string")
    words = decontaminate.word_stream(["all of these stand here"])[0]
    rows, _ = decontaminate.latent(decontaminate.materialise(decontaminate.streams(docs), "t"), rank=4, extra=2)
    assert (abs(rows[decontaminate.column(words)]).max(axis=1) > 0).all()


def test_recall_of_word_for_word_passages(spark):
    """Every item that stands word for word in a document of sf0.1 is found: by brute force over normalised words."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")

    def normal(rows):
        h, first = decontaminate.word_stream([r["text"] for r in rows])
        return [" " + " ".join(map(str, h[a:b].tolist())) + " " for a, b in zip(first[:-1], first[1:], strict=True)]

    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    d, b = docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect()
    items = [(r["item_id"], x) for r, x in zip(b, normal(b), strict=True) if x.strip()]
    want = {(r["doc_id"], k) for r, text in zip(d, normal(d), strict=True) for k, x in items if x in text}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, bench).select("doc_id", "item_id").collect()}
    assert len(want) > 200 and not want - got


def test_boilerplate_without_names(spark):
    """Mixed templates: pages with and without an article, and unnamed text that stands on every page."""
    page = "<html><body><div><p>Subscribe to us today</p><p>All rights are ours</p></div>{}<div><p>Call 555 now</p></div></body></html>"
    plain = [f"<div><p>Story {i} begins</p><p>and {i} ends.</p>{'<p>more</p>' * (i % 2)}</div>" for i in range(5)]
    rows = [(i, "https://p.org/", page.format(x)) for i, x in enumerate(plain)]
    rows += [(10 + i, "https://m.org/", page.format(x if i % 2 else f"<article>{x}</article><div><p>Off {i}</p></div>")) for i, x in enumerate(plain)]
    rows += [(20, "https://one.org/", page.format(plain[0])), (21, "https://p.org/", "<html><body><div><p>Own words</p><p>Call 555 now</p><p>Call 555 now</p></div></body></html>")]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        want = f"Story {i} begins\n\nand {i} ends." + "\n\nmore" * (i % 2)
        assert got[i] == got[10 + i] == want
    assert "Subscribe to us today" in got[20]  # a single page tells no template
    assert got[21].startswith("Own words")


def test_targets_of_links(spark):
    """Relative, protocol-relative and escaped targets, and several links on one page, carry a block."""
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://x.com/fr2/a/b?q", link("/de/1")), (2, "https://b.net/2", link("//x.com/de/2")), (3, "https://x.com/a/b", link("../de/3")), (4, "https://b.net/4", link("https://b.net/5?a=1&amp;b=2")),
        (5, "https://b.net/5?a=1&b=2", link("https://x.com/de/5")), (6, "https://b.net/6", link("https://b.net/60") + link("https://x.com/de/6")), (7, "https://x.com/a/", '<meta http-equiv="refresh" content="0; url=../de/7">'),
        (8, "https://x.com/c/b", link("de/8")), (9, "https://b.net/9", link("/de/9")), (10, "nothing", link("/de/1")), (11, "https://b.net/11", link("mailto:a@x.com/de/")), (12, None, link("/de/1")),
        (13, "https://x.com/de2", link("de/./13")), (14, "https://b.net/14", "<meta http-equiv='refresh' content='0; url=//x.com/de/14'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 13, 14}
