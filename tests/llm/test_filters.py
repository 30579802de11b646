import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from codexa.llm import extract, mixing, ogg, urls


def slow_crc(page):
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 4000, 4001, 70_000, 300_000])
def test_ogg_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    streams, bad = ogg.decode(ogg.encode(data))
    payload, rate, times = ogg.samples(streams)
    assert payload == data and not bad and len(streams) == 2 and rate == ogg.RATE
    if n:
        assert times[-1] == pytest.approx(n / rate)
    assert all(s.ended and not s.lost for s in streams.values())


def test_ogg_lacing_and_damage():
    packets = [(b"", 0), (b"x" * 255, 1), (b"y" * 70_000, 2), (b"z", 3)]
    pages = ogg.pages_of(packets, 9)
    got = ogg.decode(b"junk" + b"".join(pages))[0][9]
    assert got.packets == [p for p, _ in packets] and got.granules[-1] == 3
    hurt = bytearray(b"".join(pages))
    hurt[len(pages[0]) + 40] ^= 1
    streams, bad = ogg.decode(bytes(hurt))
    assert bad == 1 and b"z" in streams[9].packets and b"y" * 70_000 not in streams[9].packets
    head = struct.unpack_from(ogg.HEADER, pages[0])
    assert head[0] == b"OggS" and head[2] & ogg.FIRST


def test_ogg_table(spark):
    docs = spark.createDataFrame([(1, "é" * 40), (2, None), (3, ""), (4, "é" * 40), (None, "x" * 64)], "doc_id long, text string").withColumn("media", F.lit(1))
    rows = {r["doc_id"]: r for r in ogg.digest(ogg.store(docs)).collect()}
    assert rows[1]["n_bytes"] == 80 and rows[1]["payload_bytes"] == 128 and rows[2]["payload_bytes"] == 64
    assert rows[1]["media_sha256"] == rows[4]["media_sha256"] and rows[2]["payload_sha256"] == rows[3]["payload_sha256"]
    assert rows[None]["tail_crc32"] == zlib.crc32(b"x" * 64) and rows[None]["payload_bytes"] == 64


def test_urls(spark):
    rows = [
        (1, "https://a.example.org/es/1", None), (2, "HTTP://A.EXAMPLE.ORG/en/19?x#y", ""), (3, "https://x.com/de/", None), (4, "https://x.com/fr/q#z", None), (5, None, None), (6, "nothing", None),
        (7, "https://b.net/1", '<link rel="canonical" href="https://x.com/de/7">'), (8, "https://b.net/2#f", None), (9, "https://b.net/3", None), (10, "https://c.org/", '<link href="https://x.com/de/8" rel=canonical>'), (11, "https://notorg/x", None), (12, "https://c.org", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    moves = spark.createDataFrame([("https://b.net/2", "https://b.net/1"), ("https://b.net/3", "https://c.org/"), ("https://b.net/3", None)], "src string, dst string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, redirects=moves).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("a.example.org", "/en/19", "example.org/en/1", "block")
    assert got[3][3] == "block" and got[4][2:] == ("com/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == (None, "block") and got[8][3] == "block"  # by the canonical link, and by a redirect to that page
    assert got[10][2:] == ("org/", "allow") and got[9][3] == "allow"  # an explicit allow in the component
    assert got[11][3] == "allow" and got[11][2] is None and got[12][1:3] == ("", None)
    assert urls.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.rule_of(F.lit("a"), F.lit("b"), [("allow", "x/")] * (urls.MAX_RULES + 1))


def fill(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in got]
        if not rest:
            return got
        left = budget - sum(got.values())
        over = [s for s in rest if left * w[s] / sum(w[x] for x in rest) > epochs * sizes[s]]
        if not over:
            return got | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        got |= {s: float(epochs * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 2520, "b": 2460, "c": 2460}, {"a": 10, "b": 500, "c": 40, "d": 7, None: 90}, {"a": 0, "b": 5}, {"b": 8}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([("=" + s if s else "", s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, (3, 1, 2), 1.5, 2).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for i in range(500)]
    rows += [(900, None, "a"), (901, "", "zero"), (7, rows[7][1], rows[7][2]), (None, "x y", "a"), (None, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = fill(sizes)
    for s, total in sizes.items():
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["source_size"] == total and mine[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    kept = mixing.mixed(docs)
    assert kept.where("copies <= 0").count() == 0 and kept.columns[:3] == ["doc_id", "text", "source"]
    assert mixing.mix(docs.limit(0)).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a>one</a><li>two</ul></nav>"
    '<div class="cookie-notice">We use</div>{}<aside>Side</aside><section id="comments"><p>Nice!</p></section><form>Mail <input></form><footer>&copy; x</footer>'
)


def test_extract(spark):
    bodies = ["<article><h1>Head &amp; more</h1><p>One <b>two\n three<br>four</p><p>Five &lt;6&gt;</article>", "<article><h1>Other</h1></article>", "<article><h1>H</h1><p>a<p>b<p>c<ul><li>x<li>y</ul><div class='ad'>buy</div></article>"]
    rows = [(i, "https://h.org/x", PAGE.replace("{}", b)) for i, b in enumerate(bodies)] + [(10, None, None), (11, "https://k.org/", ""), (12, "https://k.org/", PAGE.replace("{}", "<div><p>Plain</p><p>text &am</p></div>")), (13, "https://h.org/y", PAGE.replace("{}", bodies[0])[:-60])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert got[0]["text"] == "Head & more\n\nOne two three four\n\nFive <6>"
    assert got[1]["text"] == "Other" and got[2]["text"] == "H\n\na\n\nb\n\nc\n\nx\n\ny"
    assert got[10]["text"] == got[11]["text"] == "" and got[12]["text"] == "Plain\n\ntext &am" and got[13]["text"] == got[0]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract.extract(pages.limit(0)).count() == 0


def test_wrapper_is_union_free():
    streams = ["h a b b b c", "h a b c", "h a c d", "h x y x y c"]
    wrapper = None
    for s in streams:
        wrapper = extract.grow(wrapper, [x for x, _ in extract.collapse(tuple(s.split()))])
    import re

    pattern = re.compile("^" + re.sub(r"([a-z])", r"(?:\1 )", extract.shown(wrapper).replace(" ", "")) + "$")
    assert "|" not in extract.shown(wrapper) and all(pattern.match(s + " ") for s in streams)
    assert extract.load(extract.dump(wrapper)) == wrapper
