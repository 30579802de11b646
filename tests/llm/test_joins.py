import random
from itertools import combinations

import numpy as np
import pytest

from codexa.llm import decontaminate, jaccard
from codexa.llm.graph import connected_components
from codexa.llm.words import scan


def shingle_set(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [rows[0], rows[0].upper(), "", None, "  ", "one two", "one  two", "ONE two three", "a b c d", "a b c d e", " ".join(["same"] * 50), " ".join(["same"] * 70)]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_brute_force(spark, k, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("dealt", [False, True])
def test_large_group_of_near_copies(spark, monkeypatch, dealt):
    """One group of near copies, many of which link only by way of others, with posting lists whole and dealt into parts."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
        rows.append((i * 2 + 5, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 900)}" for _ in range(90))) for i in range(30)]
    if dealt:
        monkeypatch.setattr(jaccard, "frequent", lambda counts: [(int(b), 4) for b in (counts > 40).nonzero()[0]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, 5, 80).collect()}
    assert got == brute(rows, 5, 80)


def near_copies():
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 900)}" for _ in range(110)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
        rows.append((i * 2 + 5, " ".join(words)))
    return rows + [(1000 + i, " ".join(f"u{rng.randint(0, 900)}" for _ in range(90))) for i in range(10)]


def test_pairs_of_short_lists_are_compared_at_once(spark, monkeypatch):
    """Leaders once, then all pairs left: rounds of many small stages are for lists with too many pairs only."""
    rows, calls, links = near_copies(), [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *a: calls.append(1) or links(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, 5, 80).collect()} == brute(rows, 5, 80)
    assert len(calls) == 2


def test_rounds_and_joins_of_large_inputs(spark, monkeypatch):
    """What lists with too many pairs and links beyond the driver's go through, by limits that any input is over."""
    for name in ("WHOLE", "LOCAL"):
        monkeypatch.setattr(jaccard, name, -1)
    monkeypatch.setattr(jaccard, "EACH", 0)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, 5, 80).collect()} == brute(rows, 5, 80)


def test_several_leaders_of_a_class(spark):
    """The leader of most lists may not link with a class where another does."""
    x, y, last = (r["id"] for r in spark.range(3).selectExpr("id", "xxhash64(id) h").orderBy("h").collect())
    rows = [(t, c, 100, 0, 0, c) for t, pair in enumerate([(x, last), (x, last), (y, last)]) for c in pair]
    now = spark.createDataFrame(rows, "token long, class long, n int, at int, part int, comp long")
    assert {tuple(r) for r in jaccard.led(now, float(np.log(100 / 85)), 85, []).collect()} == {(last, x), (last, y)}


def test_the_middle_of_a_group_leads(spark, monkeypatch):
    """Copies that link with the text they were made of, not with each other, all meet it: nothing is left for the pairs of lists."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 41):
        words = list(base)
        for at in rng.sample(range(4, 146), 2):
            words[at] = f"v{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{rng.randint(0, 900)}" for _ in range(90))) for i in range(5)]
    found, links = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *a: found.append(links(*a)) or found[-1])
    monkeypatch.setattr(jaccard, "delete", lambda *a: None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, 4, 85).collect()} == brute(rows, 4, 85)
    assert [f.count() >= 40 for f in found] == [True, False] and found[1].count() == 0


def test_least_nodes_on_the_driver():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 400):
        a, b = rng.integers(-300, 300, n), rng.integers(-300, 300, n)
        least = {int(x): int(x) for x in [*a, *b]}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert dict(zip(*(x.tolist() for x in jaccard.joined(a, b)), strict=True)) == least


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 9, 300, 4000):
        whole = np.unique(rng.integers(0, 1 << 56, n * 2, dtype=np.uint64))
        x, y = whole[: len(whole) * 2 // 3], whole[len(whole) // 3 :]
        a, b = jaccard.parity(x), jaccard.parity(y[: len(y) // 3 + 1])
        size = min(len(a), len(b), 64)
        for k in {size, min(len(a), len(b))}:
            differ = int(np.bitwise_count(jaccard.folded(a, k) ^ jaccard.folded(b, k)).sum())
            assert differ <= len(x) + len(y) // 3 + 1 - 2 * jaccard.common(x, y[: len(y) // 3 + 1])
        assert n < 9 or differ > 0


def test_large_ids_beside_null(spark):
    rows = [(2**53 + 1, "a b c d e f", 1), (None, "a b c d e f", 2), (2**53 + 3, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(docs).collect()}
    assert got == {(2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (2**53 + 3, 2**53 + 3)}
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns and sorted(tuple(r) for r in stay.collect()) == [(2**53 + 1, "a b c d e f", 1), (2**53 + 3, None, 3)]


def test_rows_that_differ_elsewhere(spark):
    """Equal in id and text, of different sources: one stays, always the same."""
    rows = [(1, "a b c d e f", s) for s in "zyxwv"] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
    assert len(first) == 1 and first == [tuple(r) for r in jaccard.one_of_each(docs.repartition(3)).collect()]


def test_one_of_each(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words stand here now"), (None, "a b c d e f g"), (7, None), (8, ""), (2, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == [2, 7, 8, 9]


def test_empty_table(spark):
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_graph(spark):
    pairs = [("a", "b"), ("c", "b"), ("d", "e"), ("z", "z"), (None, "q")] + [(f"n{i}", f"n{i + 1}") for i in range(10, 40)] + [("hub", f"s{i}") for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got["c"] == "a" and got["e"] == "d" and got["n40"] == "n10" and got["s49"] == "hub" and "z" not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([f"x{rng.randint(0, 6)}" for _ in range(rng.randint(1, 40))] for _ in range(2))
        wa, wb = (decontaminate.word_stream([" ".join(x)])[0] for x in (a, b))
        assert decontaminate.lcs(decontaminate.places_of(wa.tolist()), wb.tolist()) == slow_lcs(a, b)


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(15, 60)) for _ in range(20)]
    docs, truth = [], set()
    for i in range(200):
        words = say(rng.randint(5, 400))
        if i % 4 == 0:
            item = list(items[i // 4 % 20])
            if i % 8 == 0:  # a paraphrase: some words out, some others in, the answer kept
                for _ in range(len(item) // 8):
                    item[rng.randrange(len(item) - 5)] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = item
            truth.add((i, i // 4 % 20))
        docs.append((i, " ".join(words).capitalize()))
    docs += [(500, None), (501, ""), (502, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x[:-4]) + ". " + " ".join(x[-4:])) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "w1 w2 w7")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(frame, bench).collect()}
    assert got - {(d, i) for d, i in got if i == 92} == truth
    clean = decontaminate.clean(frame, bench.where("item_id <> 92"))
    assert clean.count() == len(docs) - 50 and clean.columns == frame.columns
    assert decontaminate.search(frame, bench.limit(0)).count() == 0


def test_block_sums_brute():
    rng = np.random.default_rng(3)
    h, first = rng.integers(0, 1 << 32, 200, dtype=np.uint32), np.array([0, 0, 1, 60, 108, 108, 200])
    rows = rng.normal(size=(decontaminate.WIDTH, 3))
    start, doc = decontaminate.blocks_of(first)
    want = [rows[decontaminate.column(h[a : min(a + decontaminate.BLOCK, first[d + 1])])].sum(0) for a, d in zip(start, doc, strict=True)]
    assert np.allclose(decontaminate.block_sums(decontaminate.with_nothing(rows), h, first), want)


def test_signatures_lose_nothing():
    """Whatever blocks are asked, their bits are those of their words."""
    rng = np.random.default_rng(4)
    h, first = rng.integers(0, 1 << 32, 400, dtype=np.uint32), np.array([0, 150, 400])
    start, _ = decontaminate.blocks_of(first)
    levels, end = decontaminate.signatures(h, start), np.r_[start[1:], len(h)]
    for low in range(len(start)):
        for high in range(low, len(start)):
            bits = np.zeros(decontaminate.SIGNATURE, bool)
            bits[(h[start[low] : end[high]] >> np.uint32(5)) & np.uint32(decontaminate.SIGNATURE - 1)] = True
            wanted = np.packbits(bits).view(np.uint64)[None]
            one = np.array([low]), np.array([high]), wanted
            assert decontaminate.enough(levels, *one, np.array([bits.sum()]))[0] and not decontaminate.enough(levels, *one, np.array([bits.sum() + 1]))[0]


def test_items_in_parts(spark):
    bench = spark.createDataFrame([(i, f"item {i} has these few words of its own number {i * 7}") for i in range(40)] + [(90, None), (None, "x")], "item_id long, text string")
    parts = decontaminate.item_parts(bench, rows=10)
    assert len(parts) == 8 and sorted(i for p in parts for i, _, _ in decontaminate.items_of(p)) == list(range(40))
    assert len(decontaminate.item_parts(bench)) == 1 and len(decontaminate.item_parts(bench, chars=500)) > 3


def test_streams_keep_words():
    h, first = decontaminate.word_stream(["Ab, ab!", None, "c"])
    assert first.tolist() == [0, 2, 2, 3] and h[0] == h[1]
    assert len(scan(["a"]).hashes()) == 1
