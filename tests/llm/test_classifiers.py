import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import language, quality, toxicity
from codexa.llm.common import fold
from codexa.llm.words import scan, shingles

DOCS = "doc_id long, text string, lang string, source string"


def say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_scan_matches_python():
    texts = ["The cat\tsat  on", None, "", " \n ", "É Aaé a\x00b", "x" * 5000, "a b a"]
    w = scan(texts)
    for i, t in enumerate(texts):
        got = [bytes(w.data[a:b]) for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        assert got == [x for x in lower.encode().split() if x]
    h = w.hashes()
    a = w.first[6]
    assert h[a] == h[a + 2] != h[a + 1]


def test_shingles():
    w = scan(["a b c d e", "a b", "", "a b c d"])
    h, first = shingles(w.hashes(), w.first, 4)
    assert np.diff(first).tolist() == [2, 1, 0, 1] and h[0] == h[3] != h[2]


def brute_margin(m, index, value):
    total = m.bias + sum(float(m.linear[i]) * v for i, v in zip(index, value, strict=True))
    for a in range(len(index)):
        for b in range(a):
            total += float(m.factors[index[a]] @ m.factors[index[b]]) * value[a] * value[b]
    return total


def test_factorisation_identity():
    m = quality.Machine(50, 3)
    m.linear[:] = np.random.default_rng(0).normal(size=50)
    m.factors[:] = np.random.default_rng(1).normal(size=(50, 3))
    index, value, first = np.array([3, 7, 9, 1]), np.array([0.5, 2.0, 1.0, 1.0], np.float32), np.array([0, 3, 4])
    got = m.margin(index, value, first)
    assert got[0] == pytest.approx(brute_margin(m, index[:3], value[:3]), rel=1e-4)
    assert got[1] == pytest.approx(brute_margin(m, index[3:], value[3:]), rel=1e-4)


def test_quality_held_out(spark):
    rng = random.Random(2)
    words = ["reading", "of", "the", "shore", "under", "a", "wide", "evening"]
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = ". ".join(say(rng, words, 9).capitalize() for _ in range(4)) if good else say(rng, ["WIN!!", "CLICK$$$", "NOW###", "FREE!!"], 30)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), None))
    rows += [(1000, None, None, None), (None, "", None, None), (5, rows[5][1], "en", "s")]
    labels += [(5, None, None), (None, 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: q for i, q, _ in labels[:300]}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = quality.kept(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and 190 <= kept.where("doc_id < 300").count() <= 212


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).count() == toxicity.classify(docs, none).count() == 1
    assert quality.classify(docs.limit(0), none).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = say(rng, words, rng.randint(5, 300)) + (" " + rng.choice(["idiots", "idiotic", "scumbag"]) + " " if bad else " ") + say(rng, words, 9)
        rows.append((i, text, "en", "s"))
        labels.append((i, None, int(bad)))
    rows += [(2000, None, None, None), (2001, "", None, None)]
    out = {r["doc_id"]: r for r in toxicity.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, r in out.items() if r["held_out"] and i < 600]
    assert len(held) > 80 and np.mean([out[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.97
    assert out[2000]["predicted"] == out[2001]["predicted"] == 0


def test_counterfactual_penalty():
    """A group's name that goes with the label in training moves the score less when swaps are penalised."""
    rng = random.Random(8)
    words = [f"n{k}" for k in range(60)]
    texts, label = [], []
    for i in range(400):
        bad = i % 2
        texts.append(say(rng, words, 8) + (" muslims " if bad and i % 3 else " people ") + ("awful " if bad else "") + say(rng, words, 4))
        label.append(bad)
    gap = {}
    for weight in (0.0, 4.0):
        m = toxicity.fit(texts, label, swap_weight=weight, l1=0.5)
        scores = m.margins(*toxicity.features(["n1 n2 muslims n3", "n1 n2 christians n3"]))[:, 0]
        gap[weight] = abs(scores[0] - scores[1])
    assert gap[4.0] < 0.5 * gap[0.0]
    assert toxicity.swapped("none") is None and toxicity.swapped("all muslims here").split()[1] in toxicity.IDENTITY_TERMS[0]
    others = {toxicity.swapped("all Women here", np.random.default_rng(k)).split()[1] for k in range(40)}
    assert len(others) > 5 and others < set(toxicity.IDENTITY_TERMS[0]) - {"women"}
    assert toxicity.swapped("mu\u017flims and wei\u00dfe") != "mu\u017flims and wei\u00dfe"  # a long s folds to s


def test_language(spark):
    rng = random.Random(5)
    lists = {"en": ["the", "thing", "whose", "reading", "shore"], "de": ["der", "schön", "auch", "und", "ßchen"], "fr": ["élan", "eaux", "quelle", "être", "oui"]}
    rows = [(i, say(rng, lists[name], rng.randint(3, 60)), name, "s") for i, name in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, None, None), (901, " 12 !", "en", "s"), (902, "", None, None), (None, say(rng, lists["de"], 9), "en", "s"), (903, say(rng, lists["fr"], 9), None, "s")]
    out = language.classify(spark.createDataFrame(rows, DOCS)).collect()
    truth = {i: name for i, _, name, _ in rows[:180]}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[None]["lang_pred"] == "de" and by[903]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in out)
    unknown = spark.createDataFrame([(1, "abc", None, "s")], DOCS)
    assert language.classify(unknown).first()["lang_pred"] == "und"


def test_grams_brute():
    texts = ["Ab c", None, "", "é", "ab  C"]
    codes, first = language.grams(texts)
    assert np.diff(first).tolist() == [6 + 5 + 4, 0, 0, 3 + 2 + 1, 6 + 5 + 4]
    assert (codes[first[0] : first[1]] == codes[first[4] : first[5]]).all()


def test_fold(spark):
    got = spark.range(50).select(fold("id", 3).alias("f"), "id").collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)
    assert spark.range(1).select(fold(F.lit(None).cast("long"), 3).alias("f")).first()["f"] is None
