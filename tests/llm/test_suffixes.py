import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codexa.llm import suffixes as S


def brute(texts, length):
    data = [S.utf8(t) for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = S.runs_of(gone)[0]
        out.append((len(d), int(gone.sum()), len(spans), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "thé", "ander", "io", "ß", "reheat", "tion", "a"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "er", "sh", "x"]) for _ in range(n))
    passage, other = say(70), say(45)
    texts = [say(rng.randint(1, 120)) for _ in range(30)]
    texts += [say(20) + passage + say(30), passage + say(5), say(3) + passage[7:], other + say(9) + other, passage[:199], passage[:200], passage[:201]]
    texts += [None, "", "x" * 500, "xy" * 300, "ab " * 90, texts[3], texts[3], say(400), say(50) + other[:150] + say(50), "é" * 210]
    return texts


def test_cover():
    assert S.cover_distance().max() < S.PERIOD
    with pytest.raises(ValueError):
        S.cover_distance(64, (0, 1, 2))


@pytest.mark.parametrize("options", [{}, {"block": 5_000}, {"hot": 1}])
def test_brute_force(spark, options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, row string").drop("row").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in S.removed(docs, **options).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 200)


def test_repeated_and_null_ids(spark):
    text = "abcdefgh " * 40
    docs = spark.createDataFrame([(1, "p" + text), (1, "q" + text), (None, "r" + text), (2, "lone"), (2, "lone")], "doc_id long, text string")
    rows = S.removed(docs).collect()
    assert len(rows) == 5
    assert sorted(r["n_removed"] for r in rows) == [0, 0, 360, 360, 360]


def test_kept_text_and_columns(spark):
    passage = " ".join(str(i * 7919) for i in range(60))
    docs = spark.createDataFrame([(1, "é" + passage, "k"), (2, passage + "ü", "l")], "doc_id long, text string, spans_of string")
    rows = {r["doc_id"]: r for r in S.deduplicated(docs).collect()}
    assert rows[1]["text"] == "é" and rows[2]["text"] == "ü" and rows[2]["spans_of"] == "l"


def test_empty(spark):
    assert S.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
