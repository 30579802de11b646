import random

import corpus_pipeline
from codexa.llm import registry


def test_stages(spark, tmp_path):
    """Every stage's decision against plain Python on a small corpus."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "WIN###"]) for _ in range(40))
    passage, item = say(80), say(30)
    texts = [say(60) for _ in range(120)] + [junk() for _ in range(40)]
    base = say(120)
    texts += [base, base, base + " extra", say(40) + " " + passage + " " + say(40), say(50) + " " + passage, say(20) + " " + item + " " + say(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(0, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{k}"
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if k < 4:
            assert now.columns == docs.columns
    quality, near, suffix, leaks, mix = (seen[name] for name, _ in corpus_pipeline.STAGES)
    assert set(range(120)) | set(range(160, 166)) == set(quality)
    assert set(quality) - set(near) == {161, 162}
    assert passage not in suffix[163]["text"] and passage not in suffix[164]["text"] and suffix[0]["text"] == texts[0]
    assert all(r["n_chars"] == len(r["text"]) for r in suffix.values())
    assert set(suffix) - set(leaks) == {165}
    assert set(mix) <= set(leaks) and all(0 < r["copies"] <= 2 for r in mix.values())
    total = sum(len(r["text"].split()) for r in leaks.values())
    assert abs(sum(r["taken"] for r in mix.values()) - 1.5 * total) <= 3 * 130


def test_registry():
    names = set(registry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{k}" for k in range(1, 11)}
    assert set(registry.oracle_sql()) <= names
