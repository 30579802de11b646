"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased characters, weighted by frequency in the text times inverse document
frequency. Document frequencies are counted over all training documents; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on at most ``rows`` texts of each language (a bounded
sample), and a temperature is then fitted on texts of that sample that training left out.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null id is never learnt from; with one
language only, that is the answer; without any training text all is ``und``; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import chunks, fold, gather, map_texts, pieces, table
from codexa.llm.ftrl import Ftrl, join_rows, rows_of

WIDTH, MODULUS, HELD_OUT, ROWS = 1 << 15, 3, 1, 800
PIECE = 1 << 10
SCALE = 20.0
UNKNOWN = "und"


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, and where each text's begin (n + 1). White space counts as a space."""
    clean = [" " + " ".join(x.lower().split()) + " " if isinstance(x, str) and x else "" for x in texts]
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    # each text is set off by two spaces, so that grams across two texts can be told by position and left out
    data = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    per = np.maximum(lengths, 0) + np.maximum(lengths - 1, 0) + np.maximum(lengths - 2, 0)
    first = np.r_[0, np.cumsum(per)]
    out = np.empty(first[-1], np.uint16)
    code = data * np.uint32(0x9E3779B1)
    order = []
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + data[n - 1 :] * np.uint32(0xC2B2AE35)
        order.append((((code ^ (code >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.uint16))
    at = 0
    for i, (length, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
        for n in (1, 2, 3):
            if length >= n:
                out[at : at + length - n + 1] = order[n - 1][end - length : end - n + 1]
                at += length - n + 1
        assert at == first[i + 1]
    return out, first


def sparse(texts, idf: np.ndarray):
    """TF-IDF rows (index, value, first)."""
    codes, first = grams(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, counts = np.unique(doc * WIDTH + codes, return_counts=True)
    row, index = pairs // WIDTH, pairs % WIDTH
    value = SCALE * counts / np.maximum(np.diff(first), 1)[row] * idf[index]
    return index, value.astype(np.float32), np.r_[0, np.cumsum(np.bincount(row, minlength=len(first) - 1))]


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all the texts each hashed n-gram occurs, and the number of texts; added up in pieces of fixed size."""

    def count(frames):
        total = np.zeros(WIDTH + 1, np.int64)
        for part in chunks(frames, text):
            codes, first = grams(part[text])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                seen = np.zeros(WIDTH, bool)
                seen[codes[a:b]] = True
                total[:WIDTH] += seen
            total[WIDTH] += len(part)
        if total[WIDTH]:
            yield pieces(total, PIECE)

    total = gather(docs.select(text).mapInPandas(count, "piece int, data binary"), WIDTH + 1, PIECE)
    return total[:WIDTH], int(total[WIDTH])


class Model:
    """Languages, a table of idf times weight, biases and the temperature."""

    def __init__(self, languages, weights, bias, temperature):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def margins(self, texts) -> np.ndarray:
        codes, first = grams(texts)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.r_[0, np.cumsum(self.weights[:, k][codes], dtype=np.float64)]
            out[:, k] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) + self.bias[k]
        return out

    def probabilities(self, margins) -> np.ndarray:
        e = np.exp((margins - margins.max(1, keepdims=True)) / self.temperature)
        return e / e.sum(1, keepdims=True)


def _softmax(m):
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, rows: int = ROWS, epochs: int = 4, batch: int = 32, seed: int = 11) -> Model | None:
    """(doc_id, text, lang) -> the model; the held-out fold is never read."""
    known = docs.where((fold("doc_id", MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.05
    # each language's texts of the smallest hashes: a threshold keeps about twice as many first, so that none gathers in one task
    sizes = F.broadcast(known.groupBy("lang").agg(F.count(F.lit(1)).alias("of")))
    order = F.xxhash64("doc_id")
    some = known.select("doc_id", "lang", "text").join(sizes, "lang").where(F.pmod(order, F.lit(1 << 30)) * F.col("of") <= F.lit(float((1 << 30) * (2 * rows + 100))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id", F.xxhash64("text")))
    sample = some.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy(order, "doc_id", "lang", F.xxhash64("text")).select("text", "lang").collect()
    languages = sorted({r["lang"] for r in sample})
    label = np.array([languages.index(r["lang"]) for r in sample])
    index, value, first = join_rows([sparse([r["text"] for r in sample[k : k + 200]], idf) for k in range(0, len(sample), 200)])
    held = np.arange(len(sample)) % 5 == 4
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(sample))
    model = Ftrl(WIDTH, len(languages), alpha=0.5, l1=0.01, l2=0.01)
    weight = 1 / np.maximum(np.bincount(label, minlength=len(languages)), 1) * len(label) / len(languages)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            i, x, begin = rows_of(index, value, first, some)
            slope = _softmax(model.margins(i, x, begin))
            slope[np.arange(len(some)), label[some]] -= 1
            model.update(i, x, begin, slope * weight[label[some], None])
    temperature = 1.0
    if held.any():
        some = np.flatnonzero(held)
        margins = model.margins(*rows_of(index, value, first, some))
        loss = lambda t: -np.log(np.maximum(_softmax(margins / t)[np.arange(len(some)), label[some]], 1e-12)).mean()
        temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return Model(languages, (model.w * idf[:, None] * SCALE).astype(np.float32), model.bias, float(temperature))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers for each language

    def each(texts):
        model = shared.value
        lettered = np.array([isinstance(x, str) and any(map(str.isalpha, x)) for x in texts], bool)
        name, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if model is not None and lettered.any():
            p = model.probabilities(model.margins([x for x, good in zip(texts, lettered, strict=True) if good]))
            best = p.argmax(1)
            name[lettered], score[lettered] = np.array(model.languages, object)[best], p[np.arange(len(p)), best]
        return [name, score]

    return map_texts(docs, ["doc_id"], lambda: each, "lang_pred string, score double")


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(fold("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    """op10: every document's language."""
    return classify(table(spark, sf_dir, "documents"))
