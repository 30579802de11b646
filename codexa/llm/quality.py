"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the number of features.
It is fitted on the driver with AdaGrad on at most ``rows`` labelled texts of each class (a bounded sample) and then
scores every document whole. Labels, language, source and id are never inputs.

Edge cases: a null or empty text has only the bias and the structure features, and a score; repeated rows score alike;
without labels of both classes the score is the constant 0.5; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import fold, labelled_sample, map_texts, private, table
from codexa.llm.words import scan

HASHED, RANK, MODULUS, HELD_OUT, ROWS = 1 << 15, 8, 3, 1, 3000
STRUCTURE = 16
BUCKETS = 8  # of each structure statistic, one feature each
WIDTH = HASHED + STRUCTURE * BUCKETS

_CLASS = np.full(256, 4, np.uint8)  # 0 letter, 1 capital, 2 digit, 3 space, 4 symbol
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3


def _share(x, n):
    return x / np.maximum(n, 1)


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (feature index, value, first). Words weigh 1 / sqrt(distinct words); statistics 1 in their bucket."""
    w = scan(texts, lower=False)
    n_docs = len(w.lengths)
    per_doc = lambda mask: np.add.reduceat(mask.astype(np.int64), w.offset) - mask[w.offset + w.lengths] if n_docs else np.zeros(0)
    kind = _CLASS[w.data]
    n_words, size = np.diff(w.first), w.lengths
    letters, capitals, digits, symbols = (per_doc(kind == k) for k in (0, 1, 2, 4))
    word_len = (w.end - w.start).astype(np.int64)
    sum_by_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n_docs)
    h = w.hashes()
    same_as_last = np.r_[False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])]
    last_kind = kind[w.end - 1] if len(h) else np.zeros(0)
    lower = scan(texts).hashes() % np.uint64(HASHED)
    pairs = np.unique(w.doc.astype(np.int64) * HASHED + lower.astype(np.int64))
    doc, index = pairs // HASHED, pairs % HASHED
    distinct = np.bincount(doc, minlength=n_docs)
    newline = per_doc(w.data == 10)
    stats = (
        _share(capitals, letters + capitals), _share(symbols, size), _share(digits, size), _share(sum_by_doc(same_as_last), n_words),
        _share(sum_by_doc(word_len), n_words) / 12, _share(distinct, n_words), _share(per_doc(w.data == 124), n_words), _share(per_doc(w.data == 33), n_words),
        _share(newline, n_words) * 4, _share(sum_by_doc(last_kind == 4), n_words), _share(per_doc((w.data == 46) | (w.data == 63)), n_words) * 2, _share(sum_by_doc(word_len == 1), n_words),
        np.log1p(n_words) / 12, np.log1p(size) / 14, _share(per_doc((w.data == 36) | (w.data == 35) | (w.data == 37) | (w.data == 38) | (w.data == 42)), n_words), _share(sum_by_doc(word_len > 14), n_words) * 2,
    )
    bucket = np.stack([np.clip(np.sqrt(np.clip(s, 0, 1)) * BUCKETS, 0, BUCKETS - 1).astype(np.int64) for s in stats], 1) if n_docs else np.zeros((0, STRUCTURE), np.int64)
    extra = HASHED + np.arange(STRUCTURE) * BUCKETS + bucket
    all_doc = np.r_[doc, np.repeat(np.arange(n_docs), STRUCTURE)]
    all_index = np.r_[index, extra.ravel()]
    value = np.r_[1 / np.sqrt(np.maximum(distinct[doc], 1)), np.full(extra.size, 1 / np.sqrt(STRUCTURE))]
    order = np.argsort(all_doc, kind="stable")
    return all_index[order], value[order].astype(np.float32), np.r_[0, np.cumsum(np.bincount(all_doc, minlength=n_docs))]


class Machine:
    """The model: bias, linear weights, factors."""

    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = 7):
        self.bias, self.linear = 0.0, np.zeros(width, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (width, rank)).astype(np.float32)

    def margin(self, index, value, first) -> np.ndarray:
        """Linear time: each feature's factor row is read once."""
        if len(first) < 2:
            return np.zeros(0)
        rows = self.factors[index] * value[:, None]
        total = np.add.reduceat(rows, first[:-1], axis=0)
        squares = np.add.reduceat((rows * rows).sum(1), first[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, first[:-1]) + 0.5 * ((total * total).sum(1) - squares)

    def fit(self, index, value, first, label, epochs: int = 12, rate: float = 0.15, batch: int = 64, decay: float = 1e-4, seed: int = 3) -> Machine:
        """AdaGrad on the logistic loss, the two classes weighing alike."""
        label = np.asarray(label, np.float64)
        if len(set(label)) < 2:
            return self
        weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
        g_lin, g_fac, g_bias = np.full(len(self.linear), 1e-6, np.float32), np.full(self.factors.shape, 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                counts = first[docs + 1] - first[docs]
                begin = np.r_[0, np.cumsum(counts)]
                take = np.repeat(first[docs] - begin[:-1], counts) + np.arange(begin[-1])
                i, x = index[take], value[take]
                rows = self.factors[i] * x[:, None]
                total = np.add.reduceat(rows, begin[:-1], axis=0)
                margin = self.bias + np.add.reduceat(self.linear[i] * x, begin[:-1]) + 0.5 * ((total * total).sum(1) - np.add.reduceat((rows * rows).sum(1), begin[:-1]))
                slope = (1 / (1 + np.exp(-margin)) - label[docs]) * weight[docs] / len(docs)
                each = np.repeat(slope, counts)
                used, inverse = np.unique(i, return_inverse=True)
                d_lin = np.bincount(inverse, weights=each * x, minlength=len(used)).astype(np.float32) + decay * self.linear[used]
                d_rows = (each * x)[:, None] * (np.repeat(total, counts, axis=0) - rows)
                d_fac = np.stack([np.bincount(inverse, weights=d_rows[:, f], minlength=len(used)) for f in range(d_rows.shape[1])], 1).astype(np.float32) + decay * self.factors[used]
                g_lin[used] += d_lin**2
                g_fac[used] += d_fac**2
                g_bias += slope.sum() ** 2
                self.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
                self.factors[used] -= 0.3 * rate * d_fac / np.sqrt(g_fac[used])
                self.bias -= rate * slope.sum() / np.sqrt(g_bias)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Machine:
    """Fit on at most ``rows`` texts of each class from outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, MODULUS, HELD_OUT, rows)
    parts = [features([r["text"] for r in sample[k : k + 200]]) for k in range(0, len(sample), 200)]
    if not parts:
        return Machine()
    index, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    return Machine().fit(index, value, first, [r["label"] for r in sample])


def score(docs: DataFrame, model: Machine, kept: list[str], name: str = "score", text: str = "text") -> DataFrame:
    """The columns ``kept`` plus a score (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: WIDTH x (RANK + 1) numbers

    def each(texts):
        margin = np.clip(shared.value.margin(*features(texts)).astype(np.float64), -30, 30)
        return [1 / (1 + np.exp(-margin))]

    return map_texts(docs, kept, lambda: each, f"`{name}` double", text)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    name = private(docs, "score")
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= threshold).select(docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    """op9: every document's quality score."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
