"""Toxicity: a counterfactual-regularised logistic classifier over the words of a text.

Features are the presence of a word, of its 4- and of its 5-byte beginning (hashed). For labelled texts that mention an
identity group, a counterfactual is made by swapping each identity term for another of its list; the loss adds
``swap_weight`` times the squared change of the margin, so that a group's name by itself doesn't move the score. The
weights are fitted by follow-the-regularised-leader with an l1 penalty: a long text's many neutral words weigh 0. How strong
it is, is chosen by the loss on a third of the training rows.

Edge cases: null and empty texts have the bias alone, and a score; repeated rows score alike; without labels of both
classes all scores are that of the bias; an empty table gives no rows; labels, language, source and id are never inputs.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import fold, labelled_sample, map_texts, private, table
from codexa.llm.ftrl import Ftrl, join_rows, rows_of
from codexa.llm.words import prefix_sums, scan, span_hash

WIDTH, MODULUS, HELD_OUT, ROWS, THRESHOLD = 1 << 18, 4, 2, 3000, 0.3
PENALTIES = (3.0, 6.0, 12.0, 24.0)

#: Terms of one list stand for each other: group names by number and language.
IDENTITY_TERMS = (
    ("women", "men", "gays", "lesbians", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "blacks", "whites", "asians", "latinos", "africans", "immigrants", "refugees", "americans"),
    ("woman", "man", "lesbian", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee"),
    ("gay", "straight", "transgender", "bisexual", "black", "white", "asian", "latino", "african", "jewish", "disabled", "deaf", "blind"),
    ("frauen", "männer", "muslime", "christen", "juden", "hindus", "schwarze", "weiße", "flüchtlinge", "ausländer", "schwule", "lesben"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "réfugiés", "immigrés", "arabes"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "refugiados", "inmigrantes", "gitanos"),
)
_LIST = {term.casefold(): terms for terms in IDENTITY_TERMS for term in terms}
_TERM = re.compile(r"\b(" + "|".join(sorted({re.escape(t) for terms in IDENTITY_TERMS for t in terms}, key=len, reverse=True)) + r")\b", re.IGNORECASE)

_BREAK = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False


def swapped(text: str, rng: np.random.Generator | None = None) -> str | None:
    """The text with every identity term swapped for any other of its list, or None if it has none."""
    if not _TERM.search(text):
        return None
    rng = rng or np.random.default_rng(0)

    def other(m):
        term = m[0].casefold()  # the pattern also matches letters that only fold to those of a term
        rest = [x for x in _LIST.get(term, ()) if x.casefold() != term]
        return rest[rng.integers(len(rest))] if rest else m[0]

    return _TERM.sub(other, text)


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (index, value 1, first) of whole texts; words are runs of letters, digits and non-ASCII characters."""
    w = scan(texts, space=_BREAK)
    n = len(w.lengths)
    sums = prefix_sums(w.data)
    kinds = [span_hash(sums, w.start, w.end)]
    doc = [w.doc]
    for length in (4, 5):
        long = w.end - w.start > length
        kinds.append(span_hash(sums, w.start[long], w.start[long] + length) ^ np.uint64(0x5851F42D4C957F2D + length))
        doc.append(w.doc[long])
    pairs = np.unique(np.concatenate(doc).astype(np.int64) * WIDTH + (np.concatenate(kinds) >> np.uint64(46)).astype(np.int64))
    return pairs % WIDTH, np.ones(len(pairs), np.float32), np.r_[0, np.cumsum(np.bincount(pairs // WIDTH, minlength=n))]


def fit(texts: list[str], label, swap_weight: float = 1.0, epochs: int = 8, batch: int = 32, l1: float = 12.0, seed: int = 5) -> Ftrl:
    """Both classes weigh alike; counterfactual pairs take turns with the batches."""
    model = Ftrl(WIDTH, 1, alpha=1.0, l1=l1, l2=0.05)
    label = np.asarray(label, np.float64)
    if len(set(label)) < 2:
        return model
    part = lambda xs: join_rows([features(xs[k : k + 200]) for k in range(0, len(xs), 200)])
    index, value, first = part(texts)
    rng = np.random.default_rng(seed)
    pairs = [(t, s) for t in texts if (s := swapped(t, rng)) is not None]
    facts, others = part([t for t, _ in pairs]), part([s for _, s in pairs])
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            i, x, begin = rows_of(index, value, first, docs)
            p = 1 / (1 + np.exp(-np.clip(model.margins(i, x, begin), -30, 30)))
            model.update(i, x, begin, (p - label[docs, None]) * weight[docs, None])
            if pairs and swap_weight:
                some = rng.integers(0, len(pairs), min(batch, len(pairs)))
                a, b = rows_of(*facts, some), rows_of(*others, some)
                change = np.clip(model.margins(*a) - model.margins(*b), -4, 4) * 2 * swap_weight
                i, x, begin = join_rows([a, b])
                bias = model.bias.copy(), model.bias_n.copy()
                model.update(i, x, begin, np.r_[change, -change])
                model.bias, model.bias_n = bias
    return model


def margins(model: Ftrl, texts: list[str]) -> np.ndarray:
    out = [np.zeros(0)]
    for k in range(0, len(texts), 200):
        index, _, first = features(texts[k : k + 200])
        sums = np.r_[0, np.cumsum(model.w[index, 0].astype(np.float64))]
        out.append(np.clip(model.bias[0] + sums[first[1:]] - sums[first[:-1]], -30, 30))
    return np.concatenate(out)


def penalty(texts: list[str], label, swap_weight: float, choices: tuple[float, ...] = PENALTIES) -> float:
    """The l1 penalty of least loss on every third training row, fitted on the others; the larger of equals."""
    label = np.asarray(label, np.float64)
    rest = np.arange(len(label)) % 3 == 0
    if min(len(set(label[rest])), len(set(label[~rest]))) < 2:
        return max(choices)
    known, asked = ([t for t, r in zip(texts, rest, strict=True) if r == side] for side in (False, True))
    weight = np.where(label[rest] == 1, 0.5 / label[rest].mean(), 0.5 / (1 - label[rest].mean()))
    loss = {}
    for l1 in choices:
        m = margins(fit(known, label[~rest], swap_weight, l1=l1), asked)
        loss[l1] = float(np.mean(weight * np.logaddexp(0, np.where(label[rest] == 1, -m, m))))
    return min(sorted(choices, reverse=True), key=loss.get)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, swap_weight: float = 1.0) -> Ftrl:
    """Fit on at most ``rows`` texts of each class from outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, MODULUS, HELD_OUT, rows)
    texts, values = [r["text"] for r in sample], [r["label"] for r in sample]
    return fit(texts, values, swap_weight, l1=penalty(texts, values, swap_weight))


def score(docs: DataFrame, model: Ftrl, text: str = "text") -> DataFrame:
    """All columns but the text, plus score (double, 0 to 1)."""
    used = np.flatnonzero(model.w[:, 0])
    shared = docs.sparkSession.sparkContext.broadcast((used, model.w[used, 0], float(model.bias[0])))  # at most WIDTH weights
    kept = [c for c in docs.columns if c != text]

    def make():
        used, weights, bias = shared.value
        dense = np.zeros(WIDTH)
        dense[used] = weights

        def each(texts):
            index, _, first = features(texts)
            sums = np.r_[0, np.cumsum(dense[index])]
            margin = np.clip(bias + sums[first[1:]] - sums[first[:-1]], -30, 30)
            return [1 / (1 + np.exp(-margin))]

        return each

    return map_texts(docs, kept, make, f"{private(docs.select(*kept), 'score')} double", text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir):
    """op7: every document's toxicity score."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
