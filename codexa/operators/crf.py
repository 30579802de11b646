"""Sequence labelling: linear-chain CRF models with feature templates, decoded by Viterbi in Arrow batches.

A model has templates (``u…`` unigram, ``b…`` bigram) over a window of the feature columns, labels, observations and weights.
A sequence is one row (an array of rows of features), so no batch boundary cuts it; the model is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = re.compile(r"%([xX])\[(@?)(-?\d+),(\d+)\]")


@dataclass
class Template:
    """``name:%x[row,column]/…``: which values around a place make an observation."""

    text: str
    bigram: bool = field(init=False)

    def __post_init__(self):
        self.bigram = self.text[:1] in "bB*"

    def observation(self, rows: Sequence[Sequence[str]], at: int) -> str | None:
        """The observation at a place; before and after the sequence stand ``_x-1``, ``_x+1`` and so on. Null without that column."""
        missing = False

        def value(m: re.Match) -> str:
            nonlocal missing
            row, column = int(m[3]) + (0 if m[2] else at), int(m[4])
            if m[2] and row < 0:
                row += len(rows)
            if row < 0:
                return f"_x{row}"
            if row >= len(rows):
                return f"_x+{row - len(rows) + 1}"
            if column >= len(rows[row]):
                missing = True
                return ""
            return rows[row][column].lower() if m[1] == "X" else rows[row][column]

        out = _PLACE.sub(value, self.text)
        return None if missing else out


@dataclass
class Crf:
    """Weights: unigram[observation] has one for each label, bigram[observation] one for each pair (from, to)."""

    templates: list[Template]
    labels: list[str]
    unigram: dict[str, np.ndarray]
    bigram: dict[str, np.ndarray]

    def scores(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """(steps x labels) and (steps x labels x labels); observations that the model doesn't know add nothing."""
        n, m = len(rows), len(self.labels)
        one, two = np.zeros((n, m)), np.zeros((n, m, m))
        for t in range(n):
            for template in self.templates:
                seen = template.observation(rows, t)
                if seen is None:
                    raise ValueError(f"{template.text}: no such column at {t}")
                if template.bigram:
                    two[t] += self.bigram.get(seen, 0) if t else 0
                else:
                    one[t] += self.unigram.get(seen, 0)
        return one, two

    def decode(self, rows) -> tuple[list[str], float]:
        """The best labels and their score; of equal paths the one whose labels come first."""
        if not rows:
            return [], 0.0
        one, two = self.scores(rows)
        best, back = one[0], []
        for t in range(1, len(rows)):
            through = best[:, None] + two[t]
            back.append(through.argmax(0))
            best = through.max(0) + one[t]
        at = int(best.argmax())
        path = [at]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return [self.labels[k] for k in reversed(path)], float(best[at])


def read_model(text: str) -> Crf:
    """A model from lines ``p template``, ``l label``, ``u observation label weight``, ``b observation from to weight``.

    Weights may be decimal or hexadecimal floating-point numbers.
    """
    templates, labels, one, two = [], [], {}, {}
    number = lambda x: float.fromhex(x) if "0x" in x.lower() else float(x)
    rows = [line.split() for line in text.splitlines() if line.strip()]
    for kind, *rest in rows:
        if kind == "p":
            templates.append(Template(rest[0]))
        elif kind == "l":
            labels.append(rest[0])
    for kind, *rest in rows:
        if kind == "u":
            one.setdefault(rest[0], np.zeros(len(labels)))[labels.index(rest[1])] = number(rest[2])
        elif kind == "b":
            two.setdefault(rest[0], np.zeros((len(labels),) * 2))[labels.index(rest[1]), labels.index(rest[2])] = number(rest[3])
    return Crf(templates, labels, one, two)


def label(sequences: DataFrame, model: Crf, key: str = "seq_id") -> DataFrame:
    """(key, rows array<array<string>>) -> key, labels array<string>, score."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    kind = dict(sequences.dtypes)[key]

    def run(frames):
        for frame in frames:
            found = [shared.value.decode([list(r) for r in rows] if rows is not None else []) for rows in frame["rows"]]
            yield frame[[key]].assign(labels=[f[0] for f in found], score=[f[1] for f in found])

    return sequences.select(key, "rows").mapInPandas(run, f"{key} {kind}, labels array<string>, score double")


def begin_flags(labelled: DataFrame) -> DataFrame:
    """IOB to begin form: 'B-x' begins x, 'I-x' goes on with it, 'O' is '<other>'."""
    return labelled.withColumn("is_begin", F.col("label").startswith("B-")).withColumn(
        "label", F.when(F.col("label") == "O", "<other>").otherwise(F.regexp_replace("label", "^[BIE]-", ""))
    )
