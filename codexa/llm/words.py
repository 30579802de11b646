"""Vectorised word scanning: hashes of all words of a batch of texts, without a Python loop over words.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; a null text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit numbers; another seed gives another order."""
    x = x ^ _U((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & (2**64 - 1)) if seed else x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        for key, base in (("up", _STEP), ("down", _BACK)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
        _powers["n"] = n
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums S with which any span has a hash: (S[end] - S[start]) * down(start)."""
    up, _ = _power(max(len(data), 1))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


@dataclass
class Words:
    """All words of a batch: ``doc`` of each word, its byte span in ``data``, and ``first``: where each text's words begin (n + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    offset: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(self.data), self.start, self.end)


def scan(texts, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """Find the words of the texts (str or None); ``space`` says which of the 256 bytes part words."""
    raw = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    offset = np.cumsum(lengths + 1) - lengths - 1
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.r_[offset, len(data)])
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    return Words(data, start, end, doc, first, lengths, offset)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of texts whose word hashes are ``words[first[i]:first[i + 1]]``.

    A text with fewer than k words (but one at least) has one: the whole sequence. Returns (hashes, first).
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.r_[0, np.cumsum(count)]
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_first[-1]) - out_first[doc] + first[doc]
    used = np.minimum(n[doc], k).astype(np.uint64)
    h = mix(used, 77)
    for j in range(k):
        some = j < n[doc]
        nxt = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else at.astype(np.uint64)
        h = np.where(some, mix(h * _ODD + nxt), h)
    return h, out_first
