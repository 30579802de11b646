"""Benchmark decontamination by latent semantic retrieval and a check of the words.

1. Texts become streams of hashed words; document frequencies are counted over all documents, and give weights (idf).
2. Passages are pairs of neighbouring blocks of ``BLOCK`` words. A randomised SVD of the TF-IDF matrix of all passages is made
   in a distributed way: a sign sketch of its rows (one vector of fixed width for each sketch row, added up over all tasks)
   spans the row space; a second pass over the passages gives the small Gram matrix, whose eigenvectors turn the span into
   singular vectors.
3. Every passage of every document is projected, whitened and compared (cosine) with every benchmark item: a stated query set
   against all rows, in blocks of the matrix product. Long items are queried by pieces of a passage's length. Besides these,
   every passage that holds ``GRAM`` words in a row of an item is a candidate, whatever its cosine, so that passages that stand
   word for word are found even where their words are too common to weigh anything.
4. Candidates are checked on the words around the passage: the longest common subsequence with the item must cover
   ``overlap`` of the item's words, or ``paraphrase`` of them if the item's answer (its last sentence) is there too, in order.

Edge cases: null and empty texts and items match nothing; a text shorter than a passage is one passage; items of fewer
than ``MIN_WORDS`` words are too short to tell and are only matched where their whole sequence of words stands; repeated
rows are reported one by one; an empty table gives no rows; a benchmark of more than ``MAX_ITEMS`` items or ``MAX_CHARS``
characters is brought to the tasks in parts, one after another.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import gather, map_texts, materialise, pieces, private, table
from codexa.llm.words import mix, scan

WIDTH, RANK, EXTRA, BLOCK, PIECE = 1 << 15, 64, 8, 24, 1 << 12
COMMON, GRAM, SIGNATURE, WORDS = 0.05, 4, 1024, 20_000
COSINE, OVERLAP, PARAPHRASE, MIN_WORDS = 0.4, 0.75, 0.55, 8
MAX_ITEMS, MAX_CHARS = 20_000, 20_000_000

_EDGE = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _EDGE[_a:_b] = False


def word_stream(texts) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words (letters, digits, non-ASCII; lower case) and where each text's begin."""
    w = scan(texts, space=_EDGE)
    return (w.hashes() >> np.uint64(32)).astype(np.uint32), w.first


def streams(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n, words binary."""

    def each(texts):
        h, first = word_stream(texts)
        return [np.diff(first), [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]]

    return map_texts(docs.select("doc_id", "text"), ["doc_id"], lambda: each, "n long, words binary")


def _flat(frame) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(frame["words"]), np.uint32)
    return h, np.r_[0, np.cumsum(frame["n"].to_numpy(np.int64))]


def _small(frames, words: int = WORDS):
    for frame in frames:
        group = np.cumsum(frame["n"].to_numpy(np.int64)) // words
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]


def column(h: np.ndarray) -> np.ndarray:
    return (h & np.uint32(WIDTH - 1)).astype(np.int64)


def frequencies(owned: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each hashed word, and the number of documents."""

    def run(frames):
        total = np.zeros(WIDTH + 1, np.int64)
        for frame in _small(frames):
            h, first = _flat(frame)
            col = column(h)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                seen = np.zeros(WIDTH, bool)
                seen[col[a:b]] = True
                total[:WIDTH] += seen
            total[WIDTH] += len(frame)
        if total[WIDTH]:
            yield pieces(total, PIECE)

    total = gather(owned.select("n", "words").mapInPandas(run, "piece int, data binary"), WIDTH + 1, PIECE)
    return total[:WIDTH], int(total[WIDTH])


def blocks_of(first: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of all texts, and for each block its text. A text's last block may be short."""
    n = np.diff(first)
    count = -(-n // size)
    doc = np.repeat(np.arange(len(n)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + inner * size, doc


def passages(block_rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of passages: each block with the next of its text (a last one stands by itself)."""
    more = np.r_[doc[1:] == doc[:-1], False]
    nxt = np.vstack([block_rows[1:], np.zeros((1, block_rows.shape[1]), block_rows.dtype)])
    return block_rows + nxt * more[:, None]


def block_sums(table: np.ndarray, h: np.ndarray, first: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """For each block the sum of its words' rows of ``table``, whose last row is for no word."""
    start, doc = blocks_of(first, size)
    out = np.zeros((len(start), table.shape[1]), table.dtype)
    col, end = np.r_[column(h), WIDTH], first[1:][doc]
    for j in range(size):
        out += table[col[np.where(start + j < end, start + j, len(h))]]
    return out


def with_nothing(rows: np.ndarray) -> np.ndarray:
    """``rows`` and one of zeros, as :func:`block_sums` takes them."""
    return np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def signs(names: np.ndarray, width: int) -> np.ndarray:
    """(len(names) x width) of 1 and -1, drawn from each name by itself."""
    lanes = [mix(names, 31 + k) for k in range(-(-width // 64))]
    bits = np.unpackbits(np.stack(lanes, 1).view(np.uint8).reshape(len(names), -1), axis=1)[:, :width]
    return bits.astype(np.float32) * 2 - 1


def sketch(owned: DataFrame, weights, width: int) -> np.ndarray:
    """(width x WIDTH): random signed sums of all passages' TF-IDF rows.

    A passage's sign row belongs to its first block, so a block's words get the sum of the two passages it is in. The
    signs are drawn from the document's id and the block's place, so they are the same however the rows are dealt.
    """

    def run(frames):
        total = np.zeros((width, WIDTH))
        for frame in _small(frames, 10 * WORDS):
            h, first = _flat(frame)
            if not len(h):
                continue
            start, doc = blocks_of(first)
            s = signs(frame["seed"].to_numpy().view(np.uint64)[doc] + (start - first[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), width)
            before = np.vstack([np.zeros((1, width), np.float32), s[:-1]]) * np.r_[False, doc[1:] == doc[:-1]][:, None]
            s = s + before
            sizes = np.diff(np.r_[start, len(h)])
            col = column(h)
            keep = weights.value[col] > 0
            col, block = col[keep], np.repeat(np.arange(len(start)), sizes)[keep]
            if not len(col):
                continue
            for r, row in enumerate(np.ascontiguousarray(s.T)):
                total[r] += np.bincount(col, weights=row[block], minlength=WIDTH)
        if total.any():
            yield pieces((total * weights.value).astype(np.float32).ravel(), PIECE * 4)

    named = owned.select("n", "words", F.xxhash64("doc_id").alias("seed"))
    return gather(named.mapInPandas(run, "piece int, data binary"), width * WIDTH, PIECE * 4, "float32").reshape(width, WIDTH).astype(np.float64)


def _project(frame, rows: np.ndarray):
    """Passage rows in the coordinates of ``rows`` (WIDTH x k, and a row of zeros), and starts and texts of their blocks."""
    h, first = _flat(frame)
    start, doc = blocks_of(first)
    if not len(start):
        return np.zeros((0, rows.shape[1]), np.float32), start, doc, h, first
    return passages(block_sums(rows, h, first), doc), start, doc, h, first


def gram(owned: DataFrame, basis) -> np.ndarray:
    """Sum of the outer products of all projected passages (k x k)."""
    k = basis.value.shape[1]

    def run(frames):
        total, rows = np.zeros((k, k)), with_nothing(basis.value)
        for frame in _small(frames):
            p = _project(frame, rows)[0].astype(np.float64)
            total += p.T @ p
        yield pieces(total.ravel(), PIECE)

    return gather(owned.select("n", "words").mapInPandas(run, "piece int, data binary"), k * k, PIECE, "float64").reshape(k, k)


def latent(owned: DataFrame, rank: int = RANK, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """(WIDTH x rank) from TF-IDF columns to whitened latent coordinates (idf included), and the singular values."""
    spark = owned.sparkSession
    df, n = frequencies(owned)
    # words of many documents say little about a passage and would fill the first directions: they weigh less, but never nothing
    share = df / max(n, 20)
    idf = np.log((2 + n) / (1 + df)) * np.minimum(1, COMMON / np.maximum(share, 1e-12)) ** 2
    weights = spark.sparkContext.broadcast(idf)
    q, _ = np.linalg.qr(sketch(owned, weights, rank + extra).T)
    basis = spark.sparkContext.broadcast((q * idf[:, None]).astype(np.float32))
    values, vectors = np.linalg.eigh(gram(owned, basis))
    top = np.argsort(values)[::-1][:rank]
    values = np.sqrt(np.maximum(values[top], 1e-9))
    return (q * idf[:, None] @ vectors[:, top] / values * np.sqrt(max(n, 1))).astype(np.float32), values


def places_of(words) -> tuple[dict[int, int], int]:
    """For each word the bits of its places, and the number of words."""
    places: dict[int, int] = {}
    for i, x in enumerate(words):
        places[x] = places.get(x, 0) | 1 << i
    return places, len(words)


def lcs(a, b) -> int:
    """Longest common subsequence, in bit-parallel form: one row of the table is one whole number. ``a``: of :func:`places_of`."""
    places, n = a
    row = full = (1 << n) - 1
    for y in b:
        hit = row & places.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` stands in ``words`` as it is."""
    if not len(part) or len(part) > len(words):
        return False
    return any((words[i : i + len(part)] == part).all() for i in np.flatnonzero(words[: len(words) - len(part) + 1] == part[0]))


def answer_of(text: str) -> str:
    """An item's answer: what follows its last question mark or line break, or else its last sentence."""
    pieces_ = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x.strip()]
    return pieces_[-1] if pieces_ else ""


def item_parts(benchmark: DataFrame, rows: int = MAX_ITEMS, chars: int = MAX_CHARS) -> list[DataFrame]:
    """The items that have a text and an id, each once, in as many parts as their number and size ask for."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    parts = max(-(-size["n"] * 2 // rows), -(-size["c"] * 2 // chars)) if size["n"] > rows or size["c"] > chars else 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items for k in range(parts)]


def items_of(part: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item_id, words, words of the answer) of the items of a part that have words."""
    out = []
    for row in sorted(part.collect()):  # bounded by item_parts
        words, answer = word_stream([row["text"]])[0], word_stream([answer_of(row["text"])])[0]
        if len(words):
            out.append((row["item_id"], words, answer))
    return out


def queries_of(items, rows: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the items, or of their pieces of a passage's length, whose each is, and the cosine asked of it.

    An item shorter than a passage fills only a part of it, so less is asked: in proportion to the root of its share.
    """
    vectors, owner, asked = [], [], []
    for k, (_, words, _) in enumerate(items):
        parts = [words] if len(words) <= 3 * BLOCK else [words[i : i + 2 * BLOCK] for i in range(0, len(words) - BLOCK, BLOCK)]
        for part in parts:
            v = rows[column(part)].sum(0)
            vectors.append(v / max(float(np.linalg.norm(v)), 1e-9))
            owner.append(k)
            asked.append(cosine * min(1.0, len(part) / (2 * BLOCK)) ** 0.5)
    return np.array(vectors, np.float32).reshape(-1, rows.shape[1]), np.array(owner, np.int64), np.array(asked, np.float32)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` words in a row."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        out = (out + h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def keys_of(items) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: bits of the hashes that occur, the sorted hashes of the items' words in a row, and whose each is."""
    found: dict[int, set[tuple[int, int]]] = {}
    for k, (_, words, _) in enumerate(items):
        size = min(GRAM, len(words))
        found.setdefault(size, set()).update((x, k) for x in grams(words, size).tolist())
    out = {}
    for size, pairs in found.items():
        ordered = sorted(pairs)
        keys = np.array([x for x, _ in ordered], np.uint64)
        bits = np.zeros(1 << 20, bool)
        bits[keys >> np.uint64(44)] = True
        out[size] = bits, keys, np.array([k for _, k in ordered], np.int64)
    return out


def in_a_row(h: np.ndarray, first: np.ndarray, start: np.ndarray, keys, items: int) -> np.ndarray:
    """passage * items + item where an item's words stand in a row, with the passage of the block they begin in."""
    out = [np.zeros(0, np.int64)]
    for size, (bits, known, owner) in keys.items():
        g = grams(h, size)
        at = np.flatnonzero(bits[g >> np.uint64(44)])
        low, high = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
        at, low, high = (x[high > low] for x in (at, low, high))
        end = first[np.searchsorted(first, at, "right")]
        at, low, high = (x[at + size <= end] for x in (at, low, high))
        count = high - low
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        block = np.repeat(np.searchsorted(start, at, "right") - 1, count)
        out.append(np.unique(block * items + owner[which]))
    return np.unique(np.concatenate(out))


def signatures(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Level k holds, for each block, the bits of the words of 2 ** k blocks from it on."""
    bits = np.zeros((len(start), SIGNATURE), bool)
    block = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(h)]))
    bits[block, (h >> np.uint32(5)) & np.uint32(SIGNATURE - 1)] = True
    levels = [np.packbits(bits, axis=1).view(np.uint64)]
    while 1 << len(levels) <= len(start):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(last | np.vstack([last[step:], last[:step] * np.uint64(0)]))
    return levels


def enough(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the blocks low..high (inclusive) have ``least`` at least of the bits wanted (one row each)."""
    level = np.int64(np.log2(high - low + 1))
    out = np.zeros(len(low), bool)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        have = (levels[k][low[at]] | levels[k][high[at] - (1 << k) + 1]) & wanted[at]
        out[at] = np.bitwise_count(have).sum(1) >= least[at]
    return out


def search(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, overlap: float = OVERLAP, paraphrase: float = PARAPHRASE) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, place, common, item_words, answer: one row for each document and item it holds."""
    shape = "doc_id long, item_id long, place long, common long, item_words long, answer boolean"
    spark = docs.sparkSession
    parts = [x for x in map(items_of, item_parts(benchmark)) if x]
    if not parts:
        return spark.createDataFrame([], shape)
    owned = materialise(streams(docs), "passage-words")
    rows, _ = latent(owned)
    found = [_search(owned, items, rows, cosine, overlap, paraphrase, shape) for items in parts]
    return reduce(DataFrame.unionByName, found)


def _search(owned: DataFrame, items: list, rows: np.ndarray, cosine: float, overlap: float, paraphrase: float, shape: str) -> DataFrame:
    """One part of the items against all rows."""
    vectors, owner, asked = queries_of(items, rows, cosine)
    shared = owned.sparkSession.sparkContext.broadcast((rows, vectors, owner, asked, items, keys_of(items)))

    def check(region: np.ndarray, wanted: np.ndarray, parts):
        n = len(wanted)
        if n < MIN_WORDS:
            return (n, True) if holds(region, wanted) else None
        # the words of a window a little longer than the item, best of half-overlapping ones
        words, answer = parts
        at = [i for i, x in enumerate(region.tolist()) if x in words[0]]
        known = region[at].tolist()
        size = max(n * 3 // 2, 1)
        best, answered, low, high = 0, False, 0, 0
        for i in range(0, max(len(region) - size, 0) + 1 + size // 3, max(size // 3, 1)):
            while low < len(at) and at[low] < i:
                low += 1
            while high < len(at) and at[high] < i + size:
                high += 1
            if high - low > best:
                found = lcs(words, known[low:high])
                if found > best:
                    best, answered = found, answer[1] > 0 and lcs(answer, region[i : i + size].tolist()) >= 0.8 * answer[1]
        share = best / n
        return (best, answered) if share >= overlap or (share >= paraphrase and answered) else None

    def run(frames):
        import pandas as pd

        rows, vectors, owner, asked, items, keys = shared.value
        rows = with_nothing(rows)
        kinds = [set(words.tolist()) for _, words, _ in items]
        parts = [(places_of(words.tolist()), places_of(answer.tolist())) for _, words, answer in items]
        # an item's words that a common subsequence misses are at most this share, so the others must stand near
        least = [len(kind) - (1 - paraphrase) * len(words) if len(words) >= MIN_WORDS else len(kind) for kind, (_, words, _) in zip(kinds, items, strict=True)]
        bits = np.zeros((len(items), SIGNATURE), bool)
        for k, (_, words, _) in enumerate(items):
            bits[k, (words >> np.uint32(5)) & np.uint32(SIGNATURE - 1)] = True
        # each word that may be missing takes one bit at most
        few = bits.sum(1) - np.array([len(kind) for kind in kinds]) + np.array(least)
        marks = np.packbits(bits, axis=1).view(np.uint64)
        reach = np.array([len(words) for _, words, _ in items])
        for frame in _small(frames):
            p, start, doc, h, first = _project(frame, rows)
            if not len(p):
                continue
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
            found = [in_a_row(h, first, start, keys, len(items))]
            for a in range(0, len(p), 4096):
                close, which = np.nonzero(p[a : a + 4096] @ vectors.T >= asked)
                found.append((close + a) * len(items) + owner[which])
            passage, item = np.divmod(np.unique(np.concatenate(found)), len(items))
            if not len(passage):
                continue
            low = np.maximum(first[doc[passage]], start[passage] - reach[item])
            high = np.minimum(first[doc[passage] + 1], start[passage] + 2 * BLOCK + reach[item])
            block = np.searchsorted(start, low, "right") - 1, np.searchsorted(start, high, "left") - 1
            good = enough(signatures(h, start), *block, marks[item], few[item])
            out: dict[tuple[int, int], tuple] = {}
            for i, k, x, y in zip(passage[good].tolist(), item[good].tolist(), low[good].tolist(), high[good].tolist(), strict=True):
                d, at = int(doc[i]), int(start[i])
                if len(kinds[k].intersection(h[x:y].tolist())) < least[k]:
                    continue
                best = check(h[x:y], items[k][1], parts[k])
                if best and ((d, k) not in out or (best, -at) > (out[d, k][1:], -out[d, k][0])):
                    out[d, k] = (at, *best)
            if out:
                d, k = (np.array(x) for x in zip(*out, strict=True))
                values = list(out.values())
                yield pd.DataFrame({"name": frame["name"].to_numpy()[d], "item_id": [items[x][0] for x in k], "place": [x[0] for x in values] - first[d], "common": [x[1] for x in values], "item_words": reach[k], "answer": [bool(x[2]) for x in values]})

    # ids go round Python as text, so that large ones beside nulls keep their value
    fields = shape.replace("doc_id long", "name string")
    made = owned.select(F.col("doc_id").cast("string").alias("name"), "n", "words").mapInPandas(run, fields)
    return made.select(F.col("name").cast("long").alias("doc_id"), *[c for c in made.columns if c != "name"])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows are matched by a hash of id and text."""
    row = private(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = search(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, **options)
    return keyed.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def query(spark, sf_dir):
    """op1: which documents hold which benchmark items."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
