"""Suffix-array dedup: remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

Suffixes are sorted blockwise with a difference cover, for the places where a repeat can be at all:

1. Each document's windows of ``length`` bytes are put under anchors: the k-gram of least hash in a window (leftmost of
   equals). Equal windows have equal anchors at equal offsets, so only anchors whose k-gram occurs twice can matter.
2. Anchors that occur once are dropped. Of the others, the text around them (all windows that they stand for) goes to the
   task of its k-gram. A task sorts one bucket of suffixes after another: blocks of whole buckets, of bounded size.
3. In a block, a difference cover modulo ``PERIOD`` picks sample positions; their ranks by the next ``DEPTH`` bytes are
   precomputed. Suffixes of one bucket are then parted by a vectorised quicksort, whose comparison reads the first
   bytes up to the period, and settles longer ties by the ranks of the two sample positions at the same distance
   from both suffixes (a difference cover has one below the period for any two). No comparison reads on and on
   through a long repeat, and memory is that of a block.
4. Suffixes that tie over ``length`` bytes are repeats; their spans are merged by document.

A bucket of more than ``HOT`` occurrences isn't gathered: its windows are counted by a 128-bit fingerprint with partial
sums before the shuffle, which is the exact way for the rest.

Edge cases: a null text is empty; documents shorter than ``length`` lose nothing; matches never cross documents, as every
window lies in one; overlapping repeats within a document count; repeated rows count as further documents, and all
lose the same bytes; equal ids with other texts and null ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import chunks, delete, map_texts, materialise, private, table, tidy
from codexa.llm.words import mix, prefix_sums, span_hash

LENGTH, GRAM, PERIOD = 200, 48, 64
BLOCK, HOT = 2_000_000, 60_000

#: A difference cover modulo 64 (every residue is a difference of two of its members).
COVER = (0, 1, 2, 5, 14, 16, 34, 42, 59)


def cover_distance(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """d[r, s]: the least d < period with (r + d) and (s + d) both in the cover modulo the period."""
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    d = np.full((period, period), period, np.int64)
    for shift in range(period - 1, -1, -1):
        at = inside[(np.arange(period) + shift) % period]
        d[np.ix_(at, at)] = shift
    if d.max() >= period:
        raise ValueError("not a difference cover")
    return d


_DISTANCE = None


def utf8(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def anchors_of(data: np.ndarray, length: int, gram: int):
    """Anchors of one text: (k-gram hash, position, first window start, last window start)."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    width = length - gram + 1  # k-grams in a window
    starts = np.arange(n - gram + 1)
    h = span_hash(prefix_sums(data), starts, starts + gram)
    # least of each window by blocks of the window's width; the place is packed into the low bits, so leftmost wins
    bits = np.uint64(max(int(n).bit_length(), 1))
    key = (h >> bits << bits) | starts.astype(np.uint64)
    padded = np.r_[key, np.full(-len(key) % width, np.uint64(2**64 - 1))].reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: len(key) - width + 1], left[width - 1 : len(key)])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    change = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    place = at[change]
    return h[place].astype(np.int64), place, change, np.r_[change[1:], len(at)] - 1


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one big-endian number (zeros after the end)."""
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def sample_ranks(word: np.ndarray, depth: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Ranks of the cover's sample positions by their next ``depth`` bytes (a multiple of 8); 0 elsewhere."""
    n = len(word)
    at = np.flatnonzero(np.isin(np.arange(n) % period, cover))
    rank = np.zeros(len(at), np.int64)
    for j in range(0, depth, 8):
        piece = word[np.minimum(at + j, n - 1)]
        order = np.lexsort((piece, rank))
        new = np.r_[0, np.cumsum((rank[order][1:] != rank[order][:-1]) | (piece[order][1:] != piece[order][:-1]))] if len(at) else rank
        rank[order] = new
    out = np.zeros(n, np.int32)
    out[at] = rank
    return out


def ties(data: np.ndarray, bucket: np.ndarray, suffix: np.ndarray, length: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another of the same bucket.

    ``suffix`` are positions in ``data`` with ``length`` bytes after them. Quicksort on all buckets at once: each round
    compares every suffix still in play with one pivot of its part, and parts it into smaller, equal and greater.
    """
    repeated = np.zeros(len(suffix), bool)
    order = np.argsort(bucket, kind="stable")
    part = np.r_[0, np.cumsum(bucket[order][1:] != bucket[order][:-1])]
    sizes = np.bincount(part)
    play = order[sizes[part] > 1]
    part = part[sizes[part] > 1]
    if not len(play):
        return repeated
    distance, word = cover_distance(period, cover), _words(data)
    depth = (length - period) // 8 * 8
    rank = sample_ranks(word, depth, period, cover)
    head = range(0, -(-period // 8) * 8, 8)
    tail = range(depth, length - 7, 8)
    last = length - 8
    rng = np.random.default_rng(1)
    while len(play):
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        count = np.diff(np.r_[begin, len(play)])
        pivot = np.repeat(play[begin + (rng.random(len(begin)) * count).astype(np.int64)], count)
        i, j = suffix[play], suffix[pivot]
        sign = np.zeros(len(play), np.int8)
        open_ = np.arange(len(play))

        def settle(x, y, sign=sign):
            nonlocal open_
            differ = x != y
            if differ.any():
                sign[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
                open_ = open_[~differ]

        for j8 in head:
            settle(word[i[open_] + j8], word[j[open_] + j8])
        d = distance[i[open_] % period, j[open_] % period]
        settle(rank[i[open_] + d], rank[j[open_] + d])
        for j8 in (*tail, last):
            settle(word[i[open_] + j8], word[j[open_] + j8])
        # equal to the pivot: a class of its own, done; the rest go on, unless alone
        group = np.cumsum(np.r_[False, part[1:] != part[:-1]])
        equal = sign == 0
        many = np.bincount(group[equal], minlength=len(begin)) > 1
        repeated[play[equal]] = many[group[equal]]
        keep = np.flatnonzero(~equal)
        side = group[keep] * 2 + (sign[keep] > 0)
        order = np.argsort(side, kind="stable")
        keep, side = keep[order], side[order]
        sizes = np.bincount(side) if len(side) else np.zeros(1, np.int64)
        alive = sizes[side] > 1 if len(side) else np.zeros(0, bool)
        play, part = play[keep[alive]], side[alive]
    return repeated


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return edge[::2], edge[1::2]


def coalesced(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Spans of the same row that overlap or touch, as one."""
    import pandas as pd

    if not len(row):
        return pd.DataFrame({"row": row, "start": start, "stop": stop})
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.r_[True, row[1:] != row[:-1]]
    lift = (np.cumsum(fresh) - 1) << 40  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + lift)
    begin = np.flatnonzero(np.r_[True, start[1:] + lift[1:] > reach[:-1]])
    last = np.r_[begin[1:], len(row)] - 1
    return pd.DataFrame({"row": row[begin], "start": start[begin], "stop": (reach - lift)[last]})


FRAGMENT = "gram long, row long, first long, anchor int, data binary"
SPANS = "row long, start long, stop long"


def sort_block(frame, length: int):
    """Fragments of whole buckets -> spans of repeated windows, in their documents' positions."""
    import pandas as pd

    # fragments equal as a whole are repeats as a whole; one of them goes into the sort for the others to meet
    whole = [d + a.to_bytes(2, "big") for d, a in zip(frame["data"], frame["anchor"].tolist(), strict=True)]
    codes, kept = pd.factorize(np.array(whole, object))
    alike = np.bincount(codes, minlength=len(kept))[codes] > 1
    copies = frame[alike]
    twin = pd.DataFrame({"row": copies["row"].to_numpy(), "start": copies["first"].to_numpy(), "stop": copies["first"].to_numpy() + copies["data"].str.len().to_numpy(np.int64)})
    frame = frame[~pd.Series(codes).duplicated().to_numpy()]
    twin = coalesced(*(twin[c].to_numpy(np.int64) for c in ("row", "start", "stop")))
    several = frame["gram"].duplicated(keep=False)  # a k-gram with one kind of fragment has nothing more to sort
    frame = frame[several]
    if not len(frame):
        return twin
    data = np.frombuffer(b"".join(frame["data"]), np.uint8)
    size = frame["data"].str.len().to_numpy(np.int64)
    windows = size - length + 1
    piece = np.repeat(np.arange(len(frame)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = (np.cumsum(size) - size)[piece] + inner
    offset = frame["anchor"].to_numpy(np.int64)[piece] - inner
    # one bucket: suffixes that have the same k-gram at the same distance
    names = np.unique(frame["gram"].to_numpy(), return_inverse=True)[1]
    repeated = ties(data, names[piece] * 4096 + offset, suffix, length)
    joint = np.r_[False, piece[1:] == piece[:-1]]
    on = repeated
    start = np.flatnonzero(on & ~np.r_[False, on[:-1] & joint[1:]])
    stop = np.flatnonzero(on & ~np.r_[on[1:] & joint[1:], False])
    p, first = piece[start], frame["first"].to_numpy(np.int64)
    found = coalesced(frame["row"].to_numpy(np.int64)[p], first[p] + inner[start], first[p] + inner[stop] + length)
    return pd.concat([twin, found], ignore_index=True)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(row, text) -> row, start, stop: overlapping spans of bytes to remove."""
    if not 8 * (PERIOD // 8) + gram < length <= 4000:
        raise ValueError("the length must exceed the gram and the period")

    def find(frames):
        import pandas as pd

        for part in chunks(frames):
            found = [anchors_of(np.frombuffer(utf8(x), np.uint8), length, gram) for x in part["text"]]
            counts = [len(x[0]) for x in found]
            if sum(counts):
                gram_, place, low, high = (np.concatenate([x[k] for x in found]) for k in range(4))
                # a window reaches at most ``length`` back, so an anchor's three positions fit one number
                yield pd.DataFrame({"gram": gram_, "row": np.repeat(part["row"].to_numpy(), counts), "at": place << 24 | (place - low) << 12 | (high - low)})

    anchors = materialise(docs.select("row", "text").mapInPandas(find, "gram long, row long, at long"), "suffix-anchors")
    often = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > hot).alias("hot"))
    live = anchors.join(often, "gram").select("row", F.struct("at", "hot").alias("a"))
    live = materialise(live.groupBy("row").agg(F.collect_set("a").alias("anchors")), "suffix-live")  # bounded by the document
    delete(docs.sparkSession, anchors)
    del anchors, often
    tidy(docs.sparkSession)

    def cut(frames):
        import pandas as pd

        for part in chunks(frames):
            rows = []
            for row, text, found in zip(part["row"], part["text"], part["anchors"], strict=True):
                data = utf8(text)
                at = np.array([a["at"] for a in found], np.int64)
                place, low, high = at >> 24, (at >> 24) - (at >> 12 & 4095), (at >> 24) - (at >> 12 & 4095) + (at & 4095)
                # the k-gram's name again, from its bytes: it need not travel twice
                names = span_hash(prefix_sums(np.frombuffer(data, np.uint8)), place, place + gram).astype(np.int64)
                for a, name, p, x, y in zip(found, names.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True):
                    rows.append((name, row, x, p - x, data[x : y + length], a["hot"]))
            frame = pd.DataFrame(rows, columns=["gram", "row", "first", "anchor", "data", "hot"])
            # fragments that this task has twice are repeats as a whole: their spans go on as such, and one goes to the sort
            codes, kinds = pd.factorize(np.array([d + a.to_bytes(2, "big") for d, a in zip(frame["data"], frame["anchor"].tolist(), strict=True)], object))
            copies = frame[np.bincount(codes, minlength=len(kinds))[codes] > 1]
            begin = copies["first"].to_numpy(np.int64)
            known = coalesced(copies["row"].to_numpy(np.int64), begin, begin + copies["data"].str.len().to_numpy(np.int64))
            yield frame[~pd.Series(codes).duplicated().to_numpy()].assign(stop=0)
            yield pd.DataFrame({"gram": known["row"], "row": known["row"], "first": known["start"], "anchor": 0, "data": None, "hot": False, "stop": known["stop"]})

    fragments = docs.select("row", "text").join(live, "row").mapInPandas(cut, FRAGMENT + ", hot boolean, stop long")
    has_hot = live.where(F.exists("anchors", lambda a: a["hot"])).limit(1).count() > 0
    if has_hot:
        fragments = materialise(fragments, "suffix-fragments")

    def sort(frames):
        import pandas as pd

        held, size = [], 0
        for frame in frames:
            known = frame["data"].isna().to_numpy()
            if known.any():
                yield frame.loc[known, ["row", "first", "stop"]].rename(columns={"first": "start"})
                frame = frame[~known]
            if not len(frame):
                continue
            held.append(frame)
            size += int(frame["data"].str.len().sum())
            if size < block:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["gram"].iloc[-1]
            done = whole["gram"] != last  # the last bucket may go on in the next batch
            if done.any():
                yield sort_block(whole[done], length)
            held = [whole[~done]]
            size = int(held[0]["data"].str.len().sum())
        if size:
            yield sort_block(pd.concat(held, ignore_index=True), length)

    usual = fragments.where(~F.col("hot")).drop("hot") if has_hot else fragments.drop("hot")
    spans = usual.repartition("gram").sortWithinPartitions("gram").mapInPandas(sort, SPANS)
    if has_hot:

        def windows(frames):
            import pandas as pd

            for frame in frames:
                for gram_, row, first, anchor, data in frame[["gram", "row", "first", "anchor", "data"]].itertuples(index=False, name=None):
                    n = len(data) - length + 1
                    at = np.arange(n)
                    x = np.frombuffer(data, np.uint8)
                    h = span_hash(prefix_sums(x), at, at + length)
                    h2 = span_hash(prefix_sums(x[::-1]), len(data) - length - at, len(data) - at)
                    yield pd.DataFrame({"gram": gram_, "offset": anchor - at, "h": h.astype(np.int64), "h2": mix(h2, 9).astype(np.int64), "row": row, "start": first + at})

        seen = materialise(fragments.where("hot").mapInPandas(windows, "gram long, offset long, h long, h2 long, row long, start long"), "suffix-hot")
        key = ["gram", "offset", "h", "h2"]
        again = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(seen.join(again, key, "left_semi").select("row", "start", (F.col("start") + length).alias("stop")))
    return spans


def merged(spans: DataFrame) -> DataFrame:
    """row -> its spans, sorted and disjoint (adjacent ones joined); a document's own spans only."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "stop")))
    joined = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x))),
    )
    return spans.groupBy("row").agg(joined.alias("spans"))


def marked(docs: DataFrame, length: int = LENGTH, **options) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one of spans (null where nothing is to be removed), and that column's name.

    Rows are told apart by a hash of id and text: ids may repeat or be null, and equal rows lose the same bytes.
    """
    row, name = private(docs, "row"), private(docs, "spans")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    spans = materialise(merged(repeats(keyed.select(F.col(row).alias("row"), "text"), length, **options)), "suffix-spans")
    tidy(docs.sparkSession)
    return keyed.join(spans.select(F.col("row").alias(row), F.col("spans").alias(name)), row, "left").drop(row), name


def kept_bytes(data: bytes, spans) -> bytes:
    if spans is None or not len(spans):
        return data
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["stop"]
    out.append(data[at:])
    return b"".join(out)


def removed(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def each(texts, spans):
        rows = []
        for text, found in zip(texts, spans, strict=True):
            data = utf8(text)
            rest = kept_bytes(data, found)
            rows.append((len(data), len(data) - len(rest), 0 if found is None else len(found), hashlib.sha256(rest).hexdigest()))
        return list(zip(*rows, strict=True))

    found, spans = marked(docs.select("doc_id", "text"), length, **options)
    return map_texts(found, ["doc_id"], lambda: each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", also=(spans,))


def deduplicated(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """All columns of ``docs``, repeats taken out of ``text``; a character cut by a repeat's edge goes with it."""

    def each(texts, spans):
        return [[kept_bytes(utf8(t), s).decode("utf-8", "ignore") if s is not None else t for t, s in zip(texts, spans, strict=True)]]

    found, spans = marked(docs, length, **options)
    return map_texts(found, [c for c in docs.columns if c != "text"], lambda: each, "text string", also=(spans,)).select(docs.columns)


def query(spark, sf_dir):
    """op3: what is left of every document without its repeated 200-byte strings."""
    return removed(table(spark, sf_dir, "documents"))
