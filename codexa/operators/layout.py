"""Geometry of layout tokens and boxes: unions, lines, main text areas, repeated heads, nearest graphics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h")
    )


def line_boxes(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], drop: float = 4, gap: float = 15) -> DataFrame:
    """Boxes of runs of tokens on one line: the next token joins if it is less than ``drop`` higher or lower and 0 to ``gap`` ahead."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    joins = (F.abs(F.col("y") - F.lag("y").over(w)) < drop) & (ahead >= 0) & (ahead < gap)
    marked = tokens.withColumn("_new", F.coalesce(~joins, F.lit(True)).cast("int")).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    return united(marked, [*keys, "line"])


def intersects(a: str, b: str) -> Column:
    """Whether the boxes with column prefixes ``a`` and ``b`` overlap."""
    c = F.col
    return (c(f"{a}x") < c(f"{b}x") + c(f"{b}w")) & (c(f"{b}x") < c(f"{a}x") + c(f"{a}w")) & (c(f"{a}y") < c(f"{b}y") + c(f"{b}h")) & (c(f"{b}y") < c(f"{a}y") + c(f"{a}h"))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 504) -> DataFrame:
    """Every left row with every right row of the same key (a page).

    Right rows travel as lists of at most ``size``, neighbours by ``order``, and each list meets all left rows in turn. So the
    pairs come in short runs that repeat, which take a tenth of the disk of long ones in a Parquet file. Lists are made before
    rows are dealt by key, so a page needn't meet in one task.
    """
    kept = [c for c in right.columns if c not in keys]
    kind = lambda c: right.schema[c].dataType.simpleString()
    shape = ", ".join([*(f"`{k}` {kind(k)}" for k in keys), *(f"`_{c}` array<{kind(c)}>" for c in kept)])

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 500_000:
                yield from lists(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from lists(pa.Table.from_batches(held))

    def lists(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.sort_by([(c, "ascending") for c in [*keys, *order]]).combine_chunks()
        new = np.r_[True, np.zeros(len(rows) - 1, bool)]
        for k in keys:
            new[1:] |= pc.fill_null(pc.not_equal(rows[k][1:], rows[k][:-1]), True).to_numpy()
        first = np.flatnonzero(new)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        at = np.flatnonzero(place % size == 0)
        ends = pa.array(np.r_[at, len(rows)], pa.int32())
        out = pa.table([*(rows[k].take(at) for k in keys), *(pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in kept)], [*keys, *(f"_{c}" for c in kept)])
        yield from out.to_batches(max_chunksize=1000)

    met = right.select(*keys, *kept).mapInArrow(run, shape).join(left, list(keys))
    each = met.select(*left.columns, *(f"_{c}" for c in kept), F.posexplode(f"_{kept[0]}").alias("_place", "_first"))
    return each.select(*left.columns, *(F.get(f"_{c}", F.col("_place")).alias(c) for c in kept))


def main_areas(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, w, h) -> the text area of each document's odd and even pages, by blocks large enough to count."""
    fit = blocks.where("x <> 0 and h >= 20 and w >= 20 and w * h >= 3000")
    cut = lambda c: F.floor(c)
    sides = fit.groupBy("doc_id", (F.col("page") % 2).alias("parity")).agg(F.min(cut(F.col("x"))).alias("x1"), F.max(cut(F.col("x") + F.col("w"))).alias("x2"))
    height = fit.groupBy("doc_id").agg(F.min(cut(F.col("y"))).alias("y1"), F.max(cut(F.col("y") + F.col("h"))).alias("y2"))
    return sides.join(height, "doc_id")


def repeated_heads(lines: DataFrame, keys: Sequence[str], pattern: str, shortest: int = 8) -> DataFrame:
    """Lines whose letters-only pattern comes more than once in a document, and which of them is the first."""
    w = Window.partitionBy(*keys, pattern)
    known = F.length(pattern) > shortest
    count = F.when(known, F.count(F.lit(1)).over(w)).otherwise(F.lit(0))
    return lines.withColumn("repetitive", count > 1).withColumn("first_repetitive", (count > 1) & (F.row_number().over(w.orderBy("line_no")) == 1))


def block_spacing(blocks: DataFrame) -> DataFrame:
    """The distance of each block from the bottom of the one before on its page; null for a page's first."""
    w = Window.partitionBy("doc_id", "page").orderBy("block")
    return blocks.withColumn("spacing", F.col("y") - F.lag(F.col("y") + F.col("h")).over(w))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, most: float) -> DataFrame:
    """keys, left_id, right_id, distance: for each left id the nearest right row of the same key (a page) by abs(ax - bx) + abs(ay - by).

    ``most`` is the largest distance that counts; ties by the right row's id, null last. Rows of one place are one, and no
    pairs are made: from each of the four sides, places are merged in halves along x with a running best along y. Sums of
    coordinates choose the nearest, so those must be exact in a double (whole numbers are).
    """
    at = lambda p: [F.col(f"{p}x").cast("double").alias("x"), F.col(f"{p}y").cast("double").alias("y")]
    known = lambda rows: rows.dropna(subset=[*keys, "x", "y"])
    asks = known(left.select(*keys, *at("a"), F.col(left_id)))
    gives = known(right.select(*keys, *at("b"), F.col(right_id))).groupBy(*keys, "x", "y").agg(F.min(right_id).alias("id"))
    kind = lambda n: F.lit(n).cast("int").alias("kind")
    places = gives.select(*keys, "x", "y", "id", kind(0)).unionByName(asks.select(*keys, "x", "y", F.lit(None).cast("long").alias("id"), kind(1)).distinct())

    def run(frames):
        import pandas as pd

        held = None  # rows so far; the last page of a batch may go on in the next
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            group = held["page_no"].to_numpy()
            whole = int(np.searchsorted(group, group[-1]))
            if whole >= 50_000:
                yield from answered(held.iloc[:whole])
                held = held.iloc[whole:]
        if held is not None:
            yield from answered(held)

    def answered(frame):
        x, y, group, kind = (frame[c].to_numpy() for c in ("x", "y", "page_no", "kind"))
        best = nearest_places(group, x, y, kind == 0, frame["id_no"].to_numpy())
        asked = np.flatnonzero(kind == 1)
        asked = asked[best[asked] >= 0]
        to = best[asked]
        out = frame.iloc[asked][[*keys, "x", "y"]].reset_index(drop=True)
        out["to"] = frame["id_no"].to_numpy()[to]
        out["found"] = frame["has_id"].to_numpy()[to]
        out["distance"] = np.abs(x[asked] - x[to]) + np.abs(y[asked] - y[to])
        yield out[out["distance"] <= most]

    page = F.xxhash64(*keys)
    dealt = places.withColumn("page_no", page).withColumn("id_no", F.coalesce("id", F.lit((1 << 63) - 1))).withColumn("has_id", F.col("id").isNotNull()).drop("id")
    dealt = dealt.repartition("page_no").sortWithinPartitions("page_no")
    types = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    found = dealt.mapInPandas(run, f"{types}, x double, y double, to long, found boolean, distance double")
    back = asks.join(found, [*keys, "x", "y"])
    least = F.min(F.struct("distance", "to", (~F.col("found")).alias("none"))).alias("m")
    return back.groupBy(*keys, left_id).agg(least).select(*keys, left_id, F.when(~F.col("m.none"), F.col("m.to")).alias(right_id), F.col("m.distance").alias("distance"))


def nearest_places(group: np.ndarray, x: np.ndarray, y: np.ndarray, gives: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the giving row of its group that is nearest by abs(dx) + abs(dy), ties by id; -1 where there is none."""
    n = len(x)
    group = np.unique(group, return_inverse=True)[1]
    best, far = np.full(n, -1), np.full(n, np.inf)
    for sx, sy in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
        u, v = x * sx, y * sy
        score = np.lexsort((ids, -(u + v)))  # of the rows that are lower in both, the first of these is the nearest
        rank = np.full(n, n, np.int64)
        rank[score] = np.where(gives[score], np.arange(n), n)
        place = np.empty(n, np.int64)
        place[np.lexsort((~gives, v, u, group))] = np.arange(n)
        by_v = np.lexsort((~gives, v, group))
        won = np.full(n, n, np.int64)
        for level in range(1, max(n - 1, 1).bit_length() + 1):
            order = by_v[np.argsort(place[by_v] >> level, kind="stable")]
            block, upper = place[order] >> level, (place[order] >> (level - 1)) & 1
            new = np.r_[True, (block[1:] != block[:-1]) | (group[order][1:] != group[order][:-1])]
            shift = (np.cumsum(new) - 1) * (n + 1)  # each run starts anew
            low = np.minimum.accumulate(np.where(upper == 0, rank[order], n) - shift) + shift
            won[order] = np.minimum(won[order], np.where(upper == 1, np.minimum(low, n), n))
        to = np.where(won < n, score[np.minimum(won, n - 1)], -1)
        d = np.where(to >= 0, np.abs(x - x[to]) + np.abs(y - y[to]), np.inf)
        better = (to >= 0) & ((d < far) | ((d == far) & (ids[to] < ids[best])))
        best, far = np.where(better, to, best), np.where(better, d, far)
    return best
