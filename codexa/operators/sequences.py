"""Ordered-sequence operators: islands of labels, intervals, alignment, range expansion. Windows are partitioned by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, begin: Column | None = None, name: str = "island") -> DataFrame:
    """Number runs of equal labels (from 1); a begin flag starts a run as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True))
    if begin is not None:
        starts = starts | begin
    flagged = rows.withColumn("_starts", starts.cast("int"))
    return flagged.withColumn(name, F.sum("_starts").over(w)).drop("_starts")


def clusters(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """One row for each run: its label, first and last place and length."""
    runs = islands(rows, keys, order, label)
    return runs.groupBy(*keys, "island", label).agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count(F.lit(1)).alias("n"))


def coalesced(intervals: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one.

    Intervals without a stop come after those of their start, and join them; each one without a start stands alone. Equal
    intervals tie in the order; both windows see them in the one order of a single sort, so the result is the same whichever it is.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(stop))
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("parts")).drop("_run")


def flag_inside(tokens: DataFrame, spans: DataFrame, keys: Sequence[str], place: str, start: str, stop: str, name: str) -> DataFrame:
    """Mark tokens whose place lies in a span of the same key: spans become places, so the join is an equi-join."""
    places = spans.select(*keys, F.explode(F.sequence(F.col(start), F.col(stop))).alias(place)).distinct()
    return tokens.join(places.withColumn(name, F.lit(True)), [*keys, place], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def aligned(labels: DataFrame, tokens: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Give labelled rows (no white space) to raw tokens (with white space) by their ordinal; ``agrees`` checks the texts."""
    w = Window.partitionBy(*keys).orderBy(order)
    solid = tokens.where(F.trim(text) != "").withColumn("_ordinal", F.row_number().over(w))
    marked = labels.withColumn("_ordinal", F.row_number().over(w)).withColumnRenamed(text, "_text").drop(order)
    return solid.join(marked, [*keys, "_ordinal"], "left").withColumn("agrees", F.coalesce(F.col(text) == F.col("_text"), F.lit(False))).drop("_ordinal", "_text")


def expanded_range(marker: Column, widest: int = 20) -> Column:
    """The labels that '[3-5]', '(2-3)' or '[1, 4]' stand for, each in its own brackets; too wide a range stands for none."""
    opens, closes = F.regexp_extract(marker, r"^\s*([\[(])", 1), F.regexp_extract(marker, r"([\])])\s*$", 1)
    body = F.regexp_replace(marker, r"[\[\]()\s]", "")

    def labels(part: Column) -> Column:
        a, b = F.regexp_extract(part, r"^(\d+)[-–](\d+)$", 1).try_cast("int"), F.regexp_extract(part, r"^(\d+)[-–](\d+)$", 2).try_cast("int")
        fits = a.isNotNull() & b.isNotNull() & (b >= a) & (b - a < widest)
        numbers = F.transform(F.sequence(F.when(fits, a).otherwise(F.lit(0)), F.when(fits, b).otherwise(F.lit(0))), lambda x: x.cast("string"))
        return F.when(fits, numbers).when(a.isNotNull(), F.array().cast("array<string>")).when(part == "", F.array().cast("array<string>")).otherwise(F.array(part))

    every = F.flatten(F.transform(F.split(body, "[,;]"), labels))
    return F.transform(every, lambda x: F.concat(opens, x, closes))


def majority(rows: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """Of each key the kind with most distinct values; on ties the kind that comes first in order."""
    counted = rows.groupBy(*keys, kind).agg(F.count_distinct(value).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), kind)
    return counted.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
