"""Connected components as alternating rounds of large-star and small-star, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import delete, materialise

MAX_ROUNDS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions where wanted -> plus m: the lowest of a and its partners.

    The minimum is combined before the shuffle and joined back, so that the partners of a hub never meet in one task.
    """
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return edges.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) of any one ordered type -> (node, component), the component being its smallest node.

    Nulls and loops are ignored; repeated edges count once; without edges the result is empty. The number of rounds
    grows with the logarithm of the number of nodes; each round's edges are a table in the shared folder.
    """
    spark = edges.sparkSession
    a, b = F.greatest("src", "dst"), F.least("src", "dst")
    now = materialise(edges.where(F.col("src") != F.col("dst")).select(a.alias("a"), b.alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if not row["n"] or (row["n"], row["h"]) == seen:
            break
        seen = (row["n"], row["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        starred = _lowest(large)
        small = starred.select("b", "m").unionByName(starred.select(F.col("a").alias("b"), "m")).where(F.col("b") != F.col("m"))
        after = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        delete(spark, now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
