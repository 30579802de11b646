"""Mix sources to target weights: nested hash-threshold histograms, no sort of the documents.

Each document has a 60-bit hash of its id and text. A source takes whole passes over its documents while its
target allows, then the documents under a hash threshold. Histograms of size by (source, hash bucket) find the
bucket in which the budget ends; only that bucket is refined, level by level, until it holds a single hash. The
document at the boundary is taken if that brings the source nearer to its target.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; documents of equal id and
text share a hash and are taken together; an empty table gives an empty mix; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import materialise, private

LEVELS, BITS = 5, 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of an md5 of id and text: the same in every run and in other engines."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(key, source, source_size) -> plus target: water-filling under the cap of ``epochs`` times a source's size.

    One row per source is all that the unpartitioned windows see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    # Sources fill up in the order of cap / weight; those before the first that isn't full stop at their cap.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    w = w.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everything)  # that of the first one open; later ones counted open sources as full
    return w.withColumn("final", final).select(
        "key", "source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(F.col("cap").cast("double")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, source, text) -> one row per document: doc_id, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    narrow = materialise(
        docs.select(
            "doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), size_of().alias("size"), hash_of().alias("hash")
        ),
        "mix-sizes",
    )
    sizes = narrow.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, epochs)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = materialise(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-goals")
    # state: the boundary bucket so far (prefix), words below it, and what is still to be found
    state = goal.where(F.col("rest") > 0).select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = narrow.join(state, "key").where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        walked = histogram.withColumn("above", F.col("below") + F.sum("words").over(upto)).where(F.col("above") > F.col("rest"))
        state = walked.groupBy("key").agg(F.min_by(F.struct("bucket", "rest", "words", "above"), "bucket").alias("s")).select(
            "key", F.col("s.rest").alias("rest"), F.col("s.bucket").alias("prefix"), (F.col("s.above") - F.col("s.words")).alias("below"), F.col("s.above").alias("above")
        )
        state = materialise(state, f"mix-level{level}")
    # the boundary hash itself goes in when that is nearer; a source whose budget isn't crossed has rest 0
    limit = state.select("key", F.when(F.col("above") - F.col("rest") < F.col("rest") - F.col("below"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"))
    plan = goal.select("key", "source_size", "target", "passes").join(limit, "key", "left")
    extra = F.coalesce(F.col("hash") < F.col("limit"), F.lit(False)).cast("long")
    out = narrow.join(plan, "key").withColumn("copies", F.col("passes") + extra)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, plus how often (copies), size, target and taken words."""
    own = ["size", "source_size", "target", "copies", "taken"]  # columns of these names give way to the mix's
    row, source = private(docs, "mix_row"), private(docs, "mix_source")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    plan = mix(keyed.select(F.col(row).alias("doc_id"), "source", "text"), **options).where("copies > 0")
    # equal rows have equal hashes and so the same plan
    plan = plan.select(F.col("doc_id").alias(row), F.col("source").alias(source), *own).distinct()
    base = keyed.drop(*own)
    same = (base[row] == plan[row]) & base["source"].eqNullSafe(plan[source])
    return base.join(plan, same).drop(base[row], plan[row], plan[source])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget
  FROM s
), f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM w
), t AS (
  SELECT source, source_size, CASE WHEN level * weight < cap THEN weight * (max(CASE WHEN level * weight < cap THEN level END) OVER ()) ELSE cap::DOUBLE END AS target
  FROM f
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), c AS (
  SELECT d.*, source_size, target, passes, target - passes * source_size AS rest,
         (sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), b AS (
  SELECT *, coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS below,
         min(CASE WHEN upto > rest THEN upto END) OVER (PARTITION BY source) AS above
  FROM c
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN rest <= 0 THEN 0
                                  WHEN upto <= below THEN 1
                                  WHEN upto = above AND above - rest < rest - below THEN 1
                                  ELSE 0 END) AS BIGINT) AS taken
FROM b
"""


def query(spark, sf_dir):
    """op6: the whole documents table mixed by the standing weights."""
    from codexa.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
