"""Dictionary and index joins: gazetteers, inverted index with a score, lookups with checks, similarity of short texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gazetteer(tokens: DataFrame, terms: DataFrame, keys: Sequence[str], place: str, token: str, longest: int = 5) -> DataFrame:
    """All places, overlaps included, where a term (term_id, words array) stands in the token sequence.

    Each place's n-grams meet the terms in an equi-join, so long lists of terms cost one shuffle and no scan of theirs.
    """
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(0, longest - 1)
    ahead = tokens.withColumn("_ahead", F.collect_list(F.lower(token)).over(w))
    grams = ahead.select(*keys, F.col(place).alias("first"), F.explode(F.sequence(F.lit(1), F.size("_ahead"))).alias("n"), "_ahead")
    grams = grams.withColumn("gram", F.concat_ws(" ", F.slice("_ahead", F.lit(1), F.col("n")))).drop("_ahead")
    wanted = terms.select("term_id", F.concat_ws(" ", F.transform("words", F.lower)).alias("gram"), F.size("words").alias("n")).where(F.col("n").between(1, longest))
    return grams.join(wanted, ["gram", "n"]).select(*keys, "first", (F.col("first") + F.col("n") - 1).alias("last"), "term_id")


def index_search(docs: DataFrame, queries: DataFrame, must_match: float = 0.5, top: int = 10) -> DataFrame:
    """(doc_id, terms) and (query_id, terms) -> the best documents of each query by sum of tf * ln(1 + N / (1 + df)).

    A document must hold floor(terms * must_match) of the query's terms; terms that a query repeats count again.
    """
    wanted = queries.select(F.explode("terms").alias("term")).distinct()  # no other term counts, for documents or for scores
    posted = docs.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(wanted), "term", "left_semi").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))  # one row
    asked = queries.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy("query_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("qf"))
    hits = asked.join(df, "term").join(posted, "term")
    idf = F.log(1 + F.col("n_docs") / (1 + F.col("df")))
    scored = hits.groupBy("query_id", "doc_id", "n_terms").agg(F.sum("qf").alias("matched"), F.sum(F.col("qf") * F.col("tf") * idf).alias("score"))
    scored = scored.where(F.col("matched") >= F.floor(F.col("n_terms") * must_match))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "doc_id", "matched", F.round("score", 6).alias("score"), "rank")


def unique_match(markers: DataFrame, references: DataFrame, on: Sequence[str], target: str) -> DataFrame:
    """Markers with the one reference that equals them on ``on``; none and more than one give a null target."""
    once = references.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(target).alias("_target"))
    joined = markers.join(once, list(on), "left")
    return joined.withColumn(target, F.when(F.col("_n") == 1, F.col("_target"))).drop("_n", "_target")


def consolidated(records: DataFrame, works: DataFrame, on: str, fields: Sequence[str], accept: Column | None = None) -> DataFrame:
    """Fill and correct ``fields`` from a lookup table by a key; a hit that ``accept`` rejects (columns ``new_*``) changes nothing."""
    looked = works.select(on, *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("_hit"))
    joined = records.join(looked, on, "left")
    good = F.col("_hit").isNotNull() if accept is None else F.col("_hit").isNotNull() & F.coalesce(accept, F.lit(False))
    joined = joined.withColumn("consolidated", good)
    for c in fields:
        joined = joined.withColumn(c, F.when(F.col("consolidated"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)))
    return joined.drop("_hit", *(f"new_{c}" for c in fields))


def jaccard(a: Column, b: Column) -> Column:
    """Shared terms over all terms of two arrays; 0 if both are empty."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(both / every)


def _matched(a: str, b: str) -> int:
    """Characters in the longest common substring and, on both sides of it, in theirs (first longest on ties)."""
    total, work = 0, [(a, b)]
    while work:
        x, y = work.pop()
        if not x or not y:
            continue
        row, best, at, to = np.zeros(len(y) + 1, np.int64), 0, 0, 0
        codes = np.frombuffer(y.encode("utf-32-le"), np.uint32)
        for i, c in enumerate(x):
            row[1:] = np.where(codes == ord(c), row[:-1] + 1, 0)
            j = int(row.argmax())
            if row[j] > best:
                best, at, to = int(row[j]), i + 1, j
        if best:
            total += best
            work += [(x[: at - best], y[: to - best]), (x[at:], y[to:])]
    return total


def ratcliff_obershelp(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters, without regard to case; 0 where a side is null or empty."""

    @F.pandas_udf("double")
    def run(left, right):
        import pandas as pd

        out = []
        for x, y in zip(left, right, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(0.0)
            else:
                x, y = x.lower(), y.lower()
                out.append(1.0 if x == y else 2.0 * _matched(x, y) / (len(x) + len(y)))
        return pd.Series(out, dtype="float64")

    return run(a, b)


def assigned_emails(authors: DataFrame, emails: DataFrame, key: str) -> DataFrame:
    """Greedy assignment of addresses to the nearest author by edit distance, within a key; an author is used once.

    Accepted only below half the local part's length. A key is one document's short author list, so groups are small.
    """

    def nearest(pairs):
        used, rows = set(), []
        for email, part in pairs.sort_values(["distance", "author", "email"]).groupby("email", sort=False):
            for _, row in part.iterrows():
                if row["author"] not in used and row["distance"] < len(email.split("@")[0]) // 2:
                    used.add(row["author"])
                    rows.append(row[[key, "author", "email", "distance"]])
                    break
        import pandas as pd

        return pd.DataFrame(rows, columns=[key, "author", "email", "distance"])

    local = F.substring_index("email", "@", 1)
    name = F.lower(F.regexp_replace("author", r"[^\p{L}]", ""))
    pairs = authors.join(emails, key).withColumn("distance", F.levenshtein(name, F.lower(local)))
    return pairs.select(key, "author", "email", "distance").groupBy(key).applyInPandas(nearest, f"{key} {dict(authors.dtypes)[key]}, author string, email string, distance int")
