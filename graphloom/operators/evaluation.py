"""Retrieval quality."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, reciprocal_rank, ndcg, precision, f1`` at k.

    ``retrieved(query_id, rank, doc_id)`` counts ranks from 1; ``relevant(query_id, doc_id, grade)``.
    A query with relevant documents and no hits scores 0.  The ideal order holds relevant documents only,
    and is made of counts of equal grades: no query's documents are sorted.
    """
    top = retrieved.where(F.col("rank") <= k)
    hits = top.join(relevant, ["query_id", "doc_id"])
    found = hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("distinct_hits"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    runs = relevant.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("c"))
    runs = runs.withColumn("upto", F.sum("c").over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    discounts = F.array(*[F.lit(float(x)) for x in [0.0, *accumulate(1 / math.log2(p + 1.0) for p in range(1, k + 1))]])  # of the first places
    of = lambda places: F.get(discounts, F.least(places, F.lit(k)).cast("int"))
    truth = runs.groupBy("query_id").agg(F.sum("c").alias("n"), F.sum(F.col("grade") * (of(F.col("upto")) - of(F.col("upto") - F.col("c")))).alias("idcg"))
    shown = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    j = truth.join(found, "query_id", "left").join(shown, "query_id", "left").na.fill(0, ["distinct_hits", "hits", "shown"])
    recall, precision = F.col("distinct_hits") / F.col("n"), F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0)
    j = j.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    return j.select("query_id", "recall", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"), "precision", f1.alias("f1"))


def summary(scores: DataFrame) -> DataFrame:
    """Means over all queries (category null) and per category, in one pass of grouping sets."""
    names = ["recall", "reciprocal_rank", "ndcg", "precision", "f1"]
    return scores.cube("category").agg(F.grouping("category").alias("overall"), F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names]).where((F.col("overall") == 1) | F.col("category").isNotNull())


def ability(rollup: DataFrame) -> DataFrame:
    """Query-weighted means over groups and the worst 95th percentile."""
    return rollup.groupBy("ability").agg((F.sum(F.col("recall") * F.col("queries")) / F.sum("queries")).alias("recall"), F.max("p95").alias("p95"))


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """Per group the value at place round(p/100 x (n-1)) of the sorted values; 0 for none.

    Equal values are counted once, so a group's order is held as runs of distinct values.
    """
    runs = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(group))
    placed = runs.select(group, value, upto.alias("upto"), n.alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.round(F.lit(p / 100.0) * (F.col("n") - 1)), F.col(value))).alias(f"p{p}")
    return placed.groupBy(group).agg(*[at(p) for p in percents])


def interpolated(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return rows.groupBy(group).agg(*[F.percentile(value, p / 100.0).alias(f"p{p}") for p in percents])


def provider_stats(calls: DataFrame, last: int = 1_000) -> DataFrame:
    """Success share (1.0 for none) and mean latency over the last ``last`` calls of each provider (a limit that is the feature)."""
    place = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("timestamp"), F.desc("id")))
    return calls.withColumn("_n", place).where(F.col("_n") <= last).groupBy("provider").agg(F.coalesce(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), F.lit(1.0)).alias("success"), F.avg("latency").alias("mean_latency"), F.count(F.lit(1)).alias("samples"))


def histogram(rows: DataFrame, series: str, value: str, buckets: int = 13, least: float = 0.001, factor: float = 2.5) -> DataFrame:
    """``(series, le, observations)``: how many values of a series are at most each bound ``least * factor^i``.

    Counted once per bucket before the shuffle and summed over the ``buckets`` bounds afterwards;
    null values and values above the last bound are in no bucket.
    """
    bounds = [least * factor**i for i in range(buckets)]
    per = rows.groupBy(F.col(series).alias("series")).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("observations")) for i, b in enumerate(bounds)])
    return per.select("series", F.explode(pairs).alias("b")).select("series", "b.le", "b.observations")
