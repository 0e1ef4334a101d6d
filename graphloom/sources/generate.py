"""Seeded synthetic graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 31_536_000


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) that depends on seed and parts only, so partitioning does not matter."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / float(1 << 53)


def nodes(spark: SparkSession, n: int, seed: int = 42, dim: int = 384, start: int = 1_700_000_000) -> DataFrame:
    """60 % entities, 25 % events, 15 % facts; 8 to 29 words; unit vectors; times within a year."""
    u = uniform(seed, F.lit("type"), "id")
    words = F.floor(8 + 22 * uniform(seed, F.lit("words"), "id")).cast("int")
    word = F.transform(F.sequence(F.lit(1), words), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(5000)).cast("string")))
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit("v"), F.col("id"), i), F.lit(1 << 20)) / float(1 << 19) - 1)
    rows = spark.range(n).select("id", F.array_join(word, " ").alias("content"), F.when(u < 0.6, "Entity").when(u < 0.85, "Event").otherwise("Fact").alias("node_type"), (F.lit(start) - F.floor(YEAR * uniform(seed, F.lit("time"), "id"))).cast("long").alias("timestamp"), raw.alias("_raw"))
    length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_n", length).select("id", "content", "node_type", "timestamp", F.transform("_raw", lambda x: (x / F.col("_n")).cast("float")).alias("embedding"))


def edges(spark: SparkSession, n_nodes: int, n_edges: int, seed: int = 42, exponent: float = 0.8) -> DataFrame:
    """Uniform sources, Zipf targets by the inverse of its continuous distribution, no self-loops, weights in [0.1, 1)."""
    # Edge types and their share in percent, cumulative.
    mix = [("RelatesTo", 50), ("CausedBy", 65), ("HasProperty", 75), ("NextEpisode", 85), ("Actor", 90), ("Object", 95), ("Location", 98), ("ConflictsWith", 100)]
    s = F.floor(n_nodes * uniform(seed, F.lit("s"), "i")).cast("long")
    p = 1 - exponent
    t = F.floor(F.pow(1 + uniform(seed, F.lit("t"), "i") * (float(n_nodes + 1) ** p - 1), 1 / p)).cast("long") - 1
    t = F.least(t, F.lit(n_nodes - 1))
    kind = F
    for name, upto in mix:
        kind = kind.when(100 * uniform(seed, F.lit("k"), "i") < upto, name)
    rows = spark.range(n_edges).withColumnRenamed("id", "i").select(s.alias("source"), t.alias("_t"), kind.otherwise("RelatesTo").alias("edge_type"), (0.1 + 0.9 * uniform(seed, F.lit("w"), "i")).alias("weight"))
    return rows.select("source", F.when(F.col("_t") == F.col("source"), F.pmod(F.col("_t") + 1, F.lit(n_nodes))).otherwise(F.col("_t")).cast("long").alias("target"), "edge_type", "weight")


def chain(spark: SparkSession, n: int) -> DataFrame:
    """Edges i -> i+1."""
    return spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("NextEpisode").alias("edge_type"), F.lit(1.0).alias("weight"))


def tree(spark: SparkSession, branching: int, n: int) -> DataFrame:
    """Edges from each node's parent (i - 1) / b."""
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / branching).cast("long").alias("source"), F.col("id").alias("target"), F.lit("RelatesTo").alias("edge_type"), F.lit(1.0).alias("weight"))
