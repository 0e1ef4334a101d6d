"""Training rows from a graph (A23, X24, T6) and counts of an evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schema import RELATION_TYPES


def linked_entities(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """Entities with at least ``least`` outgoing relation edges: ``(id, relations)``."""
    counts = edges.where(F.col("edge_type").isin(*RELATION_TYPES)).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("relations"))
    return nodes.where("node_type = 'Entity'").select("id").join(counts.where(F.col("relations") >= least), "id")


def samples(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """Per linked entity its content and its relations (target content, predicate, weight within 0..1), by target."""
    own = linked_entities(nodes, edges, least).select(F.col("id").alias("source"))
    rows = edges.where(F.col("edge_type").isin(*RELATION_TYPES)).join(own, "source", "left_semi").join(nodes.select(F.col("id").alias("target"), F.col("content").alias("object")), "target")
    weight = F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0))
    lists = rows.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("target", "object", F.col("edge_type").alias("predicate"), weight.alias("confidence")))).alias("relations"))
    return nodes.select("id", "content").join(lists, "id")


def split(rows: DataFrame, key: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """``split`` is train or validation by a seeded hash of the key: any partitioning, no shuffle, the same answer."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("split", F.when(share < ratio, "train").otherwise("validation"))


def dataset_counts(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Queries, documents and distinct categories."""
    q = queries.agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("category").alias("categories"))
    return q.join(F.broadcast(documents.agg(F.count(F.lit(1)).alias("documents"))))
