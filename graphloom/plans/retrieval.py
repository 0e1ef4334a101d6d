"""Retrieval, ingestion and consolidation as whole jobs (section 3 of the survey)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import communities, graph, mindset, relations, reward, scoring, vectors
from graphloom.storage import checkpointed


@dataclass(frozen=True)
class Retrieval:
    """Parameters of a retrieval; defaults are the documented ones."""

    seeds: int = 50
    min_similarity: float = 0.0
    hops: int = 1
    decay: float = 0.5
    top_k: int = 10
    now: int = 0
    half_life: int = scoring.HALF_LIFE
    mindset: str | None = None
    path_hops: int = 3
    members: int = 20
    member_similarity: float = 0.1
    namespace: str | None = None
    path_rewards: bool = True


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, plan: Retrieval = Retrieval(), entity_seeds: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Ranked memories for every query ``(query_id, embedding)``: ``query_id, id, score, rank`` and the parts of the score.

    Vector seeds, one-pass expansion of all queries' seeds, similarity as the best seed's times
    the decay (Q3, Q4), namespace after expansion, members of the seeds' communities, centrality,
    recency, mindset and the best path to a seed of the same query, then the top rows.

    ``entity_seeds`` ``(query_id, id)`` are nodes that a recogniser found in the query (U1): they
    join the vector seeds, with a similarity of 0.5 where no vector search found them.  ``placed``
    ``(node_id, community_id)``: of the seeds' communities the ``members`` least ids that are not
    found yet compete too, at ``member_similarity`` (J18).  A column ``confidence`` of ``nodes``
    serves the mindset (C18); without it, or where it is null, it is 0.5.
    """
    seeds = vectors.topk_many(queries, embeddings, plan.seeds, min_similarity=plan.min_similarity if plan.min_similarity > 0 else None).select("query_id", "id", "score")
    if entity_seeds is not None:
        extra = entity_seeds.select("query_id", "id").distinct().join(seeds, ["query_id", "id"], "left_anti")
        seeds = seeds.unionByName(extra.withColumn("score", F.lit(0.5)))
    seeds = checkpointed(seeds)
    reached = graph.neighbours(edges, seeds.select("id").distinct(), plan.hops)
    near = seeds.join(reached, F.col("id") == F.col("seed")).select("query_id", F.col("node").alias("id"), (F.col("score") * plan.decay).alias("score"))
    found = seeds.withColumn("seed_", F.lit(1)).unionByName(near.withColumn("seed_", F.lit(0))).groupBy("query_id", "id").agg(F.max("seed_").alias("is_seed"), F.max_by("score", F.struct("seed_", "score")).alias("similarity"))
    inside = nodes if plan.namespace is None else nodes.where(F.coalesce("namespace", F.lit("default")) == plan.namespace)
    found = checkpointed(found.join(inside.select("id"), "id", "left_semi"))
    if placed is not None:
        found = found.unionByName(_community_members(seeds, found, placed, plan).join(inside.select("id"), "id", "left_semi"))
    found = found.join(inside, "id")
    degree = graph.both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.countDistinct("neighbour").alias("degree"))
    found = found.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(1)))
    most = found.groupBy("query_id").agg(F.max("degree").alias("most"))
    found = found.join(most, "query_id").withColumn("centrality", F.col("degree") / F.col("most"))
    found = found.withColumn("recency", scoring.recency("timestamp", plan.now, plan.half_life))
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)) if "confidence" in nodes.columns else F.lit(0.5)
    mind = mindset.score(plan.mindset, sure, F.col("recency"), 1 - F.col("similarity"), F.col("centrality")) if plan.mindset else F.lit(0.0)
    if plan.path_rewards:
        starts = seeds.select("id").distinct()
        # a seed has its reward already: paths only lead to the other candidates of the start's queries
        goals = seeds.select("query_id", F.col("id").alias("start")).join(found.where("is_seed = 0").select("query_id", "id"), "query_id").select("start", "id")
        paths = graph.paths_from(edges, starts, plan.path_hops, goals)
        best = reward.score_paths(paths, edges).groupBy("start", "goal").agg(F.max("reward").alias("reward"))
        per = seeds.select("query_id", F.col("id").alias("start")).join(best, "start").groupBy("query_id", F.col("goal").alias("id")).agg(F.max("reward").alias("_reward"))
        found = found.join(per, ["query_id", "id"], "left").withColumn("path_reward", F.when(F.col("is_seed") == 1, 1.0).otherwise(F.coalesce("_reward", F.lit(0.0))))
    else:
        found = found.withColumn("path_reward", F.col("is_seed").cast("double"))
    base = scoring.base_score("similarity", "centrality", "recency")
    scored = found.withColumn("score", scoring.final_score(base, mind, "path_reward"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= plan.top_k).select("query_id", "id", "content", "similarity", "centrality", "recency", "path_reward", "score", "rank")


def _community_members(seeds: DataFrame, found: DataFrame, placed: DataFrame, plan: Retrieval) -> DataFrame:
    """Rows like ``found`` for the ``plan.members`` least ids of the seeds' communities that a query has not found."""
    own = seeds.select("query_id", F.col("id").alias("node_id")).join(placed, "node_id").select("query_id", "community_id").distinct()
    # of a community's least ids a query has found at most as many as it has found at all
    most = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    least = F.row_number().over(Window.partitionBy("community_id").orderBy("node_id"))
    first = placed.withColumn("_least", least).where(F.col("_least") <= plan.members + most).drop("_least")
    extra = own.join(first, "community_id").select("query_id", F.col("node_id").alias("id")).join(found, ["query_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    first = extra.withColumn("_rank", rank).where(F.col("_rank") <= plan.members)
    return first.select("query_id", "id", F.lit(0).alias("is_seed"), F.lit(plan.member_similarity).alias("similarity"))


def context(ranked: DataFrame) -> DataFrame:
    """Per query the numbered lines of its ranked memories."""
    line = F.format_string("%d. [%.2f] %s", F.col("rank"), F.col("score"), F.col("content"))
    lines = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return lines.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def ingest(documents: DataFrame, mentions_of, chunk_bytes: int = 512) -> dict[str, DataFrame]:
    """Chunks, mentions, entities and relations of ``(doc_id, text)``.

    ``mentions_of(chunks)`` is the recogniser: ``(chunk_id, text, label, start, end, confidence)``.
    """
    chunks = documents.select("doc_id", F.posexplode(tx.chunks("text", chunk_bytes)).alias("chunk_index", "content")).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))
    mentions = mentions_of(chunks).withColumnRenamed("chunk_id", "text_id")
    found = relations.co_occurrence(mentions, chunks.select(F.col("chunk_id").alias("text_id"), F.col("content").alias("body")))
    entities = relations.distinct_mentions(mentions).withColumn("entity_id", F.xxhash64("key"))
    of = lambda c: F.xxhash64(tx.key(c))
    edges = found.select(of("subject").alias("source"), of("object").alias("target"), relations.edge_type("predicate").alias("edge_type"), F.col("confidence").alias("weight"), "predicate", F.col("text_id").alias("source_chunk"))
    links = mentions.select(F.col("text_id").alias("source"), of("text").alias("target"), F.lit("RelatesTo").alias("edge_type"), F.lit(1.0).alias("weight")).distinct()
    return {"chunks": chunks, "mentions": mentions, "entities": entities, "relations": edges, "mention_edges": links}


def consolidate(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, now: int) -> dict[str, DataFrame]:
    """Communities, merge pairs and decay of the nodes that have an edge; three jobs that do not need each other."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    linked = nodes.join(ends, "id", "left_semi")
    entities = linked.where("node_type = 'Entity'").join(embeddings.select("id", "embedding"), "id")
    return {"communities": communities.label_propagation(edges), "merges": scoring.merge_pairs(entities), "decay": scoring.decayed(linked, now)}
