"""Registered queries of the streaming jobs and of Leiden communities, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import communities, graph, leiden
from graphloom.queries import DAYS, FACTS, LATER, knn_edges, query
from graphloom.sources import tables
from graphloom.sources.cursor import CursorSource
from graphloom.storage import checkpointed, fresh_path
from graphloom.streaming import jobs, merge, stateful



def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files."""
    reader = spark.readStream.schema(tables.load(spark, sf_dir, "events").schema).option("recursiveFileLookup", "true")
    path = f"{sf_dir}/events.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream is of a folder's files


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stateful stream gives until its input is used up."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    stateful.use_rocks(spark)
    try:
        out = fresh_path(spark, name)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, f"{name}-offsets"))
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(out)


@query(f"""WITH {FACTS},
firsts AS (SELECT b.id AS new_id, arg_min(a.id, (a.timestamp, a.id)) AS old_id FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object AND {LATER} GROUP BY b.id),
judged AS (SELECT o.subject, o.predicate, old_id, new_id,
  CASE WHEN abs(n.timestamp - o.timestamp) > {7 * DAYS} THEN 'Temporal' WHEN abs(n.source_confidence - o.source_confidence) > 0.3 THEN 'Confidence' ELSE 'Ambiguous' END AS strategy,
  CASE WHEN abs(n.timestamp - o.timestamp) > {7 * DAYS} THEN n.timestamp > o.timestamp WHEN abs(n.source_confidence - o.source_confidence) > 0.3 THEN n.source_confidence > o.source_confidence ELSE false END AS new_wins
  FROM firsts JOIN facts o ON o.id = old_id JOIN facts n ON n.id = new_id)
SELECT subject, predicate, old_id, new_id, strategy, CASE WHEN new_wins THEN new_id ELSE old_id END AS winner, CASE WHEN new_wins THEN old_id ELSE new_id END AS loser FROM judged""")
def streamed_contradictions(spark, sf_dir):
    """Facts of the event stream, each against the earliest one of another object, from state per key."""
    found = stateful.contradictions(tables.facts_of(streamed(spark, sf_dir)), 7 * DAYS)
    return drained(found, "contradictions").drop("winner_state", "loser_state")


@query(f"""WITH e AS (SELECT event_type AS namespace, floor(epoch(ts))::BIGINT AS timestamp, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS n, max(floor(epoch(ts))::BIGINT) OVER () AS newest FROM events)
SELECT namespace, timestamp, seq, CASE WHEN n > 500 THEN 'capacity' ELSE 'retention' END AS reason FROM e WHERE n > 500 OR timestamp < newest - {DAYS}""")
def audit_ring(spark, sf_dir):
    """What leaves a ring of 500 entries and one day for each kind of event."""
    e = streamed(spark, sf_dir)
    entries = e.select(F.col("event_type").alias("namespace"), F.unix_timestamp("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user"), F.lit(200).alias("status"))
    return drained(stateful.audit_ring(entries, capacity=500, retention=DAYS), "audit").select("namespace", "timestamp", "seq", "reason")


@query("SELECT event_id, event_type FROM events")
def cursor_events(spark, sf_dir):
    """The events through the cursor source, past no cursor: every row once."""
    spark.dataSource.register(CursorSource)
    stream = spark.readStream.format("cursor_rows").options(path=f"{sf_dir}/events.parquet", cursor="ts", kind="timestamp").load()
    return drained(stream.select("event_id", "event_type"), "cursor")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def merged_events(spark, sf_dir):
    """The last event of each user, merged in three batches, the newest first: the sequence decides, not the order of arrival."""
    path, into = fresh_path(spark, "merged"), None
    e = tables.load(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    into = merge.merging(path, ["user_id"], buckets=16)
    for number in range(3):
        into(e.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == 2 - number), number)
    return merge.read_table(spark, path).withColumn("value", F.round("value", 6))


@query()
def leiden_communities(spark, sf_dir):
    """Leiden communities (CPM, resolution 0.25) of the five-nearest-neighbour graph."""
    return leiden.leiden(knn_edges(spark, sf_dir))


@query("SELECT count(*) AS nodes, 0::BIGINT AS unconnected, true AS not_below_label_propagation FROM embeddings WHERE embedding IS NOT NULL")
def leiden_properties(spark, sf_dir):
    """Nodes placed, nodes cut off from the name of their community, and quality (CPM, 0.25) against label propagation."""
    edges = checkpointed(knn_edges(spark, sf_dir))
    placed = leiden.leiden(edges)
    end = lambda name: placed.select(F.col("node_id").alias(name), F.col("community_id").alias(f"c_{name}"))
    inside = edges.join(end("source"), "source").join(end("target"), "target").where("c_source = c_target")
    parts = graph.connected_components(inside).select(F.col("id").alias("node_id"), "component")
    off = placed.join(parts, "node_id", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.coalesce("component", "node_id") != F.col("community_id"), 1)).alias("unconnected"))
    ours, plain = (leiden.quality_of(edges, p).select(F.col("quality").alias(n)) for p, n in ((placed, "ours"), (communities.label_propagation(edges), "plain")))
    return off.crossJoin(ours).crossJoin(plain).select("nodes", "unconnected", (F.col("ours") >= F.col("plain") - 1e-6).alias("not_below_label_propagation"))
