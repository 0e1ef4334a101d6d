"""The supplied tables as a memory graph: nodes, edges, facts, messages, audit and cost rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import dealt

# node id = key x 8 + kind
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(key: str, kind: int):
    return F.col(key).cast("long") * 8 + kind


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, content, node_type, timestamp, namespace``."""

    def part(table, key, kind, content, node_type="Entity", timestamp=None, namespace=None):
        return load(spark, sf_dir, table).select(
            _id(key, kind).alias("id"), content.alias("content"), F.lit(node_type).alias("node_type"), (timestamp if timestamp is not None else F.lit(0)).cast("long").alias("timestamp"), (namespace if namespace is not None else F.lit("default")).alias("namespace")
        )

    return (
        part("region", "r_regionkey", REGION, F.col("r_name"))
        .unionByName(part("nation", "n_nationkey", NATION, F.col("n_name")))
        .unionByName(part("customer", "c_custkey", CUSTOMER, F.col("c_name"), namespace=F.lower("c_mktsegment")))
        .unionByName(part("supplier", "s_suppkey", SUPPLIER, F.col("s_name")))
        .unionByName(part("part", "p_partkey", PART, F.col("p_name")))
        .unionByName(part("orders", "o_orderkey", ORDER, F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "Event", F.unix_timestamp("o_orderdate"), F.lower("o_orderpriority")))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier -> nation -> region: the hub-heavy part of the graph."""

    def edge(table, source, target, kind):
        return load(spark, sf_dir, table).select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))

    return (
        edge("customer", _id("c_custkey", CUSTOMER), _id("c_nationkey", NATION), "Location")
        .unionByName(edge("supplier", _id("s_suppkey", SUPPLIER), _id("s_nationkey", NATION), "Location"))
        .unionByName(edge("nation", _id("n_nationkey", NATION), _id("n_regionkey", REGION), "RelatesTo"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, target, edge_type, weight``, one row per (source, target, edge_type)."""
    orders = load(spark, sf_dir, "orders").select(_id("o_orderkey", ORDER).alias("source"), _id("o_custkey", CUSTOMER).alias("target"), F.lit("Actor").alias("edge_type"), F.lit(1.0).alias("weight"))
    items = load(spark, sf_dir, "lineitem").select(_id("l_orderkey", ORDER).alias("source"), _id("l_partkey", PART).alias("part"), _id("l_suppkey", SUPPLIER).alias("supplier"), "l_quantity")
    items = dealt(items, "source")  # an order has few lines, so nothing is gained by grouping before
    weight = (F.max("l_quantity") / 50.0).alias("weight")
    parts = items.groupBy("source", F.col("part").alias("target")).agg(weight).select("source", "target", F.lit("Object").alias("edge_type"), "weight")
    sellers = items.groupBy("source", F.col("supplier").alias("target")).agg(weight).select("source", "target", F.lit("Companion").alias("edge_type"), "weight")
    return places(spark, sf_dir).unionByName(orders).unionByName(parts).unionByName(sellers)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(load(spark, sf_dir, "events"))


def facts_of(events: DataFrame) -> DataFrame:
    """``id, subject, predicate, object, source_confidence, timestamp, state`` from events."""
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"),
        F.least(F.greatest(F.col("value") / 500.0, F.lit(0.0)), F.lit(1.0)).alias("source_confidence"), F.unix_timestamp("ts").alias("timestamp"), F.lit("Accepted").alias("state"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, conversation_id, position, author, content, timestamp``; a turn is a minute."""
    c = load(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), F.col("role").alias("author"), F.col("text").alias("content"), (F.col("conv_id") * 100_000 + F.col("turn") * 60).alias("timestamp"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows from events: the kind of event is a method and path."""
    kind = F.col("event_type")
    method = F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").when(kind == "error", "DELETE").otherwise("GET")
    path = F.when(kind == "purchase", "/api/v1/memories").when(kind == "view", "/api/v1/entities/7/").when(kind == "click", "/api/v1/admin/namespaces/x").otherwise(F.concat(F.lit("/api/v1/memories/"), F.col("user_id").cast("string")))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("timestamp"), method.alias("method"), path.alias("path"), F.when(kind == "error", 500).otherwise(200).alias("status"), F.col("user_id").cast("string").alias("user"), "value")


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost rows from events: provider by kind, tokens from the value."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), F.floor(F.col("value")).cast("long").alias("output_tokens"), F.col("ts").alias("timestamp"))
