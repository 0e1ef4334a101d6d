"""Namespaces, retention, forgetting, audit and cost rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph
from graphloom.schema import NODE_TYPES
from graphloom.storage import dealt

# Roles in order of privilege.
ROLES = ["viewer", "reader", "writer", "admin"]


def namespace(column="namespace") -> Column:
    return F.coalesce(F.col(column), F.lit("default"))


def in_namespace(nodes: DataFrame, name: str) -> DataFrame:
    """F4."""
    return nodes.where(namespace() == name)


def of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    """parsed without case; an unknown type filters nothing."""
    known = {t.lower(): t for t in NODE_TYPES}.get(node_type.lower())
    return nodes if known is None else nodes.where(F.col("node_type") == known)


def selected(nodes: DataFrame, types: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """type in a set, start <= timestamp <= end."""
    if types is not None:
        nodes = nodes.where(F.col("node_type").isin(*types))
    if start is not None:
        nodes = nodes.where(F.col("timestamp") >= start)
    return nodes if end is None else nodes.where(F.col("timestamp") <= end)


def stats(nodes: DataFrame) -> DataFrame:
    """A1/A2: per namespace total, entities, others, last time; ``default`` is always there."""
    entity = F.sum(F.when(F.col("node_type") == "Entity", 1).otherwise(0))
    per = nodes.groupBy(namespace().alias("namespace")).agg(F.count(F.lit(1)).alias("total"), entity.alias("entities"), (F.count(F.lit(1)) - entity).alias("others"), F.max("timestamp").alias("last_activity"))
    default = nodes.sparkSession.createDataFrame([("default", 0, 0, 0, None)], "namespace string, total long, entities long, others long, last_activity long")
    return per.unionByName(default).groupBy("namespace").agg(F.sum("total").alias("total"), F.sum("entities").alias("entities"), F.sum("others").alias("others"), F.max("last_activity").alias("last_activity"))


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """T3 (Q15): newest first, then id."""
    return nodes.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def renumbered(nodes: DataFrame, start: int) -> DataFrame:
    """``(old, new)``: ids from ``start`` in order of id.

    Ranks come from counts of id ranges and a rank inside each, so no single task sees all rows.
    """
    ids = nodes.select("id").distinct()
    n = max(1, -(-ids.count() // 100_000))
    ranged = ids.repartitionByRange(n, "id").withColumn("_part", F.spark_partition_id())
    from graphloom.storage import checkpointed

    ranged = checkpointed(ranged)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("id"))
    return ranged.join(F.broadcast(offsets), "_part").select(F.col("id").alias("old"), (F.col("_offset") + within - 1 + start).cast("long").alias("new"))


def clone(nodes: DataFrame, edges: DataFrame, source: str, destination: str, next_id: int, **filters) -> tuple[DataFrame, DataFrame]:
    """Selected nodes of a namespace under new ids in another one, with the induced edges."""
    picked = selected(in_namespace(nodes, source), **filters)
    ids = renumbered(picked, next_id)
    copies = picked.join(ids, F.col("id") == F.col("old")).withColumn("id", F.col("new")).withColumn("namespace", F.lit(destination)).select(*nodes.columns)
    return copies, graph.remap(edges, ids)


def content_map(nodes: DataFrame, source: str, destination: str) -> DataFrame:
    """``(id, kept)``: where a source node's content lives: the least destination id of its key, else its key's least source id."""
    keyed = dealt(nodes.select("id", namespace().alias("namespace"), tx.key("content").alias("key")), "key")
    there = keyed.where(namespace() == destination).groupBy("key").agg(F.min("id").alias("there"))
    here = keyed.where(namespace() == source)
    firsts = here.groupBy("key").agg(F.min("id").alias("here"))
    return here.join(firsts.hint("merge"), "key").join(there.hint("merge"), "key", "left").select("id", F.coalesce("there", "here").alias("kept"))


def merge(nodes: DataFrame, edges: DataFrame, source: str, destination: str, next_id: int) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges that bring ``source`` into ``destination``; equal contents are not copied."""
    places = content_map(nodes, source, destination)
    new = dealt(nodes, "id").join(places.where("id = kept").select("id"), "id", "left_semi")
    ids = renumbered(new, next_id)
    target = places.join(ids, F.col("kept") == F.col("old"), "left").select(F.col("id").alias("old_id"), F.coalesce("new", "kept").alias("new_id"))
    copies = new.join(ids, F.col("id") == F.col("old")).withColumn("id", F.col("new")).withColumn("namespace", F.lit(destination)).select(*nodes.columns)
    return copies, graph.remap(edges, target.select(F.col("old_id").alias("old"), F.col("new_id").alias("new"))).where("source <> target")


def view(nodes: DataFrame, edges: DataFrame, limit: int, node_type: str | None = None, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of nodes and the edges among them."""
    picked = nodes if name is None else in_namespace(nodes, name)
    picked = page(picked if node_type is None else of_type(picked, node_type), limit)
    return picked, graph.induced(edges, picked)


def graph_items(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """nodes as a graph view shows them: ``id, content, node_type, timestamp, community_id``, the last null without a community."""
    placed = communities.select(F.col("node_id").alias("id"), "community_id")
    return nodes.select("id", "content", "node_type", "timestamp").join(placed, "id", "left")


def search_items(found: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    """search results ``(query_id, id, score, ...)`` as a search shows them, with content and type, of one namespace if given."""
    shown = nodes if name is None else in_namespace(nodes, name)
    return found.join(shown.select("id", "content", "node_type"), "id")


def expired(nodes: DataFrame, now: int, default_ttl: int, policies: DataFrame | None = None) -> DataFrame:
    """nodes older than their namespace's ttl, else the default; ttl 0 keeps; no time stamp keeps."""
    ttl = F.lit(default_ttl)
    if policies is not None:  # one row a namespace
        nodes = nodes.join(policies.select(F.col("namespace").alias("_ns"), F.col("ttl").alias("_ttl")), namespace() == F.col("_ns"), "left")
        ttl = F.coalesce("_ttl", ttl)
    out = nodes.where((F.col("timestamp") > 0) & (ttl > 0) & (F.lit(now) - F.col("timestamp") > ttl))
    return out.drop("_ns", "_ttl")


def swept(nodes: DataFrame, edges: DataFrame, now: int, default_ttl: int, policies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the expired nodes (F13) and their edges."""
    return graph.delete_nodes(nodes, edges, expired(nodes, now, default_ttl, policies))


def forget_report(nodes: DataFrame, edges: DataFrame, subject: Column) -> DataFrame:
    """One row: counts of what a subject's removal takes and the namespaces concerned."""
    gone = nodes.where(subject)
    counts = gone.agg(F.count(F.lit(1)).alias("memories"), F.sum(F.when(F.col("node_type") == "Entity", 1).otherwise(0)).alias("entities"), F.concat_ws(",", F.sort_array(F.collect_set(namespace()))).alias("namespaces"))
    return counts.join(F.broadcast(graph.incident(edges, gone).agg(F.count(F.lit(1)).alias("edges")))).select("memories", F.coalesce("entities", F.lit(0)).alias("entities"), "edges", "namespaces")


def soft_deleted(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """A flag beside all other columns, the namespace kept."""
    marked = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return nodes.join(marked, "id", "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")


def chains(rows: DataFrame, group: str, order: list[str], weight: float, edge_type: str) -> DataFrame:
    """An edge from each row of a group to the next one."""
    following = F.lead("id").over(Window.partitionBy(group).orderBy(*order, "id"))
    return rows.where(F.col(group).isNotNull()).withColumn("target", following).where("target is not null").select(F.col("id").alias("source"), "target", F.lit(edge_type).alias("edge_type"), F.lit(weight).alias("weight"))


def neighbours_in_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Previous and next id within a group."""
    w = Window.partitionBy(group).orderBy(order, "id")
    return rows.select("id", group, F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


def conversations(messages: DataFrame, preview: int = 120) -> DataFrame:
    """A3 (Q24): per conversation count, first and last time, the first message's beginning."""
    first = F.min_by("content", F.struct("timestamp", "id"))
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.substring(first, 1, preview).alias("preview"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "id")).alias("r"))
    return last.select("r.*")


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows."""
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def audit_action(method="method", path="path") -> Column:
    """The action's name of a request."""
    m, p = F.col(method), F.regexp_replace(F.regexp_replace(F.col(path), "^/api/v1/", ""), "/+$", "")
    # Actions of whole paths and of paths below a prefix.
    whole = {("POST", "memories"): "memories.create", ("GET", "memories"): "memories.list", ("POST", "memories/search"): "search", ("GET", "entities"): "entities.list", ("POST", "images"): "images.index", ("GET", "auth/keys"): "auth.keys.list", ("POST", "auth/keys"): "auth.keys.create", ("GET", "audit"): "audit.query"}
    names = {"augment": "POST", "learn": "POST", "export": "GET", "import": "POST", "health": "GET", "metrics": "GET", "transcribe": "POST", "ocr": "POST", "graph": "GET"}
    below = [("GET", "memories/", "memories.get"), ("PUT", "memories/", "memories.update"), ("DELETE", "memories/", "memories.delete"), ("GET", "entities/", "entities.get"), ("DELETE", "auth/keys/", "auth.keys.revoke")]
    dotted = F.replace(p, F.lit("/"), F.lit("."))
    out = F
    for (verb, at), name in whole.items():
        out = out.when((m == verb) & (p == at), name)
    for name, verb in names.items():
        out = out.when((m == verb) & (p == name), name)
    for verb, prefix, name in below:
        out = out.when((m == verb) & p.startswith(prefix), name)
    out = out.when((m == "POST") & p.startswith("admin/"), F.concat(dotted, F.lit(".create"))).when((m == "DELETE") & p.startswith("admin/"), F.concat(dotted, F.lit(".delete")))
    out = out.when(((m == "GET") & p.startswith("admin/")) | ((m == "POST") & p.startswith("import/")) | p.startswith("gdpr/") | ((m == "GET") & (p == "auth/whoami")) | ((m == "POST") & (p == "images/search")) | ((m == "GET") & (p == "audit/export")), dotted)
    return out.otherwise(F.concat(F.lower(m), F.lit("."), dotted))


def audit_rows(rows: DataFrame, start: int | None = None, end: int | None = None, action: str | None = None, user: str | None = None, method: str | None = None, status: int | None = None) -> DataFrame:
    """all given limits hold; ``action`` is a part of the name, ``method`` in any case."""
    for given, rule in ((start, F.col("timestamp") >= start), (end, F.col("timestamp") <= end), (action, F.col("action").contains(action or "")), (user, F.col("user") == user), (method, F.col("method") == (method or "").upper()), (status, F.col("status") == status)):
        if given is not None:
            rows = rows.where(rule)
    return rows


def cost_totals(rows: DataFrame, period: str = "month") -> DataFrame:
    """Calls, tokens and cost per period, provider, and over all providers (null), in one pass."""
    grouped = rows.withColumn("period", F.date_trunc(period, "timestamp"))
    return grouped.rollup("period", "provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")).where("period is not null")


def may(role, needed: str) -> Column:
    """whether a role has at least the privilege of another."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role) if isinstance(role, str) else role)
    return rank >= ROLES.index(needed) + 1


def explained(rows: DataFrame, group: str, content: str = "content") -> DataFrame:
    """approximate tokens and their share of the group's total (at least 1)."""
    t = tx.approximate_tokens(content)
    total = rows.groupBy(group).agg(F.sum(t).alias("_total"))
    return rows.withColumn("tokens", t).join(total, group).withColumn("share", F.col("tokens") / F.greatest("_total", F.lit(1))).drop("_total")


def provider_choice(stats_: DataFrame, strategy: str) -> DataFrame:
    """One provider ``(provider, price, p50, success, mean)`` by strategy, names break ties."""
    order = {"cheapest": F.col("price"), "fastest": F.col("p50"), "quality": -(F.col("success") * 1000 / F.greatest("mean", F.lit(1e-9)))}[strategy]
    return stats_.orderBy(order, "provider").limit(1)


def media_violations(row: dict[str, str] | None = None) -> Column:
    """Names of the fields that a node's media type needs and lacks."""
    need = {"text": ["content", "embedding"], "audio": ["content", "embedding", "media_uri"], "image": ["embedding_visual", "media_uri"], "video_segment": ["embedding_visual", "media_uri", "parent_video_id"]}
    checks = [F.when((F.coalesce("media_type", F.lit("text")) == kind) & F.col(c).isNull(), F.lit(c)) for kind, columns in need.items() for c in columns]
    checks.append(F.when(F.col("start_ms") >= F.col("end_ms"), F.lit("time_range")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def of_media(rows: DataFrame, kind: str) -> DataFrame:
    """media filter; ``video`` means video_segment."""
    wanted = "video_segment" if kind == "video" else kind
    return rows.where(F.coalesce("media_type", F.lit("text")) == wanted)


def content_items(items: DataFrame, include: list[str] = (), exclude: list[str] = (), after: int | None = None, before: int | None = None, authors: list[str] = (), limit: int | None = None) -> DataFrame:
    """F8: any included and no excluded part (any case), time inclusive, author in a list; newest first if limited."""
    low = F.lower("content")
    if include:
        items = items.where(F.greatest(F.lit(False), *[low.contains(x.lower()) for x in include]))
    for x in exclude:
        items = items.where(~low.contains(x.lower()))
    if after is not None:
        items = items.where(F.col("created_at") >= after)
    if before is not None:
        items = items.where(F.col("created_at") <= before)
    if authors:
        items = items.where(F.col("author").isin(*authors))
    return items if limit is None else items.orderBy(F.desc("created_at"), "source_id").limit(limit)


def messages_with_entities(messages: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A4: ``messages`` with ``entities``: sorted distinct names of the entity nodes that a message is linked with, either way.

    The links are narrowed to messages and entities before names are gathered, so a list holds one message's names.
    """
    ids = messages.select(F.col("id").alias("_m"))
    forth = edges.select(F.col("source").alias("_m"), F.col("target").alias("_e")).join(ids, "_m", "left_semi")
    back = dealt(edges.select(F.col("target").alias("_m"), F.col("source").alias("_e")), "_m").join(ids, "_m", "left_semi")
    ends = forth.unionByName(back)  # a name is gathered once however many links there are, so they are not made distinct
    entity = nodes.where("node_type = 'Entity'").select(F.col("id").alias("_e"), F.col("content").alias("_name"))
    names = ends.join(entity, "_e").groupBy("_m").agg(F.sort_array(F.collect_set("_name")).alias("entities"))
    out = messages.join(names, F.col("id") == F.col("_m"), "left").drop("_m")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def cost_page(costs: DataFrame, provider: str | None = None, model: str | None = None, start: int | None = None, end: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """a page of cost rows, newest first, with the number and sum of all rows that pass the filters (ends inclusive)."""
    kept = costs
    for given, condition in ((provider, F.col("provider") == provider), (model, F.col("model") == model), (start, F.col("timestamp") >= start), (end, F.col("timestamp") <= end)):
        if given is not None:
            kept = kept.where(condition)
    totals = kept.agg(F.count(F.lit(1)).alias("total_rows"), F.sum("cost").alias("total_cost"))  # one row
    return kept.orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(limit).crossJoin(F.broadcast(totals))
