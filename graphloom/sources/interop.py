"""Import and export: JSON-LD graphs, memory exports, temporal-graph exports, evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph, tenancy
from graphloom.storage import checkpointed

PREFIX = "memory:node/"


def export_graph(nodes: DataFrame, edges: DataFrame, namespace: str | None = None, since: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line for nodes and for the edges among them; metadata keys with ``_`` stay behind."""
    picked = nodes if namespace is None else tenancy.in_namespace(nodes, namespace)
    picked = picked if since is None else picked.where(F.col("timestamp") >= since)
    fields = [F.concat(F.lit(PREFIX), F.col("id").cast("string")).alias("@id"), F.col("node_type").alias("@type"), "content", "timestamp"]
    if "metadata" in picked.columns:
        fields.append(F.map_filter("metadata", lambda k, v: ~F.startswith(k, F.lit("_"))).alias("metadata"))
    if "embedding" in picked.columns:
        fields.append("embedding")
    node_lines = picked.select("id", F.to_json(F.struct(*fields)).alias("value"))
    named = [F.concat(F.lit(PREFIX), F.col(e).cast("string")).alias(e) for e in ("source", "target")]
    edge_lines = graph.induced(edges, picked).select(F.to_json(F.struct(*named, F.col("edge_type").alias("@type"), "weight")).alias("value"))
    return node_lines, edge_lines


def import_graph(node_lines: DataFrame, edge_lines: DataFrame, namespace: str, next_id: int) -> tuple[DataFrame, DataFrame]:
    """S12 (Q28): nodes under new ids in a namespace, embedding null where absent; edges with unknown ends are dropped.

    Lines are parsed once, into tables: the joins' own filters would else parse what stands before the lines were picked.
    """
    shape = "struct<`@id`:string,`@type`:string,content:string,timestamp:long,metadata:map<string,string>,embedding:array<float>>"
    parsed = node_lines.select(F.from_json("value", shape).alias("n")).where("n.`@id` is not null").select(F.regexp_extract("n.@id", r"(\d+)$", 1).cast("long").alias("id"), "n.content", F.col("n.@type").alias("node_type"), "n.timestamp", "n.metadata", "n.embedding")
    parsed = checkpointed(parsed)
    ids = tenancy.renumbered(parsed, next_id)
    nodes = parsed.join(ids, F.col("id") == F.col("old")).select(F.col("new").alias("id"), "content", "node_type", "timestamp", F.lit(namespace).alias("namespace"), "metadata", "embedding")
    edge = edge_lines.select(F.from_json("value", "struct<source:string,target:string,`@type`:string,weight:double>").alias("e"))
    end = lambda c: F.regexp_extract(F.col(f"e.{c}"), r"(\d+)$", 1).cast("long").alias(c)
    ends = checkpointed(edge.select(end("source"), end("target"), F.col("e.@type").alias("edge_type"), F.col("e.weight").alias("weight")))
    return nodes, graph.remap(ends, ids)


MEMORY = "struct<id:string,memory:string,user_id:string,agent_id:string,run_id:string,created_at:string,updated_at:string,metadata:map<string,string>>"


def parse_memories(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row per memory of an export: object with ``results``, with ``memories``, a bare array or one object, the first that parses."""
    v = F.col(column)
    single = F.from_json(v, MEMORY)
    found = F.coalesce(
        F.from_json(v, f"struct<results:array<{MEMORY}>>")["results"], F.from_json(v, f"struct<memories:array<{MEMORY}>>")["memories"],
        F.when(F.ltrim(v).startswith("["), F.from_json(v, f"array<{MEMORY}>")), F.when(single["memory"].isNotNull(), F.array(single)),
    )
    return raw.select(F.posexplode(found).alias("position", "m")).select("position", "m.*").where("memory is not null")


def memories_to_graph(memories: DataFrame, now: int, next_id: int) -> tuple[DataFrame, DataFrame]:
    """A node per memory; chains per user and per agent in order of time (RelatesTo, weight 0.5)."""
    keyed = memories.withColumn("id", F.xxhash64("id", "memory", "position"))
    ids = tenancy.renumbered(keyed, next_id)
    stamp = F.when(F.col("created_at").isNull(), F.lit(now)).otherwise(tx.iso_seconds("created_at"))
    nodes = keyed.join(ids, F.col("id") == F.col("old")).select(F.col("new").alias("id"), F.col("memory").alias("content"), F.lit("Entity").alias("node_type"), stamp.alias("timestamp"), "user_id", "agent_id", "position")
    edges = tenancy.chains(nodes, "user_id", ["timestamp", "position"], 0.5, "RelatesTo").unionByName(tenancy.chains(nodes, "agent_id", ["timestamp", "position"], 0.5, "RelatesTo"))
    return nodes, edges.distinct()


def temporal_edges(edges: DataFrame, entities: DataFrame, preserve_expired: bool = True) -> DataFrame:
    """Typed edges by uuid: expired ones Supersedes 0.3, else RelatesTo 0.7; unknown ends are skipped."""
    expired = F.col("expired_at").isNotNull() | F.col("invalid_at").isNotNull()
    kept = edges if preserve_expired else edges.where(~expired)
    s, t = (entities.select(F.col("uuid").alias(f"{e}_uuid"), F.col("id").alias(e)) for e in ("source", "target"))
    placed = kept.join(s, F.col("source_node_uuid") == F.col("source_uuid")).join(t, F.col("target_node_uuid") == F.col("target_uuid"))
    return placed.select("source", "target", F.when(expired, "Supersedes").otherwise("RelatesTo").alias("edge_type"), F.when(expired, 0.3).otherwise(0.7).alias("weight"))


def episode_edges(episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """An edge of weight 0.5 from an episode ``(id, entity_uuids)`` to each entity it mentions."""
    return episodes.select(F.col("id").alias("source"), F.explode("entity_uuids").alias("uuid")).join(entities.select("uuid", F.col("id").alias("target")), "uuid").select("source", "target", F.lit("RelatesTo").alias("edge_type"), F.lit(0.5).alias("weight")).distinct()


def session_edges(messages: DataFrame) -> DataFrame:
    """NextEpisode edges of weight 0.8 along a session's messages."""
    return tenancy.chains(messages, "conversation_id", ["position"], 0.8, "NextEpisode")


SESSIONS = "array<struct<session_id:string,turns:array<struct<speaker:string,dia_id:string,text:string>>>>"


def turn_documents(samples: DataFrame) -> DataFrame:
    """``(doc_id, content)`` per turn of ``sessions``; the first of a repeated id holds."""
    turns = samples.select(F.posexplode("sessions").alias("s", "session")).select("s", F.posexplode("session.turns").alias("t", "turn"))
    return turns.groupBy(F.col("turn.dia_id").alias("doc_id")).agg(F.min_by(F.concat_ws(": ", "turn.speaker", "turn.text"), F.struct("s", "t")).alias("content"))


def session_documents(samples: DataFrame) -> DataFrame:
    """``(doc_id, content)`` per session, turns in order."""
    sessions = samples.select(F.explode("sessions").alias("x"))
    lines = F.array_join(F.transform("x.turns", lambda t: F.concat_ws(": ", t["speaker"], t["text"])), "\n")
    return sessions.select(F.col("x.session_id").alias("doc_id"), lines.alias("content")).dropDuplicates(["doc_id"])


def answer_turns(questions: DataFrame) -> DataFrame:
    """``(query_id, doc_id)``: turns marked ``has_answer`` of an answer session, else all its turns."""
    sessions = questions.select("question_id", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("h"))
    own = sessions.where(F.array_contains("answer_session_ids", F.col("h.haystack_session_ids")))
    marked = F.exists("h.haystack_sessions", lambda t: F.coalesce(t["has_answer"], F.lit(False)))
    turns = own.withColumn("_marked", marked).select("question_id", "_marked", F.col("h.haystack_session_ids").alias("session"), F.posexplode("h.haystack_sessions").alias("n", "turn"))
    kept = turns.where(~F.col("_marked") | F.coalesce("turn.has_answer", F.lit(False)))
    return kept.select(F.col("question_id").alias("query_id"), F.concat_ws(":", "session", "n").alias("doc_id"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """S19/S20."""
    return spark.read.schema(schema).json(path)


_MESSAGE = "struct<uuid:string,role:string,role_type:string,content:string,created_at:string>"
_SESSION = f"struct<session_id:string,id:string,user_id:string,created_at:string,messages:array<{_MESSAGE}>>"
_ENTITY = "struct<uuid:string,name:string,summary:string,created_at:string>"
_EPISODE = "struct<uuid:string,name:string,content:string,created_at:string>"
_EDGE = "struct<uuid:string,source_node_uuid:string,target_node_uuid:string,name:string,fact:string,created_at:string,valid_at:string,invalid_at:string,expired_at:string>"
_FACT = "struct<uuid:string,fact:string,rating:double,created_at:string>"
ENVELOPE = f"struct<entities:array<{_ENTITY}>,episodes:array<{_EPISODE}>,edges:array<{_EDGE}>,sessions:array<{_SESSION}>,facts:array<{_FACT}>>"


def parse_sessions(raw: DataFrame, column: str = "value") -> DataFrame:
    """A temporal-graph export as ``form, entities, episodes, edges, sessions, facts``, one row per row of ``raw``.

    The first form that fits: an envelope with any of its lists, a bare array of sessions, one
    session (an id or messages).  ``form`` is null, and so are the lists, where none fits.
    """
    v = F.ltrim(F.col(column))
    array = v.startswith("[")
    whole = F.when(~array, F.from_json(v, ENVELOPE))
    listed = F.when(array, F.from_json(v, f"array<{_SESSION}>"))
    single = F.when(~array, F.from_json(v, _SESSION))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rows = raw.select(whole.alias("w"), listed.alias("l"), single.alias("s"))
    fits = F.col("w.entities").isNotNull() | F.col("w.sessions").isNotNull() | F.col("w.facts").isNotNull() | some(F.col("w.episodes")) | some(F.col("w.edges"))
    one = F.col("s.session_id").isNotNull() | F.col("s.id").isNotNull() | some(F.col("s.messages"))
    form = F.when(F.coalesce(fits, F.lit(False)), "envelope").when(F.col("l").isNotNull(), "sessions").when(F.coalesce(one, F.lit(False)), "session")
    rows = rows.withColumn("form", form)
    sessions = F.when(F.col("form") == "envelope", F.col("w.sessions")).when(F.col("form") == "sessions", F.col("l")).when(F.col("form") == "session", F.array("s"))
    rest = [F.when(F.col("form") == "envelope", F.col(f"w.{c}")).alias(c) for c in ("entities", "episodes", "edges")]
    return rows.select("form", *rest, sessions.alias("sessions"), F.when(F.col("form") == "envelope", F.col("w.facts")).alias("facts"))


def evidence_sessions(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """``(query_id, session_id)``: the sessions of a question's evidence turns; unknown turns are skipped."""
    asked = questions.select("query_id", F.explode("evidence").alias("doc_id"))
    return asked.join(turns.select("doc_id", "session_id"), "doc_id").select("query_id", "session_id").distinct()


def scalar(json: Column) -> Column:
    """``struct<kind, text>`` of a JSON value: String, Integer, Float or Bool; all else as a String of its JSON."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    # a decimal without a fraction is no integer of 64 bits
    name = F.when(kind == "STRING", "String").when(kind == "BIGINT", "Integer").when(kind == "BOOLEAN", "Bool").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "Float").otherwise("String")
    return F.when(v.isNotNull(), F.struct(name.alias("kind"), F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.trim(json)).alias("text")))
