"""Registered queries of lookups, tenancy, exports, texts and sources, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import codes, communities, evaluation, graph, relations, tenancy, training, vectors
from graphloom.queries import DAYS, EDGES, MESSAGES, NODES, NOW, asked, query, vectors_of
from graphloom.sources import connectors, generate, interop, tables
from graphloom.storage import checkpointed

# --- scans, lookups, writes --------------------------------------------------------------------


@query(f"WITH {NODES} SELECT * FROM nodes")
def scan_nodes(spark, sf_dir):
    """S2."""
    return tables.nodes(spark, sf_dir)


@query(f"WITH {EDGES} SELECT * FROM edges")
def scan_edges(spark, sf_dir):
    """The edges with type and weight."""
    return tables.edges(spark, sf_dir)


@query(f"WITH {NODES} SELECT * FROM nodes WHERE id IN (8, 17, 26, 35, 44, 53, 999999999)")
def get_node(spark, sf_dir):
    """Nodes by id; an unknown id gives no row."""
    return tables.nodes(spark, sf_dir).where(F.col("id").isin(8, 17, 26, 35, 44, 53, 999_999_999))


@query(f"WITH {EDGES} SELECT source, target, edge_type, CASE WHEN edge_type = 'Location' THEN 0.5 ELSE weight END AS weight FROM edges UNION ALL SELECT s_suppkey * 8 + 3, s_nationkey::BIGINT * 8 + 1, 'Companion', 0.25 FROM supplier")
def upsert_edges(spark, sf_dir):
    """New weights for all Location edges, and edges of another type between the same ends."""
    edges = tables.edges(spark, sf_dir)
    placed = tables.places(spark, sf_dir).where("edge_type = 'Location'")
    again = placed.where("source % 8 = 3").withColumn("edge_type", F.lit("Companion")).withColumn("weight", F.lit(0.25))
    return graph.upsert(edges, placed.withColumn("weight", F.lit(0.5)).unionByName(again), ["source", "target", "edge_type"])


@query(f"WITH {NODES} SELECT namespace, count(*) AS n FROM nodes WHERE node_type = 'Event' GROUP BY namespace")
def nodes_of_type(spark, sf_dir):
    """A type in any case."""
    return tenancy.of_type(tables.nodes(spark, sf_dir), "eVENT").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES} SELECT namespace, count(*) AS total, count_if(node_type = 'Entity')::BIGINT AS entities, count_if(node_type <> 'Entity')::BIGINT AS others, max(timestamp) AS last_activity FROM nodes WHERE namespace = '1-urgent' GROUP BY namespace")
def one_namespace_stats(spark, sf_dir):
    """A2/F4."""
    return tenancy.stats(tenancy.in_namespace(tables.nodes(spark, sf_dir), "1-urgent")).where("namespace = '1-urgent'")


@query(f"WITH {NODES} SELECT namespace, count(*) AS n, count_if((id // 8) % 20 = 0)::BIGINT AS deleted FROM nodes GROUP BY namespace")
def soft_deleted(spark, sf_dir):
    """every twentieth node marked; its namespace stays."""
    nodes = tables.nodes(spark, sf_dir)
    marked = tenancy.soft_deleted(nodes, nodes.where(F.floor(F.col("id") / 8) % 20 == 0))
    return marked.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("deleted"))


SWEPT = f"{NODES}, {EDGES}, gone AS (SELECT id FROM nodes WHERE timestamp > 0 AND {NOW} - timestamp > {10_000 * DAYS})"


@query(f"WITH {SWEPT} SELECT edge_type, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY edge_type")
def retention_sweep(spark, sf_dir):
    """Expired nodes removed with their edges; the edges that stay, by type."""
    kept = tenancy.swept(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), NOW, 10_000 * DAYS)[1]
    return kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


MERGED = f"""WITH {NODES}, {EDGES}, d AS (SELECT id, lower(trim(content)) AS key, namespace FROM nodes), there AS (SELECT key, min(id) AS there FROM d WHERE namespace = 'default' GROUP BY key),
  firsts AS (SELECT key, min(id) AS here FROM d WHERE namespace = '1-urgent' GROUP BY key), placed AS (SELECT d.id, coalesce(there, here) AS kept FROM d JOIN firsts USING (key) LEFT JOIN there USING (key) WHERE namespace = '1-urgent'),
  fresh AS (SELECT id AS old, 5000000000 + row_number() OVER (ORDER BY id) - 1 AS new FROM placed WHERE id = kept)"""


@query(f"{MERGED} SELECT new AS id, content, node_type, timestamp, 'default' AS namespace FROM fresh JOIN nodes ON id = old")
def namespace_merge(spark, sf_dir):
    """One namespace brought into another."""
    return tenancy.merge(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), "1-urgent", "default", 5_000_000_000)[0]


PAGE = f"{NODES}, {EDGES}, page AS (SELECT * FROM nodes WHERE namespace = 'default' AND node_type = 'Entity' ORDER BY timestamp DESC, id LIMIT 200)"


@query(f"WITH {PAGE} SELECT e.* FROM edges e WHERE source IN (SELECT id FROM page) AND target IN (SELECT id FROM page)")
def graph_view(spark, sf_dir):
    """The edges among a page of 200 nodes (the limit is the feature)."""
    return tenancy.view(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), 200, "entity", "default")[1]


@query(f"WITH {NODES} SELECT n.id, content, node_type, timestamp, c_nationkey::BIGINT AS community_id FROM nodes n LEFT JOIN customer ON n.id = c_custkey * 8 + 2")
def graph_items(spark, sf_dir):
    """all nodes as a graph view shows them; customers form communities by nation."""
    groups = nation_groups(spark, sf_dir).withColumn("node_id", F.col("node_id") * 8 + 2)
    return tenancy.graph_items(tables.nodes(spark, sf_dir), groups)


@query(f"WITH {NODES}, f AS (SELECT user_id AS query_id, (event_id % 2000) * 8 + 5 AS id, max(value) AS score FROM events GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score, content, node_type FROM f JOIN nodes USING (id) WHERE namespace = '1-urgent'")
def search_items(spark, sf_dir):
    """results of searches with content and type, of one namespace."""
    e = tables.load(spark, sf_dir, "events")
    found = e.groupBy(F.col("user_id").alias("query_id"), ((F.col("event_id") % 2000) * 8 + 5).alias("id")).agg(F.round(F.max("value"), 6).alias("score"))
    return tenancy.search_items(found, tables.nodes(spark, sf_dir), "1-urgent").select("query_id", "id", "score", "content", "node_type")


@query("SELECT event_id AS id, floor(epoch(ts))::BIGINT AS timestamp FROM events ORDER BY timestamp DESC, id DESC LIMIT 500")
def newest_audit(spark, sf_dir):
    """The newest 500 audit rows (the limit is the feature)."""
    return tenancy.newest(tables.audit(spark, sf_dir), 500).select("id", "timestamp")


@query("""WITH r AS (SELECT unnest(['viewer', 'reader', 'writer', 'admin']) AS role, unnest([1, 2, 3, 4]) AS rank), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, role, rank >= 3 AS may_write FROM u JOIN r ON rank = user_id % 4 + 1""")
def role_may(spark, sf_dir):
    """whether a user's role may write."""
    users = tables.load(spark, sf_dir, "events").select("user_id").distinct()
    roles = F.array(*[F.lit(r) for r in tenancy.ROLES])
    return users.withColumn("role", F.get(roles, (F.col("user_id") % 4).cast("int"))).withColumn("may_write", tenancy.may("role", "writer"))


def media_rows(spark, sf_dir):
    """Documents as media nodes: the id says which kind and which fields are missing."""
    n = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("text", "audio", "image", "video_segment")]), (n % 5).cast("int"))
    some = lambda k: F.when(n % k != 0, "x")
    return tables.load(spark, sf_dir, "documents").select(n.alias("id"), kind.alias("media_type"), some(3).alias("content"), some(7).alias("embedding"), some(4).alias("media_uri"), some(6).alias("embedding_visual"), some(11).alias("parent_video_id"), (n % 13).alias("start_ms"), F.lit(6).alias("end_ms"))


MEDIA = """m AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' WHEN 3 THEN 'video_segment' END AS kind FROM documents)"""


@query(f"""WITH {MEDIA}, v AS (SELECT id, list_filter([CASE WHEN coalesce(kind, 'text') IN ('text', 'audio') AND id % 3 = 0 THEN 'content' END, CASE WHEN coalesce(kind, 'text') IN ('text', 'audio') AND id % 7 = 0 THEN 'embedding' END,
  CASE WHEN kind IN ('image', 'video_segment') AND id % 6 = 0 THEN 'embedding_visual' END, CASE WHEN kind IN ('audio', 'image', 'video_segment') AND id % 4 = 0 THEN 'media_uri' END,
  CASE WHEN kind = 'video_segment' AND id % 11 = 0 THEN 'parent_video_id' END, CASE WHEN id % 13 >= 6 THEN 'time_range' END], lambda x: x IS NOT NULL) AS l FROM m) SELECT id, array_to_string(list_sort(l), ',') AS violations FROM v""")
def media_violations(spark, sf_dir):
    """X27."""
    return media_rows(spark, sf_dir).select("id", F.concat_ws(",", F.array_sort(tenancy.media_violations())).alias("violations"))



@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 3")
def media_filter(spark, sf_dir):
    """``video`` means video segments."""
    return tenancy.of_media(media_rows(spark, sf_dir), "video").select("id")


PRICED = """WITH p AS (SELECT event_type AS provider, min(value) AS price, median(value) AS p50, avg((user_id % 7 <> 0)::INT) AS success, avg(value) AS mean FROM events GROUP BY 1)"""


@query(f"""{PRICED} SELECT * FROM (SELECT 'cheapest' AS strategy, provider FROM p ORDER BY price, provider LIMIT 1) UNION ALL SELECT * FROM (SELECT 'fastest', provider FROM p ORDER BY p50, provider LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'quality', provider FROM p ORDER BY success / mean DESC, provider LIMIT 1)""")
def provider_choice(spark, sf_dir):
    """One provider by each strategy."""
    e = tables.load(spark, sf_dir, "events")
    per = e.groupBy(F.col("event_type").alias("provider")).agg(F.min("value").alias("price"), F.percentile("value", 0.5).alias("p50"), F.avg((F.col("user_id") % 7 != 0).cast("int")).alias("success"), F.avg("value").alias("mean"))
    picks = [tenancy.provider_choice(per, s).select(F.lit(s).alias("strategy"), "provider") for s in ("cheapest", "fastest", "quality")]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@query("""WITH b AS (SELECT i, 0.001 * pow(2.5, i) AS le FROM range(13) t(i)), e AS (SELECT event_type AS series, value / 100 AS v FROM events), s AS (SELECT DISTINCT series FROM e)
SELECT s.series, round(le, 9) AS le, count(v) AS observations FROM s CROSS JOIN b LEFT JOIN e ON e.series = s.series AND v <= le GROUP BY ALL""")
def latency_histogram(spark, sf_dir):
    """Cumulative counts in 13 buckets that grow by 2.5."""
    rows = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("series"), (F.col("value") / 100).alias("v"))
    return evaluation.histogram(rows, "series", "v").select("series", F.round("le", 9).alias("le"), "observations")


# --- exports and imports -----------------------------------------------------------------------


@query(f"""WITH {NODES} SELECT id, '{{"@id":"memory:node/' || id || '","@type":"' || node_type || '","content":"' || content || '","timestamp":' || timestamp || '}}' AS value FROM nodes WHERE namespace = '1-urgent' AND timestamp >= 820454400""")
def export_nodes(spark, sf_dir):
    """A namespace's nodes since a time, as lines."""
    return interop.export_graph(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), "1-urgent", 820_454_400)[0]


@query(f"""WITH {NODES}, {EDGES}, ids AS (SELECT id AS old, 700 + row_number() OVER (ORDER BY id) - 1 AS new FROM nodes WHERE namespace = 'default')
SELECT s.new AS source, t.new AS target, edge_type, weight FROM edges JOIN ids s ON s.old = source JOIN ids t ON t.old = target""")
def import_edges(spark, sf_dir):
    """An export read back under new ids; its edges."""
    lines = interop.export_graph(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), "default")
    return interop.import_graph(*lines, "copy", 700)[1]


def memory_exports(spark, sf_dir):
    """Exports of each conversation's messages as memories, in the four known forms and one that is not."""
    c = tables.load(spark, sf_dir, "conversations")
    memory = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", "turn").alias("memory"), F.concat(F.lit("u"), F.col("conv_id")).alias("user_id"))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", memory.alias("m")))).alias("l"))
    listed, kind = F.to_json(F.transform("l", lambda x: x["m"])), F.col("conv_id") % 5
    wrap = lambda a: F.concat(F.lit(a), listed, F.lit("}"))
    return per.select(F.when(kind == 0, wrap('{"results": ')).when(kind == 1, wrap('{"memories": ')).when(kind == 2, listed).when(kind == 3, F.to_json(F.get(F.col("l"), F.lit(0))["m"])).otherwise('{"other": 1}').alias("value"))


MEMORIES = """mem AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE conv_id % 5 < 4 QUALIFY conv_id % 5 < 3 OR position = 0)"""


@query(f"WITH {MEMORIES} SELECT position::INT AS position, conv_id || '-' || turn AS id, conv_id || ':' || turn AS memory, 'u' || conv_id AS user_id FROM mem")
def parse_memories(spark, sf_dir):
    """S13."""
    return interop.parse_memories(memory_exports(spark, sf_dir)).select("position", "id", "memory", "user_id")


@query(f"WITH {MEMORIES} SELECT * FROM (SELECT conv_id || ':' || turn AS source, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY position) AS target, 0.5::DOUBLE AS weight FROM mem) WHERE target IS NOT NULL")
def memory_chains(spark, sf_dir):
    """The chain of each user's memories, by their text."""
    nodes, edges = interop.memories_to_graph(interop.parse_memories(memory_exports(spark, sf_dir)), NOW, 1)
    named = nodes.select(F.col("id").alias("old"), F.col("content").alias("new"))
    return graph.remap(edges, named).select("source", "target", "weight")


@query("""SELECT o_orderkey AS source, o_custkey AS target, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 9 = 0 THEN 'Supersedes' ELSE 'RelatesTo' END AS edge_type, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 9 = 0 THEN 0.3 ELSE 0.7 END::DOUBLE AS weight
FROM orders WHERE o_custkey % 10 <> 0""")
def temporal_edges(spark, sf_dir):
    """Edges by uuid, some expired or invalid, some with unknown ends."""
    o = tables.load(spark, sf_dir, "orders")
    orders = o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("uuid"), F.col("o_orderkey").alias("id"))
    customers = tables.load(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), F.col("c_custkey").alias("id"))
    rows = o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("source_node_uuid"), F.concat(F.lit("c"), F.col("o_custkey")).alias("target_node_uuid"), F.when(F.col("o_orderstatus") == "F", "x").alias("expired_at"), F.when(F.col("o_orderkey") % 9 == 0, "x").alias("invalid_at"))
    return interop.temporal_edges(rows, orders.unionByName(customers))


@query("SELECT DISTINCT l_orderkey AS source, l_suppkey AS target, 'RelatesTo' AS edge_type, 0.5::DOUBLE AS weight FROM lineitem WHERE l_suppkey % 4 <> 0")
def episode_edges(spark, sf_dir):
    """An episode's edges to the entities it mentions; unknown ones are skipped."""
    episodes = tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey"))).alias("entity_uuids"))
    known = tables.load(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("uuid"), F.col("s_suppkey").alias("id"))
    return interop.episode_edges(episodes, known)


@query("SELECT DISTINCT l_orderkey AS query_id, l_partkey % 50 AS session_id FROM lineitem WHERE l_partkey % 3 <> 0")
def evidence_sessions(spark, sf_dir):
    """Evidence ids of a question to sessions; unknown ids are skipped."""
    questions = tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_list("l_partkey").alias("evidence"))
    turns = tables.load(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 50).alias("session_id"))
    return interop.evidence_sessions(questions, turns)


def sample_sessions(spark, sf_dir):
    c = tables.load(spark, sf_dir, "conversations")
    turn = F.struct(F.col("role").alias("speaker"), F.concat_ws(":", "conv_id", "turn").alias("dia_id"), F.col("text"))
    session = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("l"))
    return session.select(F.array(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.transform("l", lambda x: x["t"]).alias("turns"))).alias("sessions"))


@query("SELECT conv_id || ':' || turn AS doc_id, concat_ws(': ', role, text) AS content FROM conversations")
def turn_documents(spark, sf_dir):
    """A document a turn."""
    return interop.turn_documents(sample_sessions(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS doc_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def session_documents(spark, sf_dir):
    """A document a session."""
    return interop.session_documents(sample_sessions(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role = 'assistant' AND conv_id % 3 = 0 AS marked FROM conversations WHERE conv_id % 2 = 0), m AS (SELECT *, bool_or(marked) OVER (PARTITION BY conv_id) AS any_marked FROM c)
SELECT 'q' || conv_id AS query_id, 's' || conv_id || ':' || n AS doc_id FROM m WHERE marked OR NOT any_marked""")
def answer_turns(spark, sf_dir):
    """The marked turns of answer sessions, else all their turns."""
    c = tables.load(spark, sf_dir, "conversations")
    marked = F.when(F.col("conv_id") % 3 == 0, F.col("role") == "assistant")
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", marked.alias("has_answer")))).alias("l"))
    name = F.concat(F.lit("s"), F.col("conv_id"))
    questions = per.select(F.concat(F.lit("q"), F.col("conv_id")).alias("question_id"), F.when(F.col("conv_id") % 2 == 0, F.array(name)).otherwise(F.array(F.lit("none"))).alias("answer_session_ids"), F.array(name).alias("haystack_session_ids"), F.array(F.col("l")).alias("haystack_sessions"))
    return interop.answer_turns(questions)


@query("SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS seconds FROM events")
def iso_seconds(spark, sf_dir):
    """With fraction and offset, both left out, and some that are no times."""
    e = tables.load(spark, sf_dir, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ".123+02:00").otherwise("Z"))
    return e.select(F.col("event_id").alias("id"), tx.iso_seconds(F.when(F.col("event_id") % 13 == 0, "soon").otherwise(stamp)).alias("seconds"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'String' WHEN 1 THEN 'Integer' WHEN 2 THEN 'Float' WHEN 3 THEN 'Bool' WHEN 4 THEN 'String' END AS kind, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN user_id || '.5' WHEN 3 THEN 'true' WHEN 4 THEN '[' || user_id || ']' END AS text FROM events""")
def json_scalars(spark, sf_dir):
    """Strings, integers, fractions, truth values, a list, and what is no JSON."""
    e, k, user = tables.load(spark, sf_dir, "events"), F.col("event_id") % 6, F.col("user_id").cast("string")
    json = F.when(k == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(k == 1, user).when(k == 2, F.concat(user, F.lit(".5"))).when(k == 3, "true").when(k == 4, F.concat(F.lit("["), user, F.lit("]"))).otherwise("{oops")
    return e.select(F.col("event_id").alias("id"), interop.scalar(json).alias("s")).select("id", "s.kind", "s.text")


# --- sources with cursors ----------------------------------------------------------------------


@query("SELECT event_id AS id FROM events WHERE event_id::VARCHAR > '500'")
def cursor_text(spark, sf_dir):
    """A source whose ids compare as text."""
    rows = tables.load(spark, sf_dir, "events")
    return connectors.since(rows, "discord", "500", "event_id").select(F.col("event_id").alias("id"))


@query("SELECT 'telegram' AS source, max(event_id)::VARCHAR AS cursor FROM events UNION ALL SELECT 'mongodb', max(event_id::VARCHAR) FROM events")
def next_cursors(spark, sf_dir):
    """The next cursor by each source's own type."""
    rows = tables.load(spark, sf_dir, "events")
    found = [connectors.next_cursor(rows, s, "event_id").select(F.lit(s).alias("source"), "cursor") for s in ("telegram", "mongodb")]
    return found[0].unionByName(found[1])


@query("SELECT p_partkey::VARCHAR AS source_id, p_name || chr(10) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN p_brand || chr(10) || chr(10) ELSE '' END || p_type AS content FROM part")
def joined_items(spark, sf_dir):
    """A row's text columns as one content, blanks left out."""
    p = tables.load(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("  "))
    return connectors.items(p, "postgres", connectors.joined_content(["p_name", "p_brand", "p_type"]), F.col("p_partkey")).select("source_id", "content")


@query(r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'http://[^/]*\.com/(?:.*/)?8[^/]*')")
def glob_paths(spark, sf_dir):
    """F16."""
    return tables.load(spark, sf_dir, "pages").where(F.col("url").rlike(tx.glob("http://*.com/**/8*"))).select("page_id", "url")


# --- texts -------------------------------------------------------------------------------------


def untidy():
    """A document's text with carriage returns, form feeds, controls and runs of blanks."""
    return F.concat(F.lit("\r\n "), F.replace(F.replace("text", F.lit(". "), F.lit(".\f\r")), F.lit(", "), F.lit(",\t \x01  ")), F.lit(" \n"))


UNTIDY = "chr(13) || chr(10) || ' ' || replace(replace(text, '. ', '.' || chr(12) || chr(13)), ', ', ',' || chr(9) || ' ' || chr(1) || '  ') || ' ' || chr(10)"


@query(rf"""WITH t AS (SELECT doc_id, replace(replace({UNTIDY}, chr(13), ''), chr(12), chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM t""")
def cleaned_texts(spark, sf_dir):
    """X3."""
    return tables.load(spark, sf_dir, "documents").select("doc_id", tx.cleaned(untidy()).alias("text"))


@query(r"""WITH p AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(12)), chr(12)) AS l FROM documents), u AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS page, unnest(l) AS t FROM p)
SELECT doc_id, page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM u WHERE regexp_matches(t, '\S')""")
def page_texts(spark, sf_dir):
    """A page a sentence."""
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(tx.pages(F.replace("text", F.lit(". "), F.lit(".\f")))).alias("p")).select("doc_id", "p.page", "p.text")


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 41 THEN text ELSE left(text, list_max(list_filter(range(0, 42), lambda n: octet_length(encode(left(text, n))) <= 41))) || '...' END AS text FROM documents WHERE text IS NOT NULL""")
def truncated_texts(spark, sf_dir):
    """At most 41 bytes, whole characters."""
    return tables.load(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.truncated("text", 41).alias("text"))


@query("""SELECT doc_id, 'id: ' || doc_id AS frontmatter, CASE WHEN doc_id % 11 = 3 THEN 'page 3' ELSE 'page ' || doc_id % 11 || ',page 3' END AS links, 'tag' || doc_id % 7 AS tags FROM documents""")
def note_parts(spark, sf_dir):
    """Front matter, links and tags of notes."""
    n = F.col("doc_id")
    note = F.concat(F.lit("---\nid: "), n, F.lit("\n---\n#tag"), n % 7, F.lit(" [[page "), n % 11, F.lit("|other]] [[page "), n % 11, F.lit("#part]] [[page 3]]\n```\n#code\n```\n#tag"), n % 7)
    d = tables.load(spark, sf_dir, "documents").select("doc_id", note.alias("note"))
    return d.select("doc_id", tx.frontmatter("note").alias("frontmatter"), F.array_join(tx.wikilinks("note"), ",").alias("links"), F.array_join(tx.tags("note"), ",").alias("tags"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN o_orderdate END::DATE AS day FROM orders")
def partial_dates(spark, sf_dir):
    """Years, months, days, and what is none of them."""
    o, k = tables.load(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    day = lambda f: F.date_format("o_orderdate", f)
    return o.select(F.col("o_orderkey").alias("id"), tx.partial_date(F.when(k == 0, day("yyyy")).when(k == 1, day("yyyy-MM")).when(k == 2, day("yyyy-MM-dd")).otherwise("May")).alias("day"))


@query("SELECT c_custkey AS id, left(c_name || ' has ' || c_acctbal::DECIMAL(20,2)::VARCHAR || ' on account and lives in ' || c_nationkey || '.', 60) AS name FROM customer")
def entity_names(spark, sf_dir):
    """The first sentence, at most 60 characters."""
    c = tables.load(spark, sf_dir, "customer")
    content = F.concat("c_name", F.lit(" has "), F.col("c_acctbal").cast("decimal(20,2)").cast("string"), F.lit(" on account and lives in "), F.col("c_nationkey"), F.lit(". More. "))
    return c.select(F.col("c_custkey").alias("id"), tx.entity_name(content).alias("name"))



@query(f"""WITH {NODES}, {EDGES} SELECT source AS id, count(*) AS relations, round(sum(least(greatest(weight, 0), 1)), 6) AS confidence, arg_min(n.content, target) AS first_object
FROM edges e JOIN nodes n ON n.id = e.target WHERE edge_type IN ('RelatesTo', 'CausedBy', 'HasProperty', 'Actor', 'Object', 'Location', 'Companion') AND source IN (SELECT id FROM nodes WHERE node_type = 'Entity') GROUP BY source""")
def training_samples(spark, sf_dir):
    """Entities with their relations, here counted."""
    s = training.samples(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))
    total = F.aggregate("relations", F.lit(0.0), lambda a, r: a + r["confidence"])
    return s.select("id", F.size("relations").cast("long").alias("relations"), F.round(total, 6).alias("confidence"), F.col("relations")[0]["object"].alias("first_object"))


@query(f"WITH {MESSAGES} SELECT (SELECT count(*) FROM messages WHERE position = 0) AS queries, (SELECT count(DISTINCT author) FROM messages WHERE position = 0) AS categories, (SELECT count(*) FROM messages) AS documents")
def dataset_counts(spark, sf_dir):
    """A16."""
    m = tables.messages(spark, sf_dir)
    return training.dataset_counts(m.where("position = 0").withColumn("category", F.col("author")), m)


@query("""WITH r AS (SELECT event_type AS ability, user_id % 9 AS g, count(*) AS queries, avg(value) AS recall, max(value) AS p95 FROM events GROUP BY ALL)
SELECT ability, round(sum(recall * queries) / sum(queries), 6) AS recall, max(p95) AS p95 FROM r GROUP BY ability""")
def ability_rollup(spark, sf_dir):
    """Means weighted by queries, the worst percentile."""
    e = tables.load(spark, sf_dir, "events")
    per = e.groupBy(F.col("event_type").alias("ability"), F.col("user_id") % 9).agg(F.count(F.lit(1)).alias("queries"), F.avg("value").alias("recall"), F.max("value").alias("p95"))
    return evaluation.ability(per).withColumn("recall", F.round("recall", 6))


# --- relations, communities, generators --------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + 4 + l_quantity::INT % 12 AS e FROM lineitem), o AS (SELECT *, lead(s) OVER w AS next_s, lag(e) OVER w AS last_e FROM (SELECT DISTINCT id, s, e FROM s QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY e) = 1) WINDOW w AS (PARTITION BY id ORDER BY s))
SELECT id, s AS start, e AS "end" FROM o WHERE coalesce(e <= next_s, true) AND coalesce(last_e <= s, true)""")
def lonely_spans(spark, sf_dir):
    """Of spans that all overlap none, every one is kept."""
    li = tables.load(spark, sf_dir, "lineitem")
    s, e = F.col("l_linenumber") * 10, F.col("l_linenumber") * 10 + 4 + F.col("l_quantity").cast("int") % 12
    one = li.select(F.col("l_orderkey").alias("id"), s.cast("int").alias("start"), e.cast("int").alias("end")).groupBy("id", "start").agg(F.min("end").alias("end"))
    w = Window.partitionBy("id").orderBy("start")
    clear = one.withColumn("_n", F.lead("start").over(w)).withColumn("_l", F.lag("end").over(w)).where((F.col("_n").isNull() | (F.col("end") <= F.col("_n"))) & (F.col("_l").isNull() | (F.col("_l") <= F.col("start"))))
    spans = clear.groupBy("id").agg(F.collect_list(F.struct("start", "end", (F.col("start") % 7 / 7.0).alias("confidence"))).alias("spans"))
    return spans.select("id", F.explode(relations.greedy_spans("spans")).alias("x")).select("id", "x.start", "x.end")


@query("""SELECT event_id AS text_id, 'model' AS predicate FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'nearby' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def extractor_fallback(spark, sf_dir):
    """The second extractor answers for texts of which the first has nothing."""
    e = tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("text_id"))
    return relations.with_fallback(e.where("text_id % 3 = 0").withColumn("predicate", F.lit("model")), e.where("text_id % 2 = 0").withColumn("predicate", F.lit("nearby")))


def nation_groups(spark, sf_dir):
    return tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("long").alias("community_id"))


@query("SELECT c_nationkey::BIGINT AS community_id, count(*) AS size, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1")
def community_members(spark, sf_dir):
    """A9."""
    return communities.members(nation_groups(spark, sf_dir)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 20 <> 0 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 20 = 0)")
def community_partners(spark, sf_dir):
    """All co-members of every twentieth customer."""
    groups = nation_groups(spark, sf_dir)
    return communities.co_members(groups, groups.where("node_id % 20 = 0").select(F.col("node_id").alias("id")), None)


@query("""WITH old AS (SELECT c_custkey AS n, c_nationkey AS c FROM customer), new AS (SELECT n, CASE WHEN n % 50 = 0 AND c < 5 THEN 99 ELSE c + 1 END AS c FROM old WHERE NOT (n % 33 = 0 AND c BETWEEN 5 AND 8)),
  a AS (SELECT n, string_agg(n::VARCHAR, ',' ORDER BY n) OVER (PARTITION BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM old), b AS (SELECT n, string_agg(n::VARCHAR, ',' ORDER BY n) OVER (PARTITION BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM new)
SELECT a.n AS node_id FROM a LEFT JOIN b USING (n) WHERE a.m IS DISTINCT FROM b.m""")
def changed_communities(spark, sf_dir):
    """Some customers moved, some vanished; renamed groups are not changed."""
    old = nation_groups(spark, sf_dir)
    moved = F.when((F.col("node_id") % 50 == 0) & (F.col("community_id") < 5), F.lit(99)).otherwise(F.col("community_id") + 1)
    new = old.where(~((F.col("node_id") % 33 == 0) & F.col("community_id").between(5, 8))).withColumn("community_id", moved)
    return communities.changed(old, new)


@query("SELECT (i - 1) // 3 AS source, i AS target, 'RelatesTo' AS edge_type, 1.0::DOUBLE AS weight FROM range(1, 5000) t(i) UNION ALL SELECT i, i + 1, 'NextEpisode', 1.0 FROM range(0, 999) t(i)")
def synthetic_shapes(spark, sf_dir):
    """A tree and a chain."""
    return generate.tree(spark, 3, 5_000).unionByName(generate.chain(spark, 1_000))


@query()
def ann_topk(spark, sf_dir):
    """V5: ten near vectors of every twentieth one, from two thirds of about sqrt(n) cells: these vectors hardly cluster (recall 0.95 or more against J16, held by a test)."""
    v = vectors_of(spark, sf_dir).select("id", "embedding")
    n = max(4, round(v.count() ** 0.5))
    cells = vectors.fit_cells(v, n)
    index = checkpointed(vectors.celled(v, cells))
    return vectors.topk_cells(asked(spark, sf_dir), index, cells, 10, -(-2 * n // 3)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def coded_search(spark, sf_dir, k: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """Near vectors of every twentieth one by product codes: the result, the candidates and the number of vectors."""
    v = vectors_of(spark, sf_dir).select("id", "embedding")
    n = v.count()
    cells = max(4, round(n**0.5))
    book = codes.fit(v, cells)
    index = checkpointed(codes.coded(v, book))
    probes, rerank = -(-2 * cells // 3), max(k, n // 20)
    barred = checkpointed(codes.bars(asked(spark, sf_dir), index, book, probes, rerank))
    return codes.topk_over(barred, v, index, book, k, probes), codes.candidates_over(barred, index, book, probes), n


@query()
def ann_codes(spark, sf_dir):
    """V5: ten near vectors of every twentieth one: 16-byte codes of two thirds of the cells, a twentieth of the vectors scored exactly."""
    found, _, _ = coded_search(spark, sf_dir)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, true AS found_nine_tenths, true AS scored_a_tenth_at_most FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def ann_codes_recall(spark, sf_dir):
    """V5: whether the coded search finds nine tenths of the true ten and scores at most a tenth of the vectors a query."""
    found, scored, n = coded_search(spark, sf_dir)
    true = vectors.topk_many(asked(spark, sf_dir), vectors_of(spark, sf_dir), 10).select("query_id", "id", F.lit(1).alias("true"))
    hits = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hits.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("true")).alias("found_nine_tenths"))
    share = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= n / 10).alias("scored_a_tenth_at_most"))
    return recall.crossJoin(share)
