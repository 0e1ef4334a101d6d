"""Registered queries of the memory-graph operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vector
from graphloom.operators import communities, evaluation, facts, graph, mindset, relations, reward, scoring, tenancy, training, vectors
from graphloom.plans import retrieval
from graphloom.sources import tables
from graphloom.storage import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = 1_735_689_600
DAYS = 86_400

NODES = """nodes AS (
  SELECT r_regionkey::BIGINT * 8 AS id, r_name AS content, 'Entity' AS node_type, 0::BIGINT AS timestamp, 'default' AS namespace FROM region
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, n_name, 'Entity', 0, 'default' FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, c_name, 'Entity', 0, lower(c_mktsegment) FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, s_name, 'Entity', 0, 'default' FROM supplier
  UNION ALL SELECT p_partkey * 8 + 4, p_name, 'Entity', 0, 'default' FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, 'order ' || o_orderkey, 'Event', floor(epoch(o_orderdate))::BIGINT, lower(o_orderpriority) FROM orders)"""
PLACES = """places AS (
  SELECT c_custkey * 8 + 2 AS source, c_nationkey::BIGINT * 8 + 1 AS target, 'Location' AS edge_type, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, s_nationkey::BIGINT * 8 + 1, 'Location', 1.0 FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, n_regionkey::BIGINT * 8, 'RelatesTo', 1.0 FROM nation)"""
EDGES = (
    PLACES
    + """, edges AS (
  SELECT * FROM places
  UNION ALL SELECT o_orderkey * 8 + 5, o_custkey * 8 + 2, 'Actor', 1.0 FROM orders
  UNION ALL SELECT l_orderkey * 8 + 5, l_partkey * 8 + 4, 'Object', max(l_quantity) / 50.0 FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT l_orderkey * 8 + 5, l_suppkey * 8 + 3, 'Companion', max(l_quantity) / 50.0 FROM lineitem GROUP BY 1, 2)"""
)
FACTS = """facts AS (
  SELECT event_id AS id, user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object,
         least(greatest(value / 500.0, 0.0), 1.0) AS source_confidence, floor(epoch(ts))::BIGINT AS timestamp FROM events)"""
MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn AS position, role AS author, text AS content, conv_id * 100000 + turn * 60 AS timestamp FROM conversations)"
#: The nodes whose key (id without kind) is divisible by 20 are the stated start or query set of searches.
SEEDS = "SELECT id FROM nodes WHERE (id // 8) % 20 = 0"
AUDIT = """audit AS (
  SELECT event_id AS id, floor(epoch(ts))::BIGINT AS timestamp, user_id::VARCHAR AS "user", value,
         CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
         CASE event_type WHEN 'purchase' THEN 'memories.create' WHEN 'signup' THEN 'memories.update' WHEN 'error' THEN 'memories.delete' WHEN 'view' THEN 'entities.get' ELSE 'admin.namespaces.x' END AS action,
         CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def seeds_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.floor(F.col("id") / 8) % 20 == 0).select("id")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(spark, sf_dir).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
TOPK = f"""top AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 12) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


# --- vectors -----------------------------------------------------------------------------------


@query(f"SELECT b.vec_id AS id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {DOT} DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    """V1."""
    v = vectors_of(spark, sf_dir)
    first = v.where("id = 0").select("embedding").first()
    return vectors.topk(v, list(first[0]) if first else [0.0], 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {TOPK} SELECT query_id, id, round(score, 6) AS score, rank::BIGINT AS rank FROM top WHERE rank <= 10")
def vector_topk_multi(spark, sf_dir):
    """Ten nearest vectors of every twentieth one, itself included."""
    return vectors.topk_many(asked(spark, sf_dir), vectors_of(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TOPK} SELECT query_id, id, round(score, 6) AS score FROM top WHERE rank <= 10 AND score >= 0.5")
def vector_min_similarity(spark, sf_dir):
    """F3."""
    return vectors.topk_many(asked(spark, sf_dir), vectors_of(spark, sf_dir), 10, min_similarity=0.5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def l2_normalize(spark, sf_dir):
    """V4: the sum of the unit vector's components."""
    unit = vector.normalised("embedding")
    return vectors_of(spark, sf_dir).select("id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH c AS (SELECT label, vec_id, embedding FROM embeddings WHERE label IS NOT NULL), first AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM c GROUP BY label)
SELECT b.vec_id AS id, round({DOT}, 6) AS cosine FROM first a JOIN c b USING (label)""")
def cosine_guarded(spark, sf_dir):
    """V3: cosine of each vector with its label's first one."""
    v = vectors_of(spark, sf_dir).where("label is not null")
    first = v.groupBy("label").agg(F.min_by("embedding", "id").alias("first"))
    return v.join(first, "label").select("id", F.round(vector.guarded_cosine("first", "embedding"), 6).alias("cosine"))


@query(f"""WITH {TOPK}, t AS (SELECT id, max(score) AS s FROM top WHERE rank <= 10 AND query_id % 40 = 0 GROUP BY id), v AS (SELECT id, max(score) AS s FROM top WHERE rank <= 10 AND query_id % 40 <> 0 GROUP BY id)
SELECT coalesce(t.id, v.id) AS id, round(coalesce(t.s, 0) * 0.6 + coalesce(v.s, 0) * 0.4, 6) AS score, CASE WHEN coalesce(t.s, 0) > 0 AND coalesce(v.s, 0) > 0 THEN 'Fused' WHEN coalesce(v.s, 0) > 0 THEN 'Visual' ELSE 'Text' END AS source FROM t FULL JOIN v ON t.id = v.id""")
def fuse_scores(spark, sf_dir):
    """Two result sets merged."""
    top = vectors.topk_many(asked(spark, sf_dir), vectors_of(spark, sf_dir), 10)
    text, visual = vectors.max_over_frames(top.where("query_id % 40 = 0")), vectors.max_over_frames(top.where("query_id % 40 <> 0"))
    return vectors.fuse(text, visual, 0.6, 0.4).withColumn("score", F.round("score", 6))


# --- graph -------------------------------------------------------------------------------------

BOTH = "links AS (SELECT source AS node, target AS neighbour FROM edges UNION SELECT target, source FROM edges)"
REACH = f"""{NODES}, {EDGES}, {BOTH}, start AS ({SEEDS}),
  one AS (SELECT DISTINCT s.id AS seed, neighbour AS node FROM start s JOIN links b ON b.node = s.id),
  two AS (SELECT DISTINCT o.seed, b.neighbour AS node FROM one o JOIN links b ON b.node = o.node),
  reach AS (SELECT id AS seed, id AS node, 0 AS depth FROM start UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two),
  least AS (SELECT seed, node, min(depth)::INT AS depth FROM reach GROUP BY ALL)"""


def edges_and_seeds(spark, sf_dir):
    """All edges, and every twentieth node of each kind."""
    return tables.edges(spark, sf_dir), seeds_of(tables.nodes(spark, sf_dir))


@query(f"WITH {REACH} SELECT seed, node, depth FROM least WHERE depth = 1")
def neighbors_1hop(spark, sf_dir):
    """G1."""
    return graph.neighbours(*edges_and_seeds(spark, sf_dir), 1)


@query(f"WITH {REACH} SELECT seed, node, depth FROM least WHERE depth > 0")
def neighbors_2hop(spark, sf_dir):
    """G1."""
    return graph.neighbours(*edges_and_seeds(spark, sf_dir), 2)


@query(f"WITH {REACH} SELECT seed, node, depth, content FROM least l JOIN nodes n ON n.id = l.node WHERE node_type = 'Entity' AND namespace <> 'building'")
def traverse(spark, sf_dir):
    """The start included, the filter on what is returned."""
    edges, seeds = edges_and_seeds(spark, sf_dir)
    return graph.traverse(tables.nodes(spark, sf_dir), edges, seeds, 2, (F.col("node_type") == "Entity") & (F.col("namespace") != "building")).select("seed", "node", "depth", "content")


LOCATED = REACH.replace(BOTH, "links AS (SELECT source AS node, target AS neighbour FROM edges WHERE edge_type IN ('Actor', 'Location') UNION SELECT target, source FROM edges WHERE edge_type IN ('Actor', 'Location'))")


@query(f"WITH {LOCATED} SELECT seed, node, depth FROM least WHERE depth > 0")
def neighbors_edge_filter(spark, sf_dir):
    """F2 (Q1): the edge predicate holds before each hop."""
    return graph.neighbours(*edges_and_seeds(spark, sf_dir), 2, F.col("edge_type").isin("Actor", "Location"))


@query(f"WITH {REACH} SELECT node AS id, round(max((seed % 97) / 97.0 * pow(0.5, depth)), 9) AS score FROM least GROUP BY node")
def hybrid_decay(spark, sf_dir):
    """Seeds scored by their id."""
    edges, seeds = edges_and_seeds(spark, sf_dir)
    scored = seeds.withColumn("score", (F.col("id") % 97) / 97.0)
    return graph.hybrid(edges, scored, 2, 0.5).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {NODES}, {PLACES}, start AS ({SEEDS} AND id % 8 = 2)
SELECT s.id AS start, n.n_regionkey::BIGINT * 8 AS goal, 2 AS hops, [s.id, c.target, n.n_regionkey::BIGINT * 8]::VARCHAR AS path
FROM start s JOIN places c ON c.source = s.id JOIN nation n ON n.n_nationkey * 8 + 1 = c.target""")
def shortest_path(spark, sf_dir):
    """From customers to their region."""
    seeds = seeds_of(tables.nodes(spark, sf_dir).where("id % 8 = 2")).withColumnRenamed("id", "start")
    nation = tables.load(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 8 + 1).alias("nation"), (F.col("n_regionkey").cast("long") * 8).alias("goal"))
    homes = tables.load(spark, sf_dir, "customer").select((F.col("c_custkey") * 8 + 2).alias("start"), (F.col("c_nationkey").cast("long") * 8 + 1).alias("nation"))
    pairs = seeds.join(homes, "start").join(nation, "nation").select("start", "goal")
    return graph.shortest_paths(tables.places(spark, sf_dir), pairs, 4).select("start", "goal", (F.size("path") - 1).alias("hops"), F.concat(F.lit("["), F.array_join("path", ", "), F.lit("]")).alias("path"))


SALES = "pairs AS (SELECT o_custkey * 8 + 2 AS start, l_suppkey * 8 + 3 AS goal FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0 GROUP BY ALL)"


def sales_pairs(spark, sf_dir):
    o, li = tables.load(spark, sf_dir, "orders").where("o_custkey % 20 = 0"), tables.load(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 8 + 2).alias("start"), (F.col("l_suppkey") * 8 + 3).alias("goal")).distinct()


PATHS = f"""WITH {EDGES}, {SALES}, walk AS (
  SELECT start, goal, e.source AS mid, ['Actor', x.edge_type] AS types FROM pairs p JOIN edges e ON e.target = p.start AND e.edge_type = 'Actor' JOIN edges x ON x.source = e.source AND x.target = p.goal)"""


@query(f"{PATHS} SELECT start, goal, [start, mid, goal]::VARCHAR AS nodes, 2 AS hops, 1.0::DOUBLE * 0.7 AS coherence FROM walk")
def simple_paths(spark, sf_dir):
    """Customer - order - supplier, two hops."""
    paths = graph.simple_paths(tables.edges(spark, sf_dir).where("edge_type in ('Actor', 'Companion')"), sales_pairs(spark, sf_dir), 2, None)
    return paths.select("start", "goal", F.concat(F.lit("["), F.array_join("nodes", ", "), F.lit("]")).alias("nodes"), "hops", reward.coherence("types").alias("coherence"))


@query(f"""{PATHS}, best AS (SELECT goal, start, count(*) AS n FROM walk GROUP BY ALL)
SELECT start, goal, n AS paths, round((0.4 * 0.64 + 0.4 * 0.7 + 0.2 * 1.0)::DOUBLE, 9) AS reward FROM best""")
def path_reward(spark, sf_dir):
    """The best reward of each pair and how many paths there are."""
    edges = tables.edges(spark, sf_dir).where("edge_type in ('Actor', 'Companion')")
    paths = graph.simple_paths(edges, sales_pairs(spark, sf_dir), 2, None).withColumn("path_id", F.xxhash64("nodes", "types"))
    return reward.score_paths(paths, edges).groupBy("start", "goal").agg(F.count(F.lit(1)).alias("paths"), F.round(F.max("reward"), 9).alias("reward"))


@query(f"WITH {EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT id, degree, round(degree / (SELECT max(degree) FROM d), 9) AS centrality FROM d")
def degree_centrality(spark, sf_dir):
    """A5."""
    return graph.degree_centrality(tables.edges(spark, sf_dir)).withColumn("centrality", F.round("centrality", 9))


@query(f"""WITH {NODES}, {EDGES}, c AS ({SEEDS}), n AS (SELECT node AS id, count(DISTINCT neighbour) AS k FROM (SELECT source AS node, target AS neighbour FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY node), j AS (SELECT c.id, coalesce(k, 1) AS k FROM c LEFT JOIN n USING (id))
SELECT id, round(k / (SELECT max(k) FROM j), 9) AS centrality FROM j""")
def neighbor_centrality(spark, sf_dir):
    """A6."""
    return graph.neighbour_centrality(tables.edges(spark, sf_dir), seeds_of(tables.nodes(spark, sf_dir))).withColumn("centrality", F.round("centrality", 9))


@query(f"WITH {NODES}, {EDGES} SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes WHERE namespace IN ('default', '1-urgent')) AND target IN (SELECT id FROM nodes WHERE namespace IN ('default', '1-urgent'))")
def induced_subgraph(spark, sf_dir):
    """J3."""
    return graph.induced(tables.edges(spark, sf_dir), tables.nodes(spark, sf_dir).where("namespace in ('default', '1-urgent')"))


@query(f"WITH {NODES}, {EDGES}, s AS ({SEEDS}) SELECT * FROM edges WHERE source IN (SELECT id FROM s) OR target IN (SELECT id FROM s)")
def incident_edges(spark, sf_dir):
    """J4."""
    return graph.incident(tables.edges(spark, sf_dir), seeds_of(tables.nodes(spark, sf_dir)))


@query(f"WITH {EDGES} SELECT edge_type, count(*) AS n, round(sum(weight), 6) AS weight FROM edges WHERE edge_type IN ('RelatesTo', 'CausedBy', 'HasProperty', 'Actor', 'Object', 'Location', 'Companion') GROUP BY edge_type")
def relation_edges(spark, sf_dir):
    """Relation edges by type."""
    from graphloom.schema import RELATION_TYPES

    return tables.edges(spark, sf_dir).where(F.col("edge_type").isin(*RELATION_TYPES)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT event_id AS id, user_id AS subject FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    """W6/S6."""
    rows = tables.load(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return tenancy.latest(rows.select("id", "user_id", "ts"), "user_id", "ts").select("id", F.col("user_id").alias("subject"))


@query(f"""WITH {NODES}, kept AS (SELECT * FROM nodes WHERE id % 20 <> 0) SELECT id, content, node_type, timestamp, namespace FROM kept UNION ALL SELECT id, content || ' *', node_type, timestamp + 1, namespace FROM nodes WHERE id % 20 = 0""")
def upsert_nodes(spark, sf_dir):
    """Every twentieth node is written again."""
    nodes = tables.nodes(spark, sf_dir)
    new = nodes.where("id % 20 = 0").withColumn("content", F.concat("content", F.lit(" *"))).withColumn("timestamp", F.col("timestamp") + 1)
    return graph.upsert(nodes, new, ["id"]).select("id", "content", "node_type", "timestamp", "namespace")


@query(f"WITH {NODES}, {EDGES} SELECT source, target, edge_type FROM edges WHERE (source // 8) % 20 <> 0 AND (target // 8) % 20 <> 0")
def delete_cascade(spark, sf_dir):
    """The edges left after every twentieth node went."""
    nodes = tables.nodes(spark, sf_dir)
    return graph.delete_nodes(nodes, tables.edges(spark, sf_dir), seeds_of(nodes))[1].select("source", "target", "edge_type")


# --- facts and scores --------------------------------------------------------------------------

LATER = "(b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.id > a.id))"
RESOLVED = f"""WITH {FACTS}, pairs AS (
  SELECT a.subject, a.predicate, a.id AS old_id, b.id AS new_id, abs(b.timestamp - a.timestamp) > {7 * DAYS} AS apart, abs(b.source_confidence - a.source_confidence) > 0.3 AS surer,
         b.timestamp > a.timestamp AS newer, b.source_confidence > a.source_confidence AS better
  FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object AND {LATER}),
resolved AS (
  SELECT subject, predicate, old_id, new_id, CASE WHEN apart THEN 'Temporal' WHEN surer THEN 'Confidence' ELSE 'Ambiguous' END AS strategy,
         CASE WHEN apart THEN newer WHEN surer THEN better ELSE false END AS new_wins FROM pairs),
final AS (
  SELECT *, CASE WHEN new_wins THEN new_id ELSE old_id END AS winner, CASE WHEN new_wins THEN old_id ELSE new_id END AS loser FROM resolved)"""


@query(f"{RESOLVED} SELECT subject, predicate, old_id, new_id FROM final")
def fact_conflicts(spark, sf_dir):
    """All conflicting pairs."""
    return facts.conflicts(tables.facts(spark, sf_dir)).select("subject", "predicate", "old_id", "new_id")


@query(f"WITH {FACTS} SELECT b.id AS new_id, arg_min(a.id, (a.timestamp, a.id)) AS old_id FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object AND {LATER} GROUP BY b.id")
def fact_first_conflict(spark, sf_dir):
    """C12 (Q10): the earliest one only."""
    return facts.conflicts(tables.facts(spark, sf_dir), first_only=True).select("new_id", "old_id")


@query(f"{RESOLVED} SELECT old_id, new_id, strategy, winner, loser, CASE strategy WHEN 'Ambiguous' THEN 'Contradiction' ELSE 'Accepted' END AS winner_state, CASE strategy WHEN 'Ambiguous' THEN 'Contradiction' ELSE 'Superseded' END AS loser_state FROM final")
def conflict_resolution(spark, sf_dir):
    """C13, with a threshold of seven days."""
    return facts.resolve(tables.facts(spark, sf_dir), 7 * DAYS).select("old_id", "new_id", "strategy", "winner", "loser", "winner_state", "loser_state")


@query(f"{RESOLVED} SELECT winner AS source, loser AS target, 'ConflictsWith' AS edge_type, strategy FROM final UNION ALL SELECT winner, loser, 'Supersedes', strategy FROM final WHERE strategy <> 'Ambiguous'")
def conflict_edges(spark, sf_dir):
    """C14."""
    return facts.conflict_edges(facts.resolve(tables.facts(spark, sf_dir), 7 * DAYS))


@query(f"{RESOLVED}, marks AS (SELECT loser AS id, CASE strategy WHEN 'Ambiguous' THEN 'Contradiction' ELSE 'Superseded' END AS s FROM final UNION ALL SELECT winner, 'Contradiction' FROM final WHERE strategy = 'Ambiguous') SELECT f.id, coalesce(max(s), 'Accepted') AS state FROM facts f LEFT JOIN marks m ON m.id = f.id GROUP BY f.id")
def fact_states(spark, sf_dir):
    """Facts with the state that their conflicts leave."""
    f = tables.facts(spark, sf_dir)
    return facts.apply_states(f, facts.resolve(f, 7 * DAYS)).select("id", "state")


@query(f"WITH {NODES} SELECT id, round(pow(0.5, ({NOW} - timestamp) / {scoring.HALF_LIFE}.0), 9) AS decay_factor FROM nodes WHERE timestamp > 0 AND timestamp <= {NOW} AND pow(0.5, ({NOW} - timestamp) / {scoring.HALF_LIFE}.0) < 0.99")
def temporal_decay(spark, sf_dir):
    """C15/C16."""
    return scoring.decayed(tables.nodes(spark, sf_dir), NOW).select("id", F.round("decay_factor", 9).alias("decay_factor"))


def _mindset_sql(name: str) -> str:
    c, r, d, k = mindset.WEIGHTS[name]
    return f"""WITH {FACTS}, lim AS (SELECT max(timestamp) AS now, max(timestamp) - min(timestamp) AS span FROM facts), n AS (SELECT subject, count(DISTINCT predicate) / 5.0 AS conn FROM facts GROUP BY subject)
SELECT id, round(({c} * source_confidence + {r} * (1 - least(greatest((now - timestamp) / span, 0), 1)) + {d} * 0.0 + {k} * least(conn, 1)) / {c + r + d + k}, 9) AS score FROM facts JOIN n USING (subject), lim"""


def _mindset(name: str):
    def run(spark, sf_dir):
        f = tables.facts(spark, sf_dir)
        span = f.agg(F.max("timestamp").alias("now"), (F.max("timestamp") - F.min("timestamp")).alias("span"))
        linked = f.groupBy("subject").agg((F.countDistinct("predicate") / 5.0).alias("conn"))
        rows = f.join(linked, "subject").join(F.broadcast(span))
        return rows.select("id", F.round(mindset.score_fact(name, "source_confidence", "state", "timestamp", "now", "span", "conn"), 9).alias("score"))

    run.__name__ = f"mindset_score_{name.lower()}"
    run.__doc__ = "C1/C2."
    return run


for _name in mindset.WEIGHTS:
    query(_mindset_sql(_name))(_mindset(_name))

_DETECT = " ".join(f"WHEN regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)') THEN '{name}'" for name, words in mindset.KEYWORDS.items())


@query(f"SELECT conv_id * 1000 + turn AS id, CASE {_DETECT} END AS mindset FROM conversations")
def mindset_detect(spark, sf_dir):
    """C9."""
    return tables.messages(spark, sf_dir).select("id", mindset.detect("content").alias("mindset"))


@query(f"WITH {FACTS}, n AS (SELECT subject, predicate, count(*) AS n FROM facts GROUP BY ALL) SELECT subject, predicate, round(least(ln(1 + n) / ln(6), 1), 9) AS corroboration FROM n")
def corroboration(spark, sf_dir):
    """C8."""
    n = tables.facts(spark, sf_dir).groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return n.select("subject", "predicate", F.round(mindset.corroboration("n", 5), 9).alias("corroboration"))


# --- tenancy -----------------------------------------------------------------------------------


@query(f"WITH {NODES}, s AS (SELECT namespace, count(*) AS total, count_if(node_type = 'Entity')::BIGINT AS entities, count_if(node_type <> 'Entity')::BIGINT AS others, max(timestamp) AS last_activity FROM nodes GROUP BY namespace) SELECT * FROM s")
def namespace_stats(spark, sf_dir):
    """A1."""
    return tenancy.stats(tables.nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT id AS old, 1000000000 + row_number() OVER (ORDER BY id) - 1 AS new FROM nodes WHERE namespace = 'building'")
def namespace_clone_ids(spark, sf_dir):
    """G16/W2."""
    return tenancy.renumbered(tenancy.in_namespace(tables.nodes(spark, sf_dir), "building"), 1_000_000_000)


CLONED = f"""WITH {NODES}, {EDGES}, ids AS (SELECT id AS old, 1000000000 + row_number() OVER (ORDER BY id) - 1 AS new FROM nodes WHERE namespace = 'default')"""


@query(f"{CLONED} SELECT s.new AS source, t.new AS target, edge_type, weight FROM edges JOIN ids s ON s.old = source JOIN ids t ON t.old = target")
def namespace_clone_edges(spark, sf_dir):
    """The induced edges under new ids."""
    return tenancy.clone(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), "default", "copy", 1_000_000_000)[1]


@query("""WITH d AS (SELECT doc_id AS id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key, source FROM documents WHERE source IN ('src0', 'src1')), there AS (SELECT key, min(id) AS there FROM d WHERE source = 'src1' GROUP BY key), here AS (SELECT key, min(id) AS here FROM d WHERE source = 'src0' GROUP BY key)
SELECT id, coalesce(there, here) AS kept FROM d JOIN here USING (key) LEFT JOIN there USING (key) WHERE source = 'src0'""")
def content_dedupe(spark, sf_dir):
    """Documents of one source held against another."""
    nodes = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("namespace"))
    return tenancy.content_map(nodes, "src0", "src1")


@query(f"WITH {NODES} SELECT id, namespace FROM nodes WHERE timestamp > 0 AND {NOW} - timestamp > CASE namespace WHEN '1-urgent' THEN {3650 * DAYS} ELSE {10_000 * DAYS} END AND namespace <> '5-low'")
def retention_expired(spark, sf_dir):
    """F13."""
    policies = spark.createDataFrame([("1-urgent", 3650 * DAYS), ("5-low", 0)], "namespace string, ttl long")
    return tenancy.expired(tables.nodes(spark, sf_dir), NOW, 10_000 * DAYS, policies).select("id", "namespace")


@query(f"WITH {NODES}, {EDGES}, gone AS (SELECT * FROM nodes WHERE namespace = 'building') SELECT count(*) AS memories, count_if(node_type = 'Entity')::BIGINT AS entities, (SELECT count(*) FROM edges WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)) AS edges, string_agg(DISTINCT namespace, ',') AS namespaces FROM gone")
def forget_report(spark, sf_dir):
    """F12/A17."""
    return tenancy.forget_report(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), F.col("namespace") == "building")


@query(f"WITH {NODES} SELECT id, node_type, timestamp FROM nodes WHERE node_type IN ('Event', 'Fact') AND timestamp BETWEEN 820454400 AND 852076800")
def clone_filter(spark, sf_dir):
    """F5/F7."""
    return tenancy.selected(tables.nodes(spark, sf_dir), ["Event", "Fact"], 820_454_400, 852_076_800).select("id", "node_type", "timestamp")


@query(f"WITH {AUDIT} SELECT id, action, method FROM audit WHERE timestamp >= 1704500000 AND action LIKE '%memories%' AND status = 200")
def audit_filter(spark, sf_dir):
    """F9/X21."""
    rows = tables.audit(spark, sf_dir).withColumn("action", tenancy.audit_action())
    return tenancy.audit_rows(rows, start=1_704_500_000, action="memories", status=200).select("id", "action", "method")


@query(f"WITH {AUDIT} SELECT action, method, count(*) AS n FROM audit GROUP BY ALL")
def audit_actions(spark, sf_dir):
    """X21."""
    return tables.audit(spark, sf_dir).withColumn("action", tenancy.audit_action()).groupBy("action", "method").agg(F.count(F.lit(1)).alias("n"))


COSTS = "c AS (SELECT event_type AS provider, ts, floor(value * 10)::BIGINT AS i, floor(value)::BIGINT AS o FROM events)"


@query(f"WITH {COSTS} SELECT date_trunc('month', ts)::VARCHAR AS period, provider, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(i / 1000.0 * 0.5 + o / 1000.0 * 1.5), 6) AS cost FROM c GROUP BY GROUPING SETS ((1, 2), (1))")
def cost_rollup(spark, sf_dir):
    """A11/A12."""
    rows = tables.costs(spark, sf_dir).withColumn("cost", tx.cost("input_tokens", "output_tokens", 0.5, 1.5))
    out = tenancy.cost_totals(rows)
    return out.select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "provider", "calls", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


@query(f"WITH {MESSAGES} SELECT conversation_id, count(*) AS message_count, min(timestamp) AS first_at, max(timestamp) AS last_at, left(arg_min(content, (timestamp, id)), 120) AS preview FROM messages GROUP BY conversation_id")
def conversation_summaries(spark, sf_dir):
    """A3."""
    return tenancy.conversations(tables.messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT * FROM (SELECT id AS source, lead(id) OVER (PARTITION BY conversation_id ORDER BY position, id) AS target, 'NextEpisode' AS edge_type, 0.8::DOUBLE AS weight FROM messages) WHERE target IS NOT NULL")
def chain_edges(spark, sf_dir):
    """W4/W5/S16."""
    return tenancy.chains(tables.messages(spark, sf_dir), "conversation_id", ["position"], 0.8, "NextEpisode")


@query(f"WITH {MESSAGES} SELECT id, conversation_id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY position, id)")
def segment_nav(spark, sf_dir):
    """W3."""
    return tenancy.neighbours_in_order(tables.messages(spark, sf_dir), "conversation_id", "position")


@query(f"WITH {MESSAGES}, t AS (SELECT id, conversation_id, ceil(octet_length(encode(content)) / 4)::BIGINT AS tokens FROM messages) SELECT id, tokens, round(tokens / greatest(sum(tokens) OVER (PARTITION BY conversation_id), 1), 9) AS share FROM t")
def explain_tokens(spark, sf_dir):
    """F18."""
    return tenancy.explained(tables.messages(spark, sf_dir), "conversation_id").select("id", "tokens", F.round("share", 9).alias("share"))


@query(f"WITH {NODES} SELECT id, timestamp FROM nodes WHERE node_type = 'Event' ORDER BY timestamp DESC, id LIMIT 50 OFFSET 25")
def list_page(spark, sf_dir):
    """T3 (Q15): a page, newest first."""
    return tenancy.page(tenancy.of_type(tables.nodes(spark, sf_dir), "event"), 50, 25).select("id", "timestamp")


@query(f"WITH {MESSAGES} SELECT id, conversation_id FROM messages WHERE (contains(lower(content), 'the') OR contains(lower(content), 'de')) AND NOT contains(lower(content), 'zz') AND timestamp BETWEEN 100 AND 90000000 AND author IN ('user')")
def content_filter(spark, sf_dir):
    """F8."""
    rows = tables.messages(spark, sf_dir).withColumn("created_at", F.col("timestamp"))
    return tenancy.content_items(rows, ["the", "de"], ["zz"], 100, 90_000_000, ["user"]).select("id", "conversation_id")


# --- text --------------------------------------------------------------------------------------


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ') AS body FROM pages")
def strip_html(spark, sf_dir):
    """X19."""
    return tables.load(spark, sf_dir, "pages").select("page_id", tx.stripped_html("html").alias("body"))


@query()
def chunk_documents(spark, sf_dir):
    """Sentence chunks of at most 512 bytes (tested against a plain restatement)."""
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks("text")).alias("chunk_index", "content"))


@query("SELECT c_custkey AS id, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 3) || '****' || right(c_name, 4) END AS masked FROM customer")
def mask_keys(spark, sf_dir):
    """X22."""
    return tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.masked("c_name").alias("masked"))


@query("SELECT lower(trim(p_name)) AS key, min(p_partkey) AS id, arg_min(p_name, p_partkey) AS text, max(p_retailprice) AS confidence, count(*) AS mentions FROM part GROUP BY 1")
def entity_dedupe(spark, sf_dir):
    """A10: part names as mentions."""
    m = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.lit(0).alias("start"), F.col("p_name").alias("text"), F.col("p_type").alias("label"), F.col("p_retailprice").alias("confidence"))
    first = m.groupBy(tx.key("text").alias("key")).agg(F.min("text_id").alias("id"))
    return relations.distinct_mentions(m).join(first, "key").select("key", "id", "text", "confidence", "mentions")


_EDGE_CASE = " ".join(f"WHEN p IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in relations.EDGE_OF.items())
_PREDICATES = sorted({name for _, name, _ in relations.PATTERNS} | {"replaces", "next", "contradicts"})


@query(f"WITH n AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), v AS (SELECT unnest({_PREDICATES!r}) AS p) SELECT p AS predicate, event_type, c AS n, CASE {_EDGE_CASE} ELSE 'RelatesTo' END AS edge_type FROM v, n")
def predicate_edge_type(spark, sf_dir):
    """Every predicate, beside the counts of event kinds."""
    n = tables.load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(p) for p in _PREDICATES])).alias("predicate")
    return n.select("event_type", "n", names).select("predicate", "event_type", "n", relations.edge_type("predicate").alias("edge_type"))


_INFER = " ".join(f"WHEN {' OR '.join(f'contains(t, {s!r})' for s in signals)} THEN '{name}'" for signals, name, _ in relations.PATTERNS)


@query(f"WITH m AS (SELECT conv_id * 1000 + turn AS id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM conversations) SELECT id, CASE {_INFER} ELSE 'related_to' END AS predicate FROM m")
def predicate_inference(spark, sf_dir):
    """The first signal of each message."""
    return tables.messages(spark, sf_dir).select("id", relations.predicate("content")["name"].alias("predicate"))


@query("""WITH m AS (SELECT l_orderkey AS text_id, l_linenumber * 60 AS s, l_linenumber * 60 + l_quantity::INT AS e, l_discount + 0.5 AS c FROM lineitem)
SELECT a.text_id, a.s AS a_start, b.s AS b_start, (b.s - a.e)::INT AS distance, round(least(1.0, 0.5 * CASE WHEN b.s - a.e <= 0 THEN 1.0 WHEN b.s - a.e >= 200 THEN 0.0 ELSE 1 - (b.s - a.e) / 200.0 END + 0.2 * sqrt(a.c * b.c)), 9) AS confidence
FROM m a JOIN m b ON a.text_id = b.text_id AND b.s >= a.e AND b.s - a.e <= 200""")
def proximity_confidence(spark, sf_dir):
    """Order lines as mentions, no signal between them."""
    q = F.col("l_linenumber") * 60
    m = tables.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.lit("x").alias("text"), F.lit("y").alias("label"), q.alias("start"), (q + F.col("l_quantity").cast("int")).alias("end"), (F.col("l_discount") + 0.5).alias("confidence"))
    p = relations.pairs(m)
    sure = F.least(F.lit(1.0), 0.5 * relations.proximity("distance") + 0.2 * F.sqrt(F.col("a_confidence") * F.col("b_confidence")))
    return p.select("text_id", "a_start", "b_start", F.col("distance").cast("int").alias("distance"), F.round(sure, 9).alias("confidence"))


# --- resolution and communities ----------------------------------------------------------------


@query("""WITH e AS (SELECT o_custkey AS id, l_suppkey AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM e GROUP BY id), p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey),
x AS (SELECT p.a, p.b, count(*) AS k FROM p JOIN e ea ON ea.id = p.a JOIN e eb ON eb.id = p.b AND eb.member = ea.member GROUP BY ALL)
SELECT p.a, p.b, round(CASE WHEN coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(k, 0) > 0 THEN coalesce(k, 0) / (coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(k, 0)) ELSE 0.0 END, 9) AS jaccard
FROM p LEFT JOIN x USING (a, b) LEFT JOIN n na ON na.id = p.a LEFT JOIN n nb ON nb.id = p.b""")
def jaccard_pairs(spark, sf_dir):
    """Shared suppliers of customers of one nation and segment."""
    c = tables.load(spark, sf_dir, "customer")
    keys = ["c_nationkey", "c_mktsegment"]
    sets = tables.load(spark, sf_dir, "orders").join(tables.load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("id"), F.col("l_suppkey").alias("member"))
    return communities.jaccard_within(sets, c.select(F.col("c_custkey").alias("id"), *keys), keys).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH {TOPK}, e AS (SELECT query_id AS a, id AS b FROM top WHERE rank <= 4 AND query_id <> id), u AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM e GROUP BY ALL), s AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)
SELECT a AS id, count(*) AS degree FROM s GROUP BY a""")
def knn_graph(spark, sf_dir):
    """Degree in the graph of each query's three nearest vectors."""
    top = vectors.topk_many(asked(spark, sf_dir), vectors_of(spark, sf_dir), 4)
    edges = top.where("query_id <> id").select(F.least("query_id", "id").alias("source"), F.greatest("query_id", "id").alias("target")).distinct()
    return graph.degrees(edges)


def knn_edges(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    top = vectors.topk_many(v.select(F.col("id").alias("query_id"), "embedding"), v, 6)
    return top.where("query_id <> id").select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.greatest("score", F.lit(0.0)).alias("weight"))


@query()
def community_labels(spark, sf_dir):
    """Communities of the five-nearest-neighbour graph."""
    return communities.label_propagation(knn_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {PLACES}, e AS (SELECT source AS a, target AS b FROM places UNION SELECT target, source FROM places), walk AS (SELECT a AS root, a AS node FROM e WHERE a % 8 = 0 UNION SELECT w.root, e.b FROM walk w JOIN e ON e.a = w.node) SELECT node AS id, min(component) AS component FROM walk JOIN (SELECT root, min(node) AS component FROM walk GROUP BY root) USING (root) GROUP BY node")
def components(spark, sf_dir):
    """Connected components of customers, suppliers, nations and regions."""
    return graph.connected_components(tables.places(spark, sf_dir))


@query(f"""WITH k AS (SELECT vec_id AS id, label, embedding FROM embeddings WHERE label IS NOT NULL) SELECT b.id AS removed, min(a.id) AS survivor FROM k a JOIN k b ON a.label = b.label AND a.id < b.id WHERE {DOT} >= 0.2 GROUP BY b.id""")
def entity_merge_pairs(spark, sf_dir):
    """The label is the name."""
    e = vectors_of(spark, sf_dir).where("label is not null").select("id", F.col("label").cast("string").alias("content"), "embedding")
    return scoring.merge_pairs(e, 0.2)


@query(f"WITH {NODES}, {EDGES} SELECT source AS id, count(*) AS relations FROM edges WHERE edge_type IN ('RelatesTo', 'CausedBy', 'HasProperty', 'Actor', 'Object', 'Location', 'Companion') AND source IN (SELECT id FROM nodes WHERE node_type = 'Entity') GROUP BY source")
def linked_entities(spark, sf_dir):
    """A23."""
    return training.linked_entities(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))


# --- evaluation --------------------------------------------------------------------------------

EVAL = f"""{TOPK}, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN b.vec_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0),
ideal AS (SELECT query_id, sum(CASE WHEN p <= 10 THEN grade / log2(p + 1.0) ELSE 0 END) AS idcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM rel) GROUP BY query_id),
hit AS (SELECT t.query_id, count(*) AS h, min(rank) AS f, sum(grade / log2(rank + 1.0)) AS dcg FROM top t JOIN rel r ON r.query_id = t.query_id AND r.doc_id = t.id WHERE rank <= 10 GROUP BY t.query_id),
shown AS (SELECT query_id, count(*) AS s FROM top WHERE rank <= 10 GROUP BY query_id),
q AS (SELECT i.query_id, coalesce(h, 0) / n AS recall, coalesce(1.0 / f, 0) AS reciprocal_rank, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, coalesce(h, 0) / s AS precision FROM ideal i LEFT JOIN hit USING (query_id) LEFT JOIN shown USING (query_id)),
scores AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM q)"""


def eval_scores(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    top = vectors.topk_many(asked(spark, sf_dir), v, 10).select("query_id", "rank", F.col("id").alias("doc_id"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label")
    rel = q.join(v.select(F.col("id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0).alias("grade"))
    return evaluation.per_query(top, rel, 10)


@query(f"WITH {EVAL} SELECT query_id, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM scores")
def recall_mrr_ndcg(spark, sf_dir):
    """Vectors of the query's label are relevant."""
    names = ["recall", "reciprocal_rank", "ndcg", "precision", "f1"]
    return eval_scores(spark, sf_dir).select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {EVAL}, c AS (SELECT s.*, label AS category FROM scores s JOIN embeddings e ON e.vec_id = s.query_id) SELECT category, grouping(category)::TINYINT AS overall, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1 FROM c GROUP BY GROUPING SETS ((category), ())")
def category_rollup(spark, sf_dir):
    """A13/A14."""
    label = vectors_of(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("label").alias("category"))
    return evaluation.summary(eval_scores(spark, sf_dir).join(label, "query_id"))


_RANK = ", ".join(f"min(value) FILTER (WHERE rn = round({p} / 100.0 * (n - 1)) + 1) AS p{p}" for p in (50, 95, 99))


@query(f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, {_RANK} FROM r GROUP BY event_type")
def percentile_rank(spark, sf_dir):
    """By nearest rank."""
    return evaluation.nearest_rank(tables.load(spark, sf_dir, "events"), "event_type", "value", [50, 95, 99])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_linear(spark, sf_dir):
    """Interpolated."""
    return evaluation.interpolated(tables.load(spark, sf_dir, "events"), "event_type", "value", [50, 95]).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("WITH r AS (SELECT event_type AS provider, (user_id % 7 <> 0) AS ok, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT provider, round(avg(ok::INT), 6) AS success, round(avg(value), 6) AS mean_latency, count(*) AS samples FROM r WHERE n <= 1000 GROUP BY provider")
def provider_stats(spark, sf_dir):
    """A18."""
    calls = tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), (F.col("user_id") % 7 != 0).alias("ok"), F.col("value").alias("latency"), F.col("ts").alias("timestamp"))
    return evaluation.provider_stats(calls).select("provider", F.round("success", 6).alias("success"), F.round("mean_latency", 6).alias("mean_latency"), "samples")


@query("SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::BIGINT AS rank, event_id, value FROM events QUALIFY rank <= 5")
def topk_per_group(spark, sf_dir):
    """W1/T1."""
    e = tables.load(spark, sf_dir, "events")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")).where("rank <= 5").select("event_type", "rank", "event_id", "value")


# --- retrieval ---------------------------------------------------------------------------------


@query()
def retrieve(spark, sf_dir):
    """Section 3.1: the whole pipeline for every query vector; vectors are attached to nodes by id order."""
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked memories of every twentieth vector over a nearest-neighbour graph of all vectors and its communities."""
    v = vectors_of(spark, sf_dir)
    nodes = v.select("id", F.concat(F.lit("memory "), F.col("id").cast("string")).alias("content"), F.lit("Entity").alias("node_type"), (F.lit(NOW) - F.col("id") * 3600).alias("timestamp"), F.lit("default").alias("namespace"))
    edges = checkpointed(knn_edges(spark, sf_dir).select("source", "target", F.lit("RelatesTo").alias("edge_type"), "weight"))
    return retrieval.retrieve(asked(spark, sf_dir), nodes, edges, v, retrieval.Retrieval(now=NOW, mindset="Convergent"), placed=communities.label_propagation(edges))


# --- exports, model answers, events, pages of rows ---------------------------------------------


@query(f"""WITH {NODES}, {EDGES}, m AS (SELECT o_orderkey * 8 + 5 AS id, o_custkey AS conversation_id FROM orders),
ends AS (SELECT source AS m, target AS e FROM edges UNION SELECT target, source FROM edges),
names AS (SELECT ends.m, string_agg(DISTINCT content, '; ' ORDER BY content) AS entities FROM ends JOIN m ON m.id = ends.m JOIN nodes n ON n.id = ends.e WHERE node_type = 'Entity' GROUP BY ends.m)
SELECT id, conversation_id, coalesce(entities, '') AS entities FROM m LEFT JOIN names ON names.m = m.id""")
def messages_with_entities(spark, sf_dir):
    """A4: all orders as messages, and what they are linked with."""
    messages = tables.load(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8 + 5).alias("id"), F.col("o_custkey").alias("conversation_id"))
    out = tenancy.messages_with_entities(messages, tables.edges(spark, sf_dir), tables.nodes(spark, sf_dir))
    return out.select("id", "conversation_id", F.array_join("entities", "; ").alias("entities"))


@query("""WITH c AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS timestamp, value AS cost FROM events WHERE event_type = 'purchase' AND user_id % 3 = 1 AND floor(epoch(ts))::BIGINT BETWEEN 1704200000 AND 1706000000)
SELECT id, timestamp, round(cost, 6) AS cost, (SELECT count(*) FROM c) AS total_rows, round((SELECT sum(cost) FROM c), 4) AS total_cost FROM c ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 10""")
def cost_page(spark, sf_dir):
    """The second page of one provider's and one model's rows, totals over all of them."""
    e = tables.load(spark, sf_dir, "events")
    costs = e.select(F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("timestamp"), F.col("event_type").alias("provider"), (F.col("user_id") % 3).cast("string").alias("model"), F.col("value").alias("cost"))
    out = tenancy.cost_page(costs, "purchase", "1", 1_704_200_000, 1_706_000_000, 10, 20)
    return out.select("id", "timestamp", F.round("cost", 6).alias("cost"), "total_rows", F.round("total_cost", 4).alias("total_cost"))


@query("""SELECT o_orderkey * 8 + 5 AS source, o_custkey * 8 + 2 AS target, 'Actor' AS edge_type, 1.0::DOUBLE AS weight FROM orders
UNION ALL SELECT l_orderkey * 8 + 5, l_partkey * 8 + 4, 'Object', 1.0 FROM lineitem UNION ALL SELECT l_orderkey * 8 + 5, l_suppkey * 8 + 3, 'Companion', 1.0 FROM lineitem""")
def event_edges(spark, sf_dir):
    """Orders as events, with customer, parts and suppliers in their roles."""
    who = lambda node, role: F.struct(node.alias("node_id"), F.lit(role).alias("role"))
    o, li = tables.load(spark, sf_dir, "orders"), tables.load(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array(who(F.col("l_partkey") * 8 + 4, "Object"), who(F.col("l_suppkey") * 8 + 3, "Companion")))).alias("lines"))
    events = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    participants = F.concat(F.array(who(F.col("o_custkey") * 8 + 2, "Actor")), F.coalesce("lines", F.array().cast("array<struct<node_id:bigint,role:string>>")))
    return graph.event_nodes(events.select((F.col("o_orderkey") * 8 + 5).alias("id"), F.col("o_comment").alias("content") if "o_comment" in o.columns else F.lit("").alias("content"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), participants.alias("participants")))[1]


@query("""SELECT event_id AS text_id, 'user ' || user_id AS subject, event_type AS predicate, CASE WHEN event_id % 3 = 0 THEN least(greatest(round(value, 2) / 100, 0), 1) WHEN event_id % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM events WHERE event_id % 7 <> 0""")
def parse_relations(spark, sf_dir):
    """Answers with words around the array, without a confidence, above 1, and some that are no JSON."""
    e = tables.load(spark, sf_dir, "events")
    body = F.concat(F.lit('[{"subject": "user '), F.col("user_id"), F.lit('", "predicate": "'), F.col("event_type"), F.lit('", "object": "x"'))
    sure = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "confidence": '), (F.round("value", 2) / 100).cast("string"))).when(F.col("event_id") % 3 == 1, "").otherwise(', "confidence": 7')
    end = F.when(F.col("event_id") % 7 == 0, "}, oops]").otherwise('}, {"subject": 5, "predicate": "p", "object": "o"}]')
    rows = e.select(F.col("event_id").alias("text_id"), F.concat(F.lit("Sure: "), body, sure, end, F.lit(" done")).alias("output"))
    return relations.parse_relations(rows).select("text_id", "subject", "predicate", "confidence")


@query("""SELECT conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'envelope' WHEN 1 THEN 'sessions' WHEN 2 THEN 'session' END AS form, CASE WHEN conv_id % 4 < 3 THEN n END AS messages FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def parse_sessions(spark, sf_dir):
    """Exports in the three forms that are known, and in one that is not."""
    from graphloom.sources import interop

    c = tables.load(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    session = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), "messages"))
    wrap = lambda a, b: F.concat(F.lit(a), session, F.lit(b))
    value = F.when(F.col("conv_id") % 4 == 0, wrap('{"sessions": [', "]}")).when(F.col("conv_id") % 4 == 1, wrap("[", "]")).when(F.col("conv_id") % 4 == 2, session).otherwise('{"other": 1}')
    out = interop.parse_sessions(per.select(F.struct("conv_id", value.alias("value")).alias("r")).select("r.*"))
    count = F.aggregate("sessions", F.lit(0), lambda a, s: a + F.size(s["messages"])).cast("long")
    # exports carry no id of their own: the session's, where there is one
    return out.where("form is not null").select(F.col("sessions")[0]["session_id"].cast("long").alias("id"), "form", count.alias("messages"))


ORACLES["parse_sessions"] = "SELECT * FROM (" + ORACLES["parse_sessions"] + ") WHERE form IS NOT NULL"


@query()
def document_chunks(spark, sf_dir):
    """Pages, then paragraphs, then sentences of all documents (tested against a plain loop)."""
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id"), F.posexplode(tx.document_chunks("text", 512)).alias("chunk_index", "content"))
