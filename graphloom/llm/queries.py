"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bundles, decontaminate, drake, embedding_dedup, licenses, minhash, mixing, pii, quality, spelling, sstable, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised ones too: template windows and slot consistency."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to a mix of sources to target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by weighted five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), max_tokens=2048)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans and what induced patterns add."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to sorted shards and read back."""
    return sstable.token_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def fold(parts: int, held: int) -> Column:
    """Whether a row is held out: its id's checksum falls in one of ``parts`` folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; fold 1 of 3 is held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3, 1), threshold=0.7)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text, in the order of their rules."""
    out = licenses.recognise(table(spark, sf_dir, "documents"))
    return out.withColumn("licenses", F.concat_ws(",", "licenses"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label at a cosine of 0.98."""
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; fold 0 of 5 is held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0), threshold=0.3)


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 16 centroids after three rounds, for every vector of 64 sound components."""
    return drake.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64).drop("scanned")


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from seekable archives."""
    return bundles.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words' count, its form and its root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2 * source_size AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
opened AS (
  SELECT arg_min(level, cap / w) AS level FROM ordered WHERE level * w <= cap),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM opened) * w, cap::DOUBLE)) AS target FROM ordered),
laid AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT
            ELSE (budget // source_size) * size + least(greatest(budget % source_size - start, 0), size) END AS taken
FROM laid
"""

LINK_SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS root, vec_id AS node FROM embeddings UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(r.node) AS component_id, e.vec_id = min(r.node) AS kept
FROM embeddings e JOIN reach r ON r.root = e.vec_id GROUP BY e.vec_id
"""



def _cluster_sql(rounds: int = 3) -> str:
    sql = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x, sha256('1:' || vec_id::VARCHAR) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM kept QUALIFY c < 16)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m
  FROM kept k, c{i} c GROUP BY r)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT m.c AS c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, 65) t(i) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(u.x, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY c) u ON u.c = c.c)"""
    return sql + f"""
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia,
       sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = m.c
"""


CLUSTER_SQL = _cluster_sql()

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.html = p.html
"""

SPELLING_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT key, run, n, hex(encode(key)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) t(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.head || c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.head || c.rest),
best AS (
  SELECT a AS word, count(*) AS n_near, min({'m': -w.n, 'w': encode(w.word)}) AS m FROM pairs p JOIN words w ON w.word = p.b GROUP BY a),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.m.m >= 2 * w.n THEN decode(b.m.w) END AS form, CASE WHEN -b.m.m >= 2 * w.n THEN -b.m.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, r.at AS root, f.n_near, f.form_n
FROM formed f JOIN walk r ON r.word = f.word JOIN formed e ON e.word = r.at AND e.form IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_token_shards": op6_token_shards,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_quality": op10_quality,
    "op11_drake_clusters": op11_drake_clusters,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op2_mix_sources": MIX_SQL, "op9_embedding_dedup": LINK_SQL, "op11_drake_clusters": CLUSTER_SQL, "op12_warc_bundles": WARC_SQL, "op13_spelling_variants": SPELLING_SQL}
