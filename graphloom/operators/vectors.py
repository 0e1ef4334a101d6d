"""Vector search (V1, V6, J16), in cells (V5), fusion (V8, V9, J11) and score limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import vector
from graphloom.operators.blocks import TILE_COLUMNS, TILE_ROWS, matrix, met

BLOCK_ROWS = 1_024
#: Numbers of a block of vectors at most, unless ``BLOCK_ROWS`` vectors have more: 32,768 vectors of 64 components.
BLOCK_COMPONENTS = 2_097_152
HALF_DIGIT = 0.5e-12
#: Most rows that the cells of the approximate search are learnt from.
FIT_ROWS = 50_000


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """V1: exact top-k by dot product for one vector; only vectors of its length; ``k`` = 0 is empty."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size(vector_col) == len(query)).select(id_col, vector.dot(vector_col, q).alias("score"))
    if min_similarity is not None and min_similarity > 0:  # F3
        scored = scored.where(F.col("score") >= min_similarity)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _rows(rows: DataFrame, id_col: str, vector_col: str, *extra: str, single: bool = False) -> DataFrame:
    """``id, v, dim`` in double precision; rows without a vector are left out.  With ``single``, vectors of floats stay so."""
    floats = single and rows.schema[vector_col].dataType.elementType == T.FloatType()
    v = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if floats else F.transform(vector_col, lambda x: x.cast("double"))).alias("v"), *extra)
    return v.withColumn("dim", F.size("v"))


def blocks(v: DataFrame, keys: list[str], prefix: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """One row per block of about ``block_rows`` vectors of one key, and how many blocks each key has."""
    count = v.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n"))  # one row a length, or a length and cell
    dealt = v.join(count, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    packed = dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("id", "v")).alias(f"{prefix}_rows"))
    return packed.withColumnRenamed("block", f"{prefix}_block"), count


def _most_rows() -> Column:
    """Rows of a block: ``BLOCK_COMPONENTS`` numbers, but at least ``BLOCK_ROWS`` vectors."""
    return F.greatest(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_COMPONENTS) / F.greatest(F.max("dim"), F.lit(1))))


def _sent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_rows`` as they go to their blocks."""
    return rows.select(*keys, "id", "v")


def _best(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None, infinite: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row of ``a @ b.T``: ``row, column, score``; scores equal to 12 digits go to the first column.

    Columns are taken tile by tile; from the second tile on only what beats a row's k-th score is looked at.
    ``own`` holds the column that a row must not find, or -1.
    """
    least = np.full(len(a), -np.inf)
    row, column, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for start in range(0, len(b), TILE_COLUMNS):
        s = a @ b[start : start + TILE_COLUMNS].T
        s[np.isnan(s) if infinite else ~np.isfinite(s)] = -np.inf
        if own is not None:
            hit = np.nonzero((own >= start) & (own < start + s.shape[1]))[0]
            s[hit, own[hit] - start] = -np.inf
        bar = least + HALF_DIGIT
        if k < s.shape[1]:
            bar = np.where(np.isneginf(least), np.round(np.partition(s, -k, axis=1)[:, -k], 12) - HALF_DIGIT, bar) if np.isneginf(least).any() else bar
        i, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
        if not len(i):
            continue
        row, column, score = np.concatenate((row, i)), np.concatenate((column, j + start)), np.concatenate((score, s[i, j]))
        order = np.lexsort((column, -np.round(score, 12), row))
        row, column, score = row[order], column[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < k
        row, column, score, place = row[keep], column[keep], score[keep], place[keep]
        full = place == k - 1
        least[row[full]] = np.round(score[full], 12)
    return row, column, score


def _block_topk(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, query_col: str, id_col: str, min_similarity: float | None, exclude_self: bool, block_rows: int) -> DataFrame:
    """Top-k over pairs of blocks of equal keys: a matrix product a pair, tile by tile, k rows a query from each."""
    names = [query_col, id_col, "score"]

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(q) and len(v) and k > 0:
            order = np.argsort(v["id"].to_numpy(), kind="stable")
            a, b, qi, vi = matrix(q["v"]), matrix(v["v"])[order], q["id"].to_numpy(), v["id"].to_numpy()[order]
            own = None
            if exclude_self:
                at = np.minimum(np.searchsorted(vi, qi), len(vi) - 1)
                own = np.where(vi[at] == qi, at, -1)
            for start in range(0, len(a), TILE_ROWS):
                part = slice(start, start + TILE_ROWS)
                row, column, score = _best(a[part], b, k, None if own is None else own[part], min_similarity is not None)
                keep = slice(None) if min_similarity is None else score >= min_similarity
                out.append((qi[part][row[keep]], vi[column[keep]], score[keep]))
        return pa.table([np.concatenate(x) for x in zip(*out)], names=names)

    best = met(_sent(queries, keys), _sent(vectors, keys), keys, _most_rows(), run, f"`{query_col}` long, `{id_col}` long, score double", block_rows)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 12)), id_col))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def topk_many(queries: DataFrame, vectors: DataFrame, k: int, query_col: str = "query_id", id_col: str = "id", vector_col: str = "embedding", query_vector_col: str = "embedding", min_similarity: float | None = None, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, id, score, rank)``, exact top-k of every query vector against all vectors.

    Queries and vectors are dealt in blocks of bounded size; a pair of blocks is one group, whose
    matrix product is made tile by tile and keeps k rows a query.  Blocks are large, so a vector is
    sent to few of them (``blocks.met``) and no length gathers in one task.  Scores equal to 12
    digits go to the least id.
    """
    return _block_topk(_rows(queries, query_col, query_vector_col, single=True), _rows(vectors, id_col, vector_col, single=True), ["dim"], k, query_col, id_col, min_similarity, exclude_self, block_rows)


def fit_cells(vectors: DataFrame, cells: int, fit_rows: int = FIT_ROWS, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """V5: ``(cell, centre)``: unit centres of spherical k-means, learnt from at most ``fit_rows`` rows by hash of their id.

    Null and zero vectors and vectors with non-finite components are not learnt from, nor are
    lengths other than the most frequent one.  No vectors give no cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    clean = _rows(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    common = clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "cell long, centre array<double>"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = clean.where(F.col("dim") == common["dim"]).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    model = KMeans(k=max(2, cells), seed=42, distanceMeasure="cosine", maxIter=12).fit(sample.select(array_to_vector("v").alias("features")))
    centres = [c / max(float(np.linalg.norm(c)), 1e-300) for c in model.clusterCenters()]
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], schema)


def celled(vectors: DataFrame, cells: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """V5: the index: every vector ``(id, embedding, cell)`` with the nearest cell; write it partitioned by cell to keep it.

    A vector of another length than the centres' has no cell and is not in the index.
    """
    home = topk_many(vectors, cells, 1, id_col, "cell", "centre", vector_col).select(id_col, "cell")
    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).join(home, id_col)


def topk_cells(queries: DataFrame, index: DataFrame, cells: DataFrame, k: int, probes: int, query_col: str = "query_id", id_col: str = "id", vector_col: str = "embedding", query_vector_col: str = "embedding", min_similarity: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """V5: approximate top-k: each query meets the vectors of its ``probes`` nearest cells only; the scores are exact.

    A cell is cut into blocks as in ``topk_many``, so a hot cell is no single task.
    """
    near = topk_many(queries, cells, probes, query_col, "cell", "centre", query_vector_col).select(query_col, "cell")
    asked = queries.join(near, query_col)
    return _block_topk(_rows(asked, query_col, query_vector_col, "cell", single=True), _rows(index, id_col, vector_col, "cell", single=True), ["dim", "cell"], k, query_col, id_col, min_similarity, False, block_rows)


def fuse(text: DataFrame, visual: DataFrame, text_weight: float, visual_weight: float, k: int | None = None) -> DataFrame:
    """Full outer merge of two result sets ``(id, score)``; a missing side scores 0."""
    t, v = F.coalesce("text_score", F.lit(0.0)), F.coalesce("visual_score", F.lit(0.0))
    both = text.select("id", F.col("score").alias("text_score")).join(visual.select("id", F.col("score").alias("visual_score")), "id", "full_outer")
    source = F.when((t > 0) & (v > 0), "Fused").when(v > 0, "Visual").otherwise("Text")
    out = both.select("id", (t * text_weight + v * visual_weight).alias("score"), source.alias("source"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def max_over_frames(results: DataFrame) -> DataFrame:
    """The best score of an id over several searches."""
    return results.groupBy("id").agg(F.max("score").alias("score"))


def within(rows: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``, a < b: pairs of ``(id, embedding)`` of one length whose dot product is at least ``least``, by pairs of blocks.

    Each block meets every block, tile by tile, so a vector moves once per block of the other side.
    """
    vectors = _sent(_rows(rows, "id", "embedding", single=True), ["dim"])

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(q) and len(v):
            a, b, ai, bi = matrix(q["v"]), matrix(v["v"]), q["id"].to_numpy(), v["id"].to_numpy()
            for x in range(0, len(a), TILE_ROWS):
                for y in range(0, len(b), TILE_COLUMNS):
                    i, j = np.nonzero(a[x : x + TILE_ROWS] @ b[y : y + TILE_COLUMNS].T >= least)
                    keep = ai[i + x] < bi[j + y]
                    out.append((ai[i + x][keep], bi[j + y][keep]))
        return pa.table([np.concatenate(x) for x in zip(*out)], names=["a", "b"])

    return met(vectors, vectors, ["dim"], _most_rows(), run, "a long, b long", block_rows).distinct()


def projected(rows: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """V7: ``(id, embedding)`` carried into another space: ``v x weights + bias``, scaled to length 1 (zero stays zero).

    ``weights`` has a row per component of the given vectors and is sent with the function;
    vectors of another length and those with null components give no row.
    """
    width = weights.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ weights
            x = x if bias is None else x + bias
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "embedding"])

    sound = _rows(rows, id_col, vector_col).where((F.col("dim") == width) & F.forall("v", lambda c: c.isNotNull())).select("id", "v")
    return sound.mapInArrow(run, "id long, embedding array<double>").withColumnRenamed("id", id_col)


def cross_modal(queries: DataFrame, text: DataFrame, visual: DataFrame, weights: np.ndarray, k: int, text_weight: float = 0.5, visual_weight: float = 0.5, min_similarity: float | None = None) -> DataFrame:
    """V7, V8: image queries against an index of texts and one of images at once: ``(query_id, id, score, source, rank)``.

    ``queries`` ``(query_id, embedding)`` live in the visual space.  They search ``visual`` as they
    are and ``text`` after the projection by ``weights``; what both find is fused by weight, a
    missing side counting 0.
    """
    seen = topk_many(queries, visual, k, min_similarity=min_similarity).select("query_id", "id", F.col("score").alias("visual_score"))
    read = topk_many(projected(queries, weights, id_col="query_id"), text, k, min_similarity=min_similarity).select("query_id", "id", F.col("score").alias("text_score"))
    t, v = F.coalesce("text_score", F.lit(0.0)), F.coalesce("visual_score", F.lit(0.0))
    both = read.join(seen, ["query_id", "id"], "full_outer")
    source = F.when((t > 0) & (v > 0), "Fused").when(v > 0, "Visual").otherwise("Text")
    out = both.select("query_id", "id", (t * text_weight + v * visual_weight).alias("score"), source.alias("source"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
