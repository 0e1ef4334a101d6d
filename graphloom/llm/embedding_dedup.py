"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells.

Exactness.  Vectors at cosine >= t are at most ``d = sqrt(2 - 2t)`` apart once normalised, so if
two such vectors have different home cells, each lies within ``d`` of the plane between the two
centroids.  A vector is therefore also a guest in every cell of smaller number whose plane is
that near; each linked pair then meets exactly once, in the smaller of its two home cells.

Cells are cut into blocks and pairs of blocks into tiles of bounded size, so a cell that holds a
third of all rows is many tasks.  A tile returns, for each of its rows, a count of links and the
smallest id of its group within the tile: no pair is ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import checkpointed, connected_components

THRESHOLD = 0.98
SAMPLE_ROWS = 20_000
CELL_ROWS, MAX_CELLS = 2_000, 1_024
BLOCK_ROWS = 1_024
SLACK = 1e-7


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows, by cosine; farthest-first start, empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    centroids = [x[rng.integers(len(x))]]
    near = x @ centroids[0]
    while len(centroids) < k:
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        centroids.append(x[at])
        near = np.maximum(near, x @ x[at])
    c = np.array(centroids)
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def fit_cells(vectors: DataFrame, rows: int, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> np.ndarray | None:
    """Centroids from a bounded sample (the first ``sample_rows`` by a hash of the id) of the vectors of the commonest length."""
    got = vectors.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()["vec"]
    if not len(got):
        return None
    sizes = np.array([len(v) for v in got])
    dim = np.bincount(sizes).argmax()
    x = np.array([v for v in got if len(v) == dim], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = int(min(max_cells, max(1, -(-rows // cell_rows)), max(1, len(x) // 10)))
    return spherical_kmeans(x, k)


def cells_of(x: np.ndarray, centroids: np.ndarray, reach: float) -> list[list[int]]:
    """Per unit row its home cell first, then the smaller-numbered cells in which it is a guest."""
    cosines = x @ centroids.T
    home = cosines.argmax(1)
    gap = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
    depth = cosines[np.arange(len(x)), home][:, None] - cosines  # 2 planes' distance x gap
    near = (depth <= (reach + SLACK) * gap[home]) & (np.arange(len(centroids))[None, :] < home[:, None])
    return [[int(h), *np.flatnonzero(row).tolist()] for h, row in zip(home, near)]


def _tile(ids: np.ndarray, copies: np.ndarray, home: np.ndarray, block: np.ndarray, x: np.ndarray, threshold: float, same: bool) -> list[tuple[int, int, int]]:
    linked = x @ x.T >= threshold
    linked &= home[:, None] | home[None, :]  # two guests meet in a smaller cell, if at all
    np.fill_diagonal(linked, False)
    if not same:
        linked &= block[:, None] != block[None, :]  # pairs inside a block belong to the block's own tile
    links = linked @ copies
    has = links > 0
    if not has.any():
        return []
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    return list(zip(ids[has].tolist(), links[has].tolist(), root[has].tolist()))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Compared are vectors of equal, non-null label and equal length, by cosine in double
    precision.  Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows with a null id or label link with nothing (0 links, own id, kept).  Equal vectors are
    one class with a count: each still counts the others as links.  Rows that repeat an id count
    as vectors of their own and share a component.  Other columns are ignored; an empty table
    gives an empty result.
    """
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("vec"))
    inf = float("inf")
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
    fit &= F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (c < inf) & (c > -inf)) & F.exists("vec", lambda c: c != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(fit, F.lit(False)), F.md5(F.concat(F.col("label"), F.lit(":"), F.col("vec").cast("string")))))
    classes = checkpointed(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    centroids = fit_cells(classes, classes.count(), sample_rows, cell_rows)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list[int]] = [[0]] * batch.num_rows
            vec = batch.column(0).to_pylist()
            ours = [i for i, x in enumerate(vec) if len(x) == centroids.shape[1]]
            if ours:
                x = np.array([vec[i] for i in ours])
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, c in zip(ours, cells_of(x, centroids, reach)):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["row", "cells"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = members.values
                vec = part.field("vec")
                x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = _tile(*(part.field(n).to_numpy(zero_copy_only=False) for n in ("id", "copies", "home", "block")), x, threshold, same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["id", "links", "root"])

    if centroids is None:
        found = classes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
    else:
        struct = F.struct("id", "copies", "label", "vec")
        kind = classes.select(struct.alias("row")).schema["row"].dataType.simpleString()
        placed = classes.select("vec", struct.alias("row")).mapInArrow(assign, f"row {kind}, cells array<int>")
        placed = placed.select("row.*", F.col("cells")[0].alias("own"), F.explode("cells").alias("cell"))
        cell = ["label", "dim", "cell"]
        placed = checkpointed(placed.withColumn("dim", F.size("vec")))
        sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        # the side with one row a cell is joined by the cell; a hot cell is split by the adaptive join
        dealt = placed.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = dealt.select("*", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        member = F.struct("id", "copies", (F.col("own") == F.col("cell")).alias("home"), "block", "vec")
        tiles = dealt.groupBy(*cell, "i", "j").agg(F.collect_list(member).alias("members"))
        tiles = tiles.where(F.size("members") > 1).select((F.col("i") == F.col("j")).alias("same"), "members")
        found = tiles.mapInArrow(compare, "id long, links long, root long")
    found = checkpointed(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("id <> root"), "id", "root")
    per = classes.select("key", "id", "copies").join(links, "id", "left").join(groups, "id", "left")
    per = per.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "key").join(per, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
