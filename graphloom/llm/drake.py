"""Centroid clustering by Lloyd rounds with Drake's adaptive bounds, in exact integer arithmetic.

A vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to
its ``tracked`` next nearest centroids, and one lower bound for all the others.  When centroids
move, bounds move with them: the upper one grows by its centroid's way, each lower one shrinks by
its own, the remainder by the longest way.  A vector whose upper bound stays below every lower
bound keeps its centroid unseen; else its own distance is measured, then the tracked centroids
whose bound is not above it, and only if the remainder is not above it, all of them.

Bounds are doubles rounded to their safe side and certify only a strict order, so ties are always
settled by exact integer distances (the smaller number wins).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, written

TRACKED = 4
EXACT = 1 << 22  #: to this size, products of 64 components are exact in doubles
LIMIT = 1 << 27  #: beyond it a squared distance of 64 components may not fit a long
EDGE = 1e-12
STATE = "cluster int, upper double, near array<int>, lower array<double>, rest double, scanned long"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT // max(1, x.shape[1] // 64):
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the centroid that ``at`` names for it."""
    diff = x - c[at]
    return (diff * diff).sum(1)


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + EDGE) + EDGE


def _down(v: np.ndarray) -> np.ndarray:
    return v * (1 - EDGE) - EDGE


def ranked(x: np.ndarray, c: np.ndarray, tracked: int) -> list[np.ndarray]:
    """State of rows of which nothing is known: every distance is measured."""
    d = distances(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
    last = tracked + 1
    rest = _down(root[:, last]) if len(c) > last else np.full(len(x), np.inf)
    return [order[:, 0], _up(root[:, 0]), order[:, 1:last], _down(root[:, 1:last]), rest, np.full(len(x), len(c), np.int64)]


def moved_state(x: np.ndarray, c: np.ndarray, way: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """The state after centroids moved by ``way`` (upper bounds of their ways) to ``c``."""
    at, upper, near, lower, rest, scanned = [s.copy() for s in state]
    upper = _up(upper + way[at])
    lower = _down(lower) - _up(way[near])
    rest = _down(rest) - _up(way.max())
    floor = np.minimum(lower.min(1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= floor)
    if not len(open_):
        return [at, upper, near, lower, rest, scanned]
    exact = own_distances(x[open_], c, at[open_])
    upper[open_] = _up(np.sqrt(exact.astype(float)))
    scanned[open_] += 1
    still = upper[open_] >= floor[open_]
    open_, exact = open_[still], exact[still]
    whole = rest[open_] <= upper[open_]
    rows = open_[whole]
    if len(rows):
        for kept, new in zip((at, upper, near, lower, rest), ranked(x[rows], c, near.shape[1])):
            kept[rows] = new
        scanned[rows] += len(c)
    rows, exact = open_[~whole], exact[~whole]
    if len(rows):
        asked = lower[rows] <= upper[rows, None]
        r, j = np.nonzero(asked)
        d = np.full(asked.shape, np.iinfo(np.int64).max)
        d[r, j] = own_distances(x[rows[r]], c, near[rows[r], j])
        scanned[rows] += asked.sum(1)
        number = np.column_stack([at[rows], near[rows]])
        d = np.column_stack([exact, d])
        bound = np.column_stack([_down(np.sqrt(exact.astype(float))), np.where(asked, _down(np.sqrt(d[:, 1:].astype(float))), lower[rows])])
        best = np.lexsort((number, d), axis=1)[:, 0]
        line = np.arange(len(rows))
        at[rows] = number[line, best]
        upper[rows] = _up(np.sqrt(d[line, best].astype(float)))
        others = np.ones(number.shape, bool)
        others[line, best] = False
        number, bound = number[others].reshape(len(rows), -1), bound[others].reshape(len(rows), -1)
        order = np.argsort(bound, axis=1, kind="stable")
        near[rows], lower[rows] = np.take_along_axis(number, order, 1), np.take_along_axis(bound, order, 1)
    return [at, upper, near, lower, rest, scanned]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT} have no exact distances")
    return x


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(values) + 1) * width, width) if width else np.zeros(len(values) + 1), pa.int32()), pa.array(values.ravel(), kind))


def _stepper(c: np.ndarray, way: np.ndarray | None, tracked: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), c.shape[1])
            if way is None:
                state = ranked(x, c, tracked)
            else:
                flat = [batch.column(n) for n in ("cluster", "upper", "near", "lower", "rest", "scanned")]
                state = [a.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if pa.types.is_list(a.type) else a.to_numpy(zero_copy_only=False) for a in flat]
                state = moved_state(x, c, way, state)
            at, upper, near, lower, rest, scanned = state
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.array(at, pa.int32()), pa.array(upper, pa.float64()), _lists(near, pa.int32()), _lists(lower, pa.float64()), pa.array(rest, pa.float64()), pa.array(scanned, pa.int64())],
                ["id", "x", "cluster", "upper", "near", "lower", "rest", "scanned"],
            )

    return step


def _sums(k: int, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, at = _matrix(batch.column("x"), dim), batch.column("cluster").to_numpy()
            for one in np.unique(at):
                total[one] += x[at == one].sum(0)
            n += np.bincount(at, minlength=k)
        used = np.flatnonzero(n)
        rows = [np.repeat(used, dim), np.tile(np.arange(dim), len(used)), total[used].ravel(), np.repeat(n[used], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["cluster", "at", "total", "n"])

    return run


def _centroids(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact means; a task sends one row per component of a cluster it has seen."""
    k, dim = c.shape
    sums = state.select("x", "cluster").mapInArrow(_sums(k, dim), "cluster int, at int, total long, n long")
    out = c.copy()
    for r in sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.at] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, tracked: int = TRACKED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned)`` of every vector that takes part.

    Vectors with exactly ``dim`` components, none null or non-finite, take part as integers
    ``floor(scale * x)``; others give no row.  The first centroids are the ``k`` vectors of the
    smallest sha256 of ``1:<id>`` (all of them if there are fewer; equal ids in the order of
    their vectors; null ids come last), moved ``rounds`` times to the floor of the mean of their
    vectors.  Repeated rows count as often as they stand; other columns are ignored; an empty
    table gives no rows; components whose distances would not fit a long are an error.

    A round is one pass over a written table of vectors and bounds and a sum of k x dim numbers a
    task, so nothing is shuffled but those sums, whatever the size of a cluster; the driver holds
    the ``k`` centroids.  ``scanned`` counts the exact distances measured for a vector, which is
    ``k`` a round without bounds.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("int"))
    sound = (F.size(vec_col) == dim) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))
    hashed = kept.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    start = [r.x for r in hashed.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, x array<int>, {STATE}"
    c = np.array(start, np.int64).reshape(-1, dim)
    if not len(start):
        empty = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("scanned"))
        return _with_totals(empty.limit(0), c, id_col)
    state, path = written(kept.mapInArrow(_stepper(c, None, tracked), schema), "drake")
    for _ in range(rounds):
        new = _centroids(state, c)
        way = _up(np.sqrt(own_distances(new, c, np.arange(len(c))).astype(float)))
        c, old = new, path
        state, path = written(state.mapInArrow(_stepper(c, way, tracked), schema), "drake")
        discard(spark, old)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = own_distances(_matrix(batch.column("x"), dim), c, batch.column("cluster").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d, pa.int64()), batch.column("scanned")], ["id", "cluster", "distance", "scanned"])

    out = state.select("id", "x", "cluster", "scanned").mapInArrow(measured, f"id {id_type}, cluster int, distance long, scanned long")
    out, _ = written(out, "drake-distances")
    discard(spark, path)
    return _with_totals(out, c, id_col)


def _with_totals(rows: DataFrame, c: np.ndarray, id_col: str) -> DataFrame:
    """``rows`` with the sums of their cluster and of all; the joined side has a row a centroid."""
    spark = rows.sparkSession
    texts = spark.createDataFrame([(i, ",".join(map(str, one.tolist()))) for i, one in enumerate(c)], "cluster int, text string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    per = per.join(texts.select("cluster", F.sha2("text", 256).alias("centroid_sha256")), "cluster").crossJoin(total)
    out = rows.join(F.broadcast(per), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
