"""Pairs of rows with equal keys, a block of one side against a block of the other, with the work of a pair of blocks in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that a key's right side is cut into at least, if it has rows enough, so that tasks share the work.
SPREAD, LEAST_ROWS = 16, 1_024
#: Rows of a block whose pairs all are results, or are compared by sets; groups of fewer rows than ``SMALL`` are joined instead.
PAIRED_ROWS, SMALL = 1_024, 256
#: Rows of a block that meets blocks of its own table, the values in its sets and vectors, and the blocks a smaller group is cut into.
WITHIN_ROWS, WITHIN_VALUES, FEW = 16_384, 4_000_000, 4
#: Scores that are held at once, and matches of members.
TILE_ROWS, TILE_COLUMNS, MATCHES = 1_024, 4_096, 4_000_000


def met(left: DataFrame, right: DataFrame, keys: list[str], most_rows: int | Column, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``run`` over every pair of blocks of rows ``(*keys, id, ...)`` of equal keys.

    A block has about ``most_rows`` rows at most.  A row is sent once to each block of the other
    side: up to ``most_rows`` rows on the left and ``SPREAD`` blocks on the right, what is moved
    grows with the rows, and beyond that with the square over ``most_rows``.
    """
    count = F.count(F.lit(1))
    few = left.groupBy(*keys).agg(F.ceil(count / most_rows).alias("_n_left"))
    many = right.groupBy(*keys).agg(F.greatest(F.ceil(count / most_rows), F.least(F.ceil(count / least_rows), F.lit(SPREAD))).alias("_n_right"))
    sizes = few.join(many, keys)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(sizes, keys).withColumn("_left", own("_n_left")).withColumn("_right", every("_n_right")).drop("_n_left", "_n_right")
    b = right.join(sizes, keys).withColumn("_right", own("_n_right")).withColumn("_left", every("_n_left")).drop("_n_left", "_n_right")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of their own, as both sides may be one table
    pair = [*keys, "_left", "_right"]
    return a.groupBy(*pair).cogroup(b.groupBy(*pair)).applyInArrow(run, schema)


def paired(rows: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """Rows ``(*keys, id, ...)`` once for each block of their group, with the two blocks that meet, ``_low`` and ``_high``, and their own."""
    count = F.count(F.lit(1))
    n = F.greatest(F.ceil(count / WITHIN_ROWS), F.ceil(F.sum(values) / WITHIN_VALUES), F.least(F.ceil(count / LEAST_ROWS), F.lit(FEW)))
    out = rows.join(rows.groupBy(*keys).agg(n.alias("_n")), keys).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return out.select(*rows.columns, "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))


def within(rows: DataFrame, keys: list[str], values: Column, run: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run`` over every pair of rows ``(*keys, id, ...)`` of equal keys, each pair of different ids once.

    ``run`` gets a tile of each side and which of their pairs are asked; pairs leave a task tile by
    tile, so blocks are large: a row is sent once to each block of its group.  ``values`` is what a
    row holds in sets and vectors.
    """
    tile = PAIRED_ROWS

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        own, same = t["_own"].to_numpy(), t["_low"][0] == t["_high"][0]
        low = t.filter(pa.array(own == t["_low"][0].as_py())).combine_chunks()
        high = low if same else t.filter(pa.array(own == t["_high"][0].as_py())).combine_chunks()
        for i in range(0, len(low), tile):
            for j in range(i if same else 0, len(high), tile):
                a, b = low.slice(i, tile), high.slice(j, tile)
                asked = a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
                yield from run(a, b, np.triu(asked) if same and i == j else asked).combine_chunks().to_batches()

    pair = [*keys, "_low", "_high"]  # dealt by it, as the rows may still lie by key from the join
    return paired(rows, keys, values).repartition(*pair).groupBy(*pair).applyInArrow(tiles, schema)


def kinds(sets: list) -> tuple[list, np.ndarray]:
    """The distinct sets, and which of them each set is."""
    found = {}
    key = lambda x: tuple(sorted(x)) if x.dtype == object else (x.dtype.str, np.sort(x).tobytes())
    at = np.array([found.setdefault(key(np.asarray(x)), len(found)) for x in sets], np.int64)
    first = np.unique(at, return_index=True)[1]
    return [sets[i] for i in first], at


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length in double precision; a null component is not a number."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def common(a: list, b: list) -> np.ndarray:
    """How many members each set of ``a`` shares with each of ``b``, by the places of equal members."""
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.asarray(s) for s in sets if len(s)] or [np.empty(0, np.int64)]))
    (ai, am), (bi, bm) = flat(a), flat(b)
    order = np.argsort(bm, kind="stable")
    bi, bm = bi[order], bm[order]
    low, high = np.searchsorted(bm, am, "left"), np.searchsorted(bm, am, "right")
    out = np.zeros(len(a) * len(b), np.int64)
    ends = np.cumsum(high - low)
    at = 0
    while at < len(am):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MATCHES, "right")))
        n = high[at:to] - low[at:to]
        places = np.repeat(low[at:to] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        where, times = np.unique(np.repeat(ai[at:to], n) * len(b) + bi[places], return_counts=True)
        out[where] += times
        at = to
    return out.reshape(len(a), len(b))


def jaccard(a: list, b: list) -> np.ndarray:
    """Jaccard similarity of each set of ``a`` with each of ``b``; 0 where both are empty."""
    shared = common(a, b)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(hops, start, goal, paths)`` of a block of starts and a block of goals, a tile at a time: sums over the nodes at which both stand.

    Rows ``(hops, kind, a, b, n)`` of one ``hops``: kind 0, n walks from the start ``a`` to the node
    ``b``; 1, n walks from the goal ``a`` to the node ``b``; 2, n paths from ``a`` to ``b`` besides.
    """
    t = pa.Table.from_batches(batches)
    kind, a, b, n = (t[c].to_numpy() for c in ("kind", "a", "b", "n"))
    starts, goals = np.unique(a[kind != 1]), np.unique(np.concatenate((a[kind == 1], b[kind == 2])))
    side = lambda k, ends: (np.searchsorted(ends, a[kind == k]), b[kind == k], n[kind == k])
    at_goal, node, times = side(1, goals)
    order = np.argsort(node, kind="stable")
    at_goal, node, times = at_goal[order], node[order], times[order]
    forth, apart = side(0, starts), side(2, starts)
    step = max(1, TILE_ROWS * TILE_COLUMNS // max(1, len(goals)))
    for low in range(0, len(starts), step):
        own = starts[low : low + step]
        out = np.zeros((len(own), len(goals)), np.int64)
        here, where, walks = (c[(forth[0] >= low) & (forth[0] < low + step)] for c in forth)
        for x in np.unique(where):
            column = slice(*np.searchsorted(node, [x, x + 1]))
            out[np.ix_(here[where == x] - low, at_goal[column])] += walks[where == x][:, None] * times[column][None, :]
        here, where, walks = (c[(apart[0] >= low) & (apart[0] < low + step)] for c in apart)
        out[here - low, np.searchsorted(goals, where)] += walks
        _, same, also = np.intersect1d(own, goals, assume_unique=True, return_indices=True)
        out[same, also] = 0
        out = out.ravel()
        found = np.flatnonzero(out)
        i, j = np.divmod(found, len(goals))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t["hops"][0].as_py(), np.int32)), pa.array(own[i]), pa.array(goals[j]), pa.array(out[found])], names=["hops", "start", "goal", "paths"])
