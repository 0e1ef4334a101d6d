"""V5: approximate search by product codes in an inverted file, with exact scores for the best few.

A vector is filed under its nearest coarse centre, and what is left of it after the centre is
written as ``parts`` bytes, one a stretch of components: the number of the nearest entry of that
stretch's book.  A query is scored against codes by table lookups, so the search reads ``parts``
bytes a vector instead of the vector; only its best ``rerank`` candidates are scored exactly, where
their vectors are: pairs of query and candidate are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.blocks import TILE_COLUMNS, matrix, met

FIT_ROWS = 50_000  #: most vectors that centres and books are learnt from
PARTS, ENTRIES, ROUNDS = 16, 256, 10
#: Queries of a block, codes that a block of queries holds, vectors of a block, and pairs that are scored at once.
QUERY_ROWS, HELD, BLOCK_VECTORS, SCORED = 256, 8_000_000, 32_768, 50_000
PAIRED_QUERIES = 8_192  #: rows of a block whose candidates are rows of the result: a twentieth of the pairs of two blocks


@dataclass(frozen=True)
class Codes:
    """Coarse centres (cells x dim) and, for each stretch of components, the entries of its book."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def stretches(self) -> list[tuple[int, int]]:
        at = np.cumsum([0] + [b.shape[1] for b in self.books])
        return list(zip(at[:-1], at[1:]))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Plain k-means of a bounded sample; an empty group keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        n = np.bincount(home, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of vectors whose components are all there and finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def fit(vectors: DataFrame, cells: int, parts: int = PARTS, fit_rows: int = FIT_ROWS, id_col: str = "id", vector_col: str = "embedding", seed: int = 42) -> Codes | None:
    """Centres and books from at most ``fit_rows`` vectors of the commonest length, by hash of the id; None without vectors."""
    rows = _sound(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    sample = rows.where(F.size("v") == common.dim).orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow()
    x = sample.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, common.dim)
    centres = _means(x, cells, seed)
    left = x - centres[_nearest(x, centres)]
    return Codes(centres, [_means(part, ENTRIES, seed + 1 + i) for i, part in enumerate(np.array_split(left, min(parts, common.dim), axis=1))])


def coded(vectors: DataFrame, codes: Codes, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The index ``(id, cell, code)``; vectors of another length than the centres' are not in it.  Keep it written by cell."""
    where = codes.stretches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, codes.dim)
            cell = _nearest(x, codes.centres)
            left = x - codes.centres[cell]
            code = np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(where, codes.books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "cell", "code"])

    rows = _sound(vectors, id_col, vector_col).where(F.size("v") == codes.dim)
    return rows.mapInArrow(run, "id long, cell int, code binary")


def _lookups(x: np.ndarray, codes: Codes, probes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each query: whether it looks into a cell, its score with each centre and with each entry of each book.

    Summed without a matrix product, so a score does not depend on what else is in the block.
    """
    centre = np.einsum("qd,cd->qc", x, codes.centres, optimize=False)
    probed = np.zeros(centre.shape, bool)
    np.put_along_axis(probed, np.argsort(-centre, axis=1, kind="stable")[:, :probes], True, axis=1)
    return probed, centre, [np.einsum("qd,cd->qc", x[:, a:b], book, optimize=False) for (a, b), book in zip(codes.stretches(), codes.books)]


def _near(found: tuple, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Scores of every query with every code; minus infinity in cells that a query does not look into."""
    probed, centre, parts = found
    score = centre[:, cell]
    for i, part in enumerate(parts):
        score += part[:, code[:, i]]
    score[~probed[:, cell]] = -np.inf
    return score


def _bytes(code: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1)


class _Best:
    """The ``most`` best ``(near, id)`` of one query, ties to the least id: cut whenever twice as many are held."""

    def __init__(self, most: int):
        self.most, self.bar, self.held, self.parts = most, -np.inf, 0, []

    def add(self, near: np.ndarray, ids: np.ndarray) -> None:
        keep = (near >= self.bar) & (near > -np.inf)
        self.parts.append((near[keep], ids[keep]))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.most:
            self.cut()

    def cut(self) -> None:
        near, ids = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0), np.empty(0, np.int64))
        if len(near) > self.most:
            self.bar = np.partition(near, len(near) - self.most)[len(near) - self.most]
            over, at = np.flatnonzero(near > self.bar), np.flatnonzero(near == self.bar)
            keep = np.concatenate((over, at[np.argsort(ids[at], kind="stable")[: self.most - len(over)]]))
            near, ids = near[keep], ids[keep]
        self.parts, self.held = [(near, ids)], len(near)

    def last(self) -> tuple[float, int, int]:
        """The least score held, the largest id that has it, and how many are held."""
        self.cut()
        near, ids = self.parts[0]
        return (float(near.min()), int(ids[near == near.min()].max()), len(near)) if len(near) else (np.inf, -1, 0)


def bars(queries: DataFrame, index: DataFrame, codes: Codes, probes: int, rerank: int) -> DataFrame:
    """``(query_id, v, near, last, candidates)``: of each query ``(query_id, embedding)`` the ``rerank``-th best code of its ``probes`` cells.

    Its candidates are the codes of those cells that score more than ``near``, or as much under an
    id up to ``last``.  A block of queries sees the codes pass by once; it holds at most about
    ``HELD`` of them, and no pair is shuffled.
    """
    asked = _sound(queries, "query_id", "embedding").where(F.size("v") == codes.dim)
    blocks = max(1, -(-asked.count() // max(1, min(QUERY_ROWS, HELD // max(1, 2 * rerank)))))
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("code"))
    right = index.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "id", F.lit(None).cast("array<double>").alias("v"), "cell", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, found, best = None, [], [], None, []

        def done() -> pa.RecordBatch:
            ends = [b.last() for b in best] or [(np.inf, -1, 0)] * len(ids)
            columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64())), *(pa.array([e[i] for e in ends], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "v", "near", "last", "candidates"])

        for batch in batches:
            block, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if block[lo] != at:
                    if ids:
                        yield done()
                    at, ids, rows, found, best = block[lo], [], [], None, []
                if side[lo] == 0:
                    ids += part.column(2).to_pylist()
                    rows += list(part.column(3).flatten().to_numpy().reshape(len(part), -1))
                elif ids:
                    if found is None:
                        found, best = _lookups(np.array(rows), codes, probes), [_Best(rerank) for _ in ids]
                    near = _near(found, part.column(4).to_numpy(), _bytes(part.column(5)))
                    own = part.column(2).to_numpy()
                    for b, scores in zip(best, near):
                        b.add(scores, own)
        if ids:
            yield done()

    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "side")
    return dealt.mapInArrow(run, "query_id long, v array<double>, near double, last long, candidates long")


def _passing(found: tuple, cell: np.ndarray, code: np.ndarray, ids: np.ndarray, near: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates among a tile of codes: row of the query, and code."""
    s = _near(found, cell, code)
    return np.nonzero((s > near[:, None]) | ((s == near[:, None]) & (ids[None, :] <= last[:, None])))


def candidates(queries: DataFrame, index: DataFrame, codes: Codes, probes: int, rerank: int, block_rows: int = BLOCK_VECTORS) -> DataFrame:
    """``(query_id, id)``: for each query ``(query_id, embedding)`` the ``rerank`` best codes of its ``probes`` cells."""
    return candidates_over(bars(queries, index, codes, probes, rerank), index, codes, probes, block_rows)


def candidates_over(barred: DataFrame, index: DataFrame, codes: Codes, probes: int, block_rows: int = BLOCK_VECTORS) -> DataFrame:
    """``candidates`` of queries whose bars are known."""
    one = F.lit(0).alias("one")
    left = barred.where("candidates > 0").select(one, F.col("query_id").alias("id"), "v", "near", "last")

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(q) and len(v):
            x, qi, vi, near, last, cell, code = matrix(q["v"]), q["id"].to_numpy(), v["id"].to_numpy(), q["near"].to_numpy(), q["last"].to_numpy(), v["cell"].to_numpy(), _bytes(v["code"])
            for start in range(0, len(x), QUERY_ROWS):
                part = slice(start, start + QUERY_ROWS)
                found = _lookups(x[part], codes, probes)
                for a in range(0, len(vi), TILE_COLUMNS):
                    tile = slice(a, a + TILE_COLUMNS)
                    i, j = _passing(found, cell[tile], code[tile], vi[tile], near[part], last[part])
                    out.append((qi[part][i], vi[tile][j]))
        return pa.table([np.concatenate(z) for z in zip(*out)], names=["query_id", "id"])

    return met(left, index.select(one, "id", "cell", "code"), ["one"], min(block_rows, PAIRED_QUERIES), run, "query_id long, id long")


def topk(queries: DataFrame, vectors: DataFrame, index: DataFrame, codes: Codes, k: int, probes: int, rerank: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` of each query's ``rerank`` candidates, by exact dot product; ties to the least id."""
    return topk_over(bars(queries, index, codes, probes, rerank), vectors, index, codes, k, probes, id_col, vector_col)


def topk_over(barred: DataFrame, vectors: DataFrame, index: DataFrame, codes: Codes, k: int, probes: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``topk`` of queries whose bars are known: blocks of them meet blocks of vectors and codes, and keep k rows a query.

    A vector goes once to each block of queries; candidates are found again by their scores and only those are scored exactly.
    """
    one = F.lit(0).alias("one")
    left = barred.where("candidates > 0").select(one, F.col("query_id").alias("id"), "v", "near", "last")
    right = index.join(_sound(vectors, id_col, vector_col), "id").select(one, "id", "v", "cell", "code")

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(q) and len(v):
            x, y, qi, vi = matrix(q["v"]), matrix(v["v"]), q["id"].to_numpy(), v["id"].to_numpy()
            near, last, cell, code = q["near"].to_numpy(), q["last"].to_numpy(), v["cell"].to_numpy(), _bytes(v["code"])
            for start in range(0, len(x), QUERY_ROWS):
                part = slice(start, start + QUERY_ROWS)
                found, held = _lookups(x[part], codes, probes), []
                for a in range(0, len(y), TILE_COLUMNS):
                    tile = slice(a, a + TILE_COLUMNS)
                    i, j = _passing(found, cell[tile], code[tile], vi[tile], near[part], last[part])
                    score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[part][i[b : b + SCORED]], y[tile][j[b : b + SCORED]]) for b in range(0, len(i), SCORED))])
                    held.append((qi[part][i], vi[tile][j], score))
                own, ids, score = (np.concatenate(z) for z in zip(*held))
                order = np.lexsort((ids, -score, own))
                own, ids, score = own[order], ids[order], score[order]
                keep = np.arange(len(own)) - np.searchsorted(own, own, "left") < k
                out.append((own[keep], ids[keep], score[keep]))
        return pa.table([np.concatenate(z) for z in zip(*out)], names=["query_id", "id", "score"])

    best = met(left, right, ["one"], BLOCK_VECTORS, run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
