"""Helpers shared by the training-data operators: shared-folder storage and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset (local tests) a
    temporary folder is made, which in local mode every task can see.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if set_dir is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_dir)
    return set_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, and the table's path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, of which a loop of small rounds makes little:
    each round's files, some for every task, would stay.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """Jobs run inside send Python batches of about ``size`` bytes, not of a number of rows; a longer row stands alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``edges``; ``component`` is the smallest id reachable.

    Alternating large-star and small-star steps over (u > v) edges: each is an aggregate with
    map-side combine and a join on the vertex, so a hub of millions of neighbours is split by the
    adaptive skew join and never gathered in one task.  Every round is checkpointed; what is not
    settled after ``max_rounds`` is an error.  Edges with a null end and self-loops are dropped;
    an empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = e.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct()
    e = checkpointed(e)
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        freed(e.sparkSession)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    star = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return star.unionByName(roots)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes; else as it is.

    Rows of fixed width count by their columns, others by their length as JSON.
    """
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema)
    length = F.lit(8 * len(df.columns)) if fixed else F.octet_length(F.to_json(F.struct(*df.columns)))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(length)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def text_batches(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``limit`` characters each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def chunked(array: Column, size: int) -> Column:
    """An array (a column or a lambda's variable) as an array of slices of ``size`` elements; an empty one has none."""
    count = F.ceil(F.size(array) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda c: F.slice(array, c * size + 1, F.lit(size))))


def running(lengths: Column, size: int = 256) -> Column:
    """Sums of the elements before each one, by slices: no step copies more than a slice or the list of slices."""

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        before = let(totals, lambda t: F.transform(t, lambda _, c: F.aggregate(F.slice(t, F.lit(1), c), F.lit(0), lambda a, x: a + x)))
        inside = lambda p, b: F.aggregate(
            p,
            F.struct(b.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        return F.flatten(F.zip_with(parts, before, inside))

    return F.coalesce(let(lengths, lambda n: let(chunked(n, size), of)), F.array().cast("array<int>"))
