"""Vectors kept by cell on disk, changed where they are touched.

A table has a folder per cell of a coarse quantiser (``operators.codes``), with the vector and its
code.  A search reads the folders of the cells it probes; a change rewrites the folders that lose or
gain a vector, by dynamic partition overwrite, and removes those that become empty.  Nodes live
in a table of their own: clearing a vector leaves its node, and a vector without a node gets a
stub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import codes
from graphloom.storage import checkpointed, delete, dropped

ROW = "id long, embedding array<double>, code binary, cell int"


def placed(vectors: DataFrame, book: codes.Codes) -> DataFrame:
    """``id, embedding, code, cell``; vectors of another length than the quantiser's, null ones and such with null or non-finite components have no place."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rows.join(codes.coded(rows, book), "id").select("id", "embedding", "code", "cell")


def build(vectors: DataFrame, path: str, book: codes.Codes) -> None:
    """Writes the table; ids must be unique.  A hot cell is split over several files."""
    placed(vectors, book).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def read(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """The table, or only the folders of ``cells``."""
    rows = spark.read.schema(ROW).parquet(path)
    return rows if cells is None else rows.where(F.col("cell").isin(cells))


def change(spark: SparkSession, path: str, book: codes.Codes, put: DataFrame | None = None, clear: DataFrame | None = None) -> set[int]:
    """Puts vectors ``(id, embedding)`` in place of those of their ids and clears those of ``clear`` ``(id)``; gives the cells that were rewritten.

    Old cells are found by a scan of the ids alone.  What is put counts over what is cleared, and
    of several vectors of one id the greatest; a vector that has no place clears its id.  The new
    folders are made aside first, so a change that fails before it is moved in leaves the table as
    it was, and one that is made again gives the same.
    """
    touched = clear.select(F.col("id").cast("long").alias("id")) if clear is not None else spark.createDataFrame([], "id long")
    new = spark.createDataFrame([], ROW)
    if put is not None:
        one = put.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("embedding").alias("embedding"))
        touched, new = touched.unionByName(one.select("id")), placed(one, book)
    touched, new = checkpointed(touched.distinct()), checkpointed(new)
    old = read(spark, path).select("id", "cell").join(touched, "id", "left_semi").select("cell")
    cells = {r.cell for r in old.unionByName(new.select("cell")).distinct().collect()}  # at most the quantiser's
    if not cells:
        return cells
    after = checkpointed(read(spark, path, sorted(cells)).join(touched, "id", "left_anti").unionByName(new))
    full = {r.cell for r in after.select("cell").distinct().collect()}
    if full:
        after.hint("rebalance", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)
    for cell in cells - full:
        delete(spark, f"{path}/cell={cell}")
    dropped(touched, new, after)
    return cells


def with_stubs(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """``nodes`` and an empty node for each vector that has none: null content, type Entity, time 0, namespace default."""
    lone = vectors.select("id").distinct().join(nodes.select("id"), "id", "left_anti")
    stub = {"node_type": F.lit("Entity"), "timestamp": F.lit(0).cast("long"), "namespace": F.lit("default")}
    columns = [F.col("id") if f.name == "id" else stub.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema]
    return nodes.unionByName(lone.select(*columns))
