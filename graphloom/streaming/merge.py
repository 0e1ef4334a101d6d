"""A keyed table that batches are merged into, bucket by bucket, behind a commit pointer.

A table is a folder with ``data/version=<batch>/bucket=<b>/`` and ``commits/<batch>``.  A key lives in
the bucket of its hash; a batch rewrites only the buckets that it touches and commits a small
pointer that names the version of every bucket.  Readers follow the last pointer, so a batch that
fails before its commit changes nothing, and one that is run again is either written anew or,
if its pointer stands, skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import delete

BUCKETS = 64
KEEP = 2  #: commits whose versions stay readable


class Commits:
    """The pointers of one table, in any file system that Spark can open."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.folder = self._at(f"{self.path}/commits")
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self.folder) if s.getPath().getName().isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._at(f"{self.path}/commits/{number}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, pointer: dict) -> None:
        """The pointer appears whole or not at all: it is written aside and renamed."""
        aside = self._at(f"{self.path}/commits/.{number}")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        stream.close()
        if not self.fs.rename(aside, self._at(f"{self.path}/commits/{number}")):
            raise RuntimeError(f"commit {number} of {self.path} was made elsewhere")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folders(path: str, versions: dict, only: set[int] | None = None) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in versions.items() if only is None or int(b) in only]


def read_table(spark: SparkSession, path: str, key: dict | None = None) -> DataFrame | None:
    """The table as of its last commit; None before the first.  ``key`` reads the one bucket that can hold it."""
    commits = Commits(spark, path)
    numbers = commits.numbers()
    if not numbers:
        return None
    pointer = commits.read(numbers[-1])
    only = None
    if key is not None:
        schema = spark.createDataFrame([], pointer["schema"]).schema
        row = spark.createDataFrame([tuple(key[k] for k in pointer["keys"])], ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in pointer["keys"]))
        only = {row.select(bucket_of(pointer["keys"], pointer["buckets"])).first()[0]}
    folders = _folders(path, pointer["versions"], only)
    rows = spark.read.schema(pointer["schema"]).parquet(*folders) if folders else spark.createDataFrame([], pointer["schema"])
    return rows if key is None else rows.where(F.lit(True) if not key else _equals(key))


def _equals(key: dict) -> Column:
    out = F.lit(True)
    for name, value in key.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def merging(path: str, keys: list[str], sequence: str = "seq", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function: of each key the row of the largest ``sequence`` stays, whatever order batches come in.

    Of equal sequences the newer batch's row wins, inside a batch the greatest row.  A removal is a row
    with a mark of its own: it stays, so that an older write that comes later does not bring the
    key back, and ``live`` leaves it out.  Keys may be null.
    ``buckets`` holds for the table's whole life.
    """

    def into(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, path)
        numbers = commits.numbers()
        if number in numbers:
            return
        pointer = commits.read(numbers[-1]) if numbers else {"versions": {}, "buckets": buckets, "keys": keys, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)}
        if pointer["buckets"] != buckets or pointer["keys"] != keys:
            raise ValueError(f"{path} has {pointer['buckets']} buckets by {pointer['keys']}")
        new = batch.withColumn("_from", F.lit(1)).withColumn("bucket", bucket_of(keys, buckets))
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most `buckets`
        old = _folders(path, pointer["versions"], touched)
        rows = new
        if old:
            before = spark.read.schema(pointer["schema"]).parquet(*old).withColumn("_from", F.lit(0)).withColumn("bucket", bucket_of(keys, buckets))
            rows = before.unionByName(new, allowMissingColumns=True)
        columns = batch.columns
        last = F.max(F.struct(F.col(sequence).alias("_seq"), F.col("_from").alias("_new"), F.struct(*columns).alias("_row"))).alias("_last")
        kept = rows.groupBy("bucket", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last).select("bucket", "_last._row.*")
        kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        pointer["versions"] |= {str(b): number for b in touched}
        commits.write(number, pointer)
        _clear(spark, commits, path)

    return into


def live(table: DataFrame, deleted: str) -> DataFrame:
    """Rows that are no markers of a removed key."""
    return table.where(~F.coalesce(F.col(deleted), F.lit(False)))


def _clear(spark: SparkSession, commits: Commits, path: str) -> None:
    """Removes pointers before the last ``KEEP`` ones and the bucket folders that no kept pointer names."""
    numbers = commits.numbers()
    kept = [commits.read(n)["versions"] for n in numbers[-KEEP:]]
    named = {(int(b), v) for versions in kept for b, v in versions.items()}
    for number in numbers[:-KEEP]:
        for bucket, version in commits.read(number)["versions"].items():
            if (int(bucket), version) not in named:
                delete(spark, f"{path}/data/version={version}/bucket={bucket}")
        delete(spark, f"{path}/commits/{number}")
