"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A new folder name in ``spark.checkpoint.dir``; in a temporary folder only in local mode without that setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(folder)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    A written table has the size of its files.  ``checkpoint()`` keeps the estimate of the plan it
    cuts, a product over its joins, whose digits multiply from round to round of a loop.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


#: Bytes of input files for each task of ``dealt``, and the rows of ids up to which ``spread`` sends them to every executor.
FILE_BYTES_A_TASK, MOST_SPREAD = 4 << 20, 2_000_000


def file_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` is read from, each counted once."""
    spark = df.sparkSession
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def dealt(df: DataFrame, *keys: str, bytes_a_task: int = FILE_BYTES_A_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its input files ask for.

    Spark sizes tasks by compressed bytes, of which ids take few; sorts and hash tables of a task
    then grow with the table.  What a task gets here does not.  Small inputs are left as they are.
    """
    tasks = -(-file_bytes(df) // bytes_a_task)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def spread(ids: DataFrame, most: int = MOST_SPREAD) -> DataFrame:
    """``ids`` with a broadcast hint if they are at most ``most`` rows of numbers; else as they are, for a join by shuffle."""
    if any(not isinstance(f.dataType, T.NumericType) for f in ids.schema):
        return ids
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``checkpointed`` wrote, once nothing reads them any more."""
    for table in tables:
        delete(table.sparkSession, table.table_path)
