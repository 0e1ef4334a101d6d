"""Incremental jobs (R1, R4-R9): file streams, upserts, streaming contradictions, retention, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import facts as fact_ops
from graphloom.operators import graph


def files(spark: SparkSession, folder: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(folder)


def sync(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is new, then stop; offsets move only after ``into`` returned."""
    return stream.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    whole = [p.getName() for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def upserting(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last write per key.

    Each batch writes a folder ``version=<number>`` from the last complete one before it, so a failed
    write leaves the old one and a batch that is run again gives the same.  If there is none, though
    it is not the first batch, rows would be lost: that is an error.
    """

    def into(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = f"{path}/version={number}"
        before = [v for v in _versions(spark, path) if v < number]
        if number and not before:
            raise RuntimeError(f"no complete version before {number} in {path}")
        old = spark.read.parquet(f"{path}/version={max(before)}") if before else None
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col("seq")).alias("r")).select("r.*")
        (last if old is None else graph.upsert(old, last, keys)).write.mode("overwrite").parquet(new)

    return into


CONFLICT = T.StructType(
    [
        T.StructField("subject", T.LongType()), T.StructField("predicate", T.StringType()), T.StructField("winner", T.LongType()), T.StructField("loser", T.LongType()), T.StructField("strategy", T.StringType()),
    ]
)
STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("object", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("timestamp", T.LongType())])


def contradictions(stream: DataFrame, seconds: int = fact_ops.TEMPORAL_SECONDS, gap: float = fact_ops.CONFIDENCE_GAP) -> DataFrame:
    """Conflicts of each new fact with the accepted fact of its subject and predicate, held as state per key."""
    import pandas as pd

    def step(key, frames, state):
        kept = state.get if state.exists else None
        out = []
        for frame in frames:
            for r in frame.sort_values(["timestamp", "id"]).itertuples(index=False):
                new = (int(r.id), str(r.object), float(r.source_confidence), int(r.timestamp))
                if kept is None or kept[1] == new[1]:
                    kept = kept or new
                    continue
                if abs(new[3] - kept[3]) > seconds:
                    strategy, wins = "Temporal", new[3] > kept[3]
                elif abs(new[2] - kept[2]) > gap:
                    strategy, wins = "Confidence", new[2] > kept[2]
                else:
                    strategy, wins = "Ambiguous", False
                winner, loser = (new, kept) if wins else (kept, new)
                out.append((key[0], key[1], winner[0], loser[0], strategy))
                kept = winner
        if kept is not None:
            state.update(kept)
        yield pd.DataFrame(out, columns=["subject", "predicate", "winner", "loser", "strategy"])

    return stream.groupBy("subject", "predicate").applyInPandasWithState(step, CONFLICT, STATE, "append", "NoTimeout")


def windowed(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and kind, with a watermark for late ones."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
