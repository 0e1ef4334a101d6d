"""The exact seeded shuffle, in parallel.

A Fisher-Yates pass swaps place i with place j(i) <= i for i from the last down to 1, j drawn from
a linear congruential generator.  The generator can jump ahead, so every j is computed on its
own.  After swap i place i is settled, so what stands there came by a chain: whatever stood at
j(i) was put there by the next later-numbered swap with the same j, and so on up to a place that no
swap had touched.  Chains are short (about log n) and are followed by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import checkpointed, dropped

# Fixed values of the generator: multiplier, increment, and the bits that are dropped.
FACTOR, STEP, SHIFT = 6364136223846793005, 1442695040888963407, 33
MASK = (1 << 64) - 1


def _draws(n: int, seed: int):
    """A batch function from place i to (i, j(i)): the state after n - i steps, by doubling the step."""
    jumps = []
    factor, step = FACTOR, STEP
    for _ in range(64):
        jumps.append((factor, step))
        factor, step = factor * factor & MASK, (factor * step + step) & MASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            steps, state = n - i, np.full(len(i), seed & MASK, np.uint64)
            with np.errstate(over="ignore"):
                for bit, (factor, step) in enumerate(jumps):
                    if not (n >> bit):
                        break
                    asked = (steps >> bit & 1).astype(bool)
                    state[asked] = state[asked] * np.uint64(factor) + np.uint64(step)
            j = (state >> np.uint64(SHIFT)) % (i + 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j.astype(np.int64))], ["i", "j"])

    return run


def permutation(spark, n: int, seed: int, max_rounds: int = 64) -> DataFrame:
    """``(place, source)``: which of the items 0 .. n - 1 stands at each place after the shuffle."""
    places = spark.range(0, n).withColumnRenamed("id", "i")
    if n < 2:
        return places.select(F.col("i").alias("place"), F.col("i").alias("source"))
    swaps = checkpointed(spark.range(1, n).withColumnRenamed("id", "i").mapInArrow(_draws(n, seed), "i long, j long"))
    # place p holds, until swap p, what the first swap above p with j = p put there
    ends = checkpointed(swaps.where("i <> j").groupBy(F.col("j").alias("p")).agg(F.min("i").alias("to")))
    for _ in range(max_rounds):
        step = ends.join(ends.select(F.col("p").alias("to"), F.col("to").alias("next")), "to", "left")
        after = checkpointed(step.select("p", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        settled = after.where("moved").isEmpty()
        dropped(ends)
        ends = after
        if settled:
            break
    else:
        raise RuntimeError(f"chains are not settled after {max_rounds} rounds")
    later = F.lead("i").over(Window.partitionBy("j").orderBy("i"))  # a target is drawn about log n times
    taken = swaps.select("i", "j", later.alias("by"))
    first = swaps.where("j = 0").agg(F.min("i").alias("by")).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "by")
    taken = taken.unionByName(first)
    return taken.join(ends.select(F.col("p").alias("by"), "to"), "by", "left").select(F.col("i").alias("place"), F.coalesce("to", "by", "j").alias("source"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position``, 0 and up in the given order: sorted by range, counted per part, no part is all rows."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    return dealt.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part").withColumn("position", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def shuffled(rows: DataFrame, order: list[str], seed: int = 42, ratio: float = 0.9) -> DataFrame:
    """``rows`` with ``place`` (after the shuffle of their order) and ``split``: the first round(n x ratio) places train.

    ``order`` must tell rows apart for a result that is always the same; nulls come first; of an
    empty table nothing comes.
    """
    items = checkpointed(numbered(rows, *order))
    n = items.count()
    placed = permutation(rows.sparkSession, n, seed).withColumnRenamed("source", "position")
    cut = min(n, int(np.floor(np.float32(n) * np.float32(ratio) + 0.5)))  # halves up, in single precision
    split = F.when(F.col("place") < cut, "train").otherwise("validation")
    return items.join(placed, "position").drop("position").withColumn("split", split)
