"""Facts: conflicts, their resolution and the edges that record them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules.
TEMPORAL_SECONDS = int(365.25 * 86_400)
CONFIDENCE_GAP = 0.3


def conflicts(facts: DataFrame, first_only: bool = False) -> DataFrame:
    """Pairs of an accepted earlier fact and a later one of the same subject and predicate, but another object.

    A fact is later by (timestamp, id).  ``first_only`` keeps the earliest accepted one per later fact (Q10).
    A subject and predicate with many facts is an equi-join that the adaptive skew join splits.
    """
    columns = ["id", "object", "source_confidence", "timestamp", "state"]
    old = facts.where("state = 'Accepted'").select("subject", "predicate", *[F.col(c).alias(f"old_{c}") for c in columns])
    new = facts.select("subject", "predicate", *[F.col(c).alias(f"new_{c}") for c in columns])
    if first_only:
        old = _first_two(old)
    later = (F.col("new_timestamp") > F.col("old_timestamp")) | ((F.col("new_timestamp") == F.col("old_timestamp")) & (F.col("new_id") > F.col("old_id")))
    if not first_only:
        return old.join(new, ["subject", "predicate"]).where(later & (F.col("old_object") != F.col("new_object")))
    pairs = old.join(new, ["subject", "predicate"])
    pairs = pairs.withColumn("old", F.when(F.col("first.old_object") != F.col("new_object"), F.col("first")).otherwise(F.col("second")))
    return pairs.select("subject", "predicate", "old.*", *[f"new_{c}" for c in columns]).where(later & (F.col("old_object") != F.col("new_object")))


def _first_two(old: DataFrame) -> DataFrame:
    """One row per subject and predicate: its earliest fact ``first``, and ``second``, the earliest of another object.

    One of them is the earliest fact with another object than any given one, so no pairs are made.
    """
    keys, rows = ["subject", "predicate"], [c for c in old.columns if c.startswith("old_")]
    sound = old.where("old_object is not null and old_timestamp is not null")
    per = sound.groupBy(*keys, F.col("old_object").alias("_object")).agg(F.min(F.struct("old_timestamp", "old_id", F.struct(*rows).alias("row"))).alias("e"))
    first = per.groupBy(*keys).agg(F.min("e").alias("first"))
    second = per.join(first, keys).where(F.col("e.row.old_object") != F.col("first.row.old_object")).groupBy(*keys).agg(F.min("e").alias("second"))
    return first.join(second, keys, "left").select(*keys, F.col("first.row").alias("first"), F.col("second.row").alias("second"))


def resolution(seconds: int = TEMPORAL_SECONDS, gap: float = CONFIDENCE_GAP) -> Column:
    """``struct<strategy, winner, loser, winner_state, loser_state>`` of an old and a new fact; ties favour the old one."""
    apart = F.abs(F.col("new_timestamp") - F.col("old_timestamp")) > seconds
    surer = F.abs(F.col("new_source_confidence") - F.col("old_source_confidence")) > gap
    new_wins = F.when(apart, F.col("new_timestamp") > F.col("old_timestamp")).when(surer, F.col("new_source_confidence") > F.col("old_source_confidence")).otherwise(False)
    strategy = F.when(apart, "Temporal").when(surer, "Confidence").otherwise("Ambiguous")
    open_ = ~apart & ~surer
    return F.struct(
        strategy.alias("strategy"), F.when(new_wins, F.col("new_id")).otherwise(F.col("old_id")).alias("winner"), F.when(new_wins, F.col("old_id")).otherwise(F.col("new_id")).alias("loser"),
        F.when(open_, "Contradiction").otherwise("Accepted").alias("winner_state"), F.when(open_, "Contradiction").otherwise("Superseded").alias("loser_state"),
    )


def resolve(facts: DataFrame, seconds: int = TEMPORAL_SECONDS, gap: float = CONFIDENCE_GAP, first_only: bool = False) -> DataFrame:
    return conflicts(facts, first_only).withColumn("r", resolution(seconds, gap)).select("subject", "predicate", "old_id", "new_id", "r.*")


def conflict_edges(resolved: DataFrame) -> DataFrame:
    """C14: a ConflictsWith edge per pair and, unless ambiguous, a Supersedes edge from winner to loser (fact ids)."""
    edge = lambda kind: F.struct(F.lit(kind).alias("edge_type"))
    kinds = F.filter(F.array(edge("ConflictsWith"), F.when(F.col("strategy") != "Ambiguous", edge("Supersedes"))), lambda e: e.isNotNull())
    return resolved.select(F.col("winner").alias("source"), F.col("loser").alias("target"), "strategy", F.explode(kinds).alias("e")).select("source", "target", "e.edge_type", "strategy")


def apply_states(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts with the state that their last lost or open conflict gives them; facts are never deleted."""
    marks = resolved.select(F.col("loser").alias("id"), F.col("loser_state").alias("s")).unionByName(resolved.where("strategy = 'Ambiguous'").select(F.col("winner").alias("id"), F.col("winner_state").alias("s")))
    worst = marks.groupBy("id").agg(F.max("s").alias("s"))  # Superseded over Contradiction
    return facts.join(worst, "id", "left").withColumn("state", F.coalesce("s", "state")).drop("s").select(*facts.columns)
