"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a word budget; its rows are laid out by a hash-random key and taken from the
start of that order, whole epochs first, until the budget is met exactly.  The order is held as
hash-range buckets of about sqrt(rows) rows: running sums of bucket totals, then running sums
inside a bucket.  So a source with a third of all rows is spread over many buckets, and neither
step sees more than about sqrt(rows) rows of a source in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; null text has none."""
    words = F.split(text, "[\\x20\\x09-\\x0D]+", -1)
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(words, ""))).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, n_rows, target)``: weighted shares of ``share`` x all sizes, none above ``max_epochs`` x its source.

    Weights repeat over sources in code-point order, null last.  Resharing the excess by weight
    until none is above ends where every source has ``min(cap, level x weight)``: in the order of
    cap / weight, the capped sources are those before the level at which the rest fits.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    per = (
        per.withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_caps", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.coalesce("_caps", F.lit(0))) / F.col("_rest"))
        # the level is that of the first source, in this order, whose cap is not reached
        .withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", "_level"))).over(everything))
    )
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_open._level") * F.col("_w"), F.col("_cap").cast("double")))
    return per.select("source", "source_size", "n_rows", target.alias("target"))


def _laid(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, carry: bool = False) -> DataFrame:
    """``id, size, source_size, target, taken`` and, if they are to be carried, the rows of ``docs`` as structs."""
    text = F.col(text_col)
    own = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        *own,
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (word_count(text) if size is None else size).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")))))).alias("key"),
    )
    rows = checkpointed(rows)
    targets = source_targets(rows.select("source", "size"), weights, share, max_epochs)
    per = targets.withColumn("_buckets", F.ceil(F.sqrt("n_rows")).cast("long")).withColumnRenamed("source", "_source")
    whole = 1 << 60
    joined = rows.join(F.broadcast(per) if per_is_small(per) else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    place = F.conv(F.substring("key", 1, 15), 16, 10).cast("double") / F.lit(float(whole))
    joined = joined.withColumn("bucket", F.floor(place * F.col("_buckets")).cast("long"))
    buckets = joined.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    laid = joined.join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(left - F.col("_start"), F.lit(0)), F.col("size"))
    out = laid.withColumn("_start", start)
    return out.select(*(["row"] if carry else []), "id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``docs``.

    ``taken`` is the number of words that the mix takes of the row, repeats counted: whole epochs,
    and in the last one what lies before the cut, so a source's sum is its target rounded down
    (no row exceeds ``max_epochs`` times its size).  Null text has size 0 and takes 0; null source
    is a source of its own, last in order; rows with a null or repeated id are rows of their own
    (the key of a null id hashes the text); other columns are ignored; an empty table gives an empty result.
    The key is ``md5`` of seed, id and text hash, so reruns agree.
    """
    return _laid(docs, **parameters).withColumnRenamed("id", parameters.get("id_col", "doc_id"))


def repeated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; a last partial take counts as one.

    Each row is carried with its own take, so rows with null, repeated or equal ids are not joined
    with each other's.  Rows of which nothing is taken go (those without words are such).
    """
    laid = _laid(docs, carry=True, **parameters).where("taken > 0")
    return laid.select("row", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))).select("row.*")


def per_is_small(per: DataFrame, limit: int = 100_000) -> bool:
    """Whether a table of one narrow row a source may be broadcast."""
    return per.limit(limit + 1).count() <= limit
