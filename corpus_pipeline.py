"""Cleaning pipeline over ``documents``: toxicity, near-duplicates, benchmark, mixing, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as decontamination
from graphloom.llm import minhash, mixing, sstable, toxicity
from graphloom.llm.queries import table, vocabulary
from graphloom.llm.shared import scratch_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; labels of fold 1 of 3 are not learnt from.

    Rows are judged one by one by their text; a null text counts as empty.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").withColumn("_held", held_out)
    model = toxicity.fit(toxicity.sample(table(spark, sf_dir, "documents"), labels, ~F.col("_held")))
    return toxicity.score_rows(docs, model).where(F.col("score") < 0.7).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id.

    Rows with a null id or no words stay; different texts under one id are documents of their
    own; of equal rows one stays.
    """
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text; null and empty texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to source weights takes it, a last partial take counting as one; takes of nothing go."""
    return mixing.repeated(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted shard files, and what is read back from them: a row a document, equal and null ids too."""
    return sstable.token_shards(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_shards", token_shards),
]

#: Classifier scores and signatures are no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
