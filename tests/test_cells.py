"""Approximate vector search in cells."""

import random

from pyspark.sql import functions as F

from graphloom.operators import vectors
from graphloom.queries import asked, vectors_of
from graphloom.service_queries import ann_topk

FOLDER = "/root/testdata/sf0.01"


def test_recall_against_all_vectors(spark):
    found = ann_topk(spark, FOLDER).select("query_id", "id")
    true = vectors.topk_many(asked(spark, FOLDER), vectors_of(spark, FOLDER), 10).select("query_id", "id")
    hits, n = found.join(true, ["query_id", "id"]).count(), true.count()
    assert n > 0 and hits / n >= 0.9


def test_all_probes_are_exact_and_odd_rows_do_no_harm(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = v.where("id < 20").select(F.col("id").alias("query_id"), "embedding")
    cells = vectors.fit_cells(v, 6)
    index = vectors.celled(v, cells)
    assert index.count() == 201  # the null one and the short one have no cell
    got = vectors.topk_cells(queries, index, cells, 5, 6).select("query_id", "id", "rank").collect()
    want = vectors.topk_many(queries, v.where("id < 902"), 5).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_no_vectors(spark):
    v = spark.createDataFrame([], "id long, embedding array<double>")
    cells = vectors.fit_cells(v, 6)
    assert cells.isEmpty() and vectors.celled(v, cells).isEmpty()
