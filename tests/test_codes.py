"""Search by product codes: recall, how much is scored exactly, and odd rows."""

import random

from graphloom.operators import codes, vectors
from graphloom.queries import asked, vectors_of
from graphloom.service_queries import coded_search
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.1"


def test_recall_and_share_at_a_larger_scale(spark):
    found, scored, n = coded_search(spark, FOLDER)
    true = vectors.topk_many(asked(spark, FOLDER), vectors_of(spark, FOLDER), 10).select("query_id", "id")
    hits = found.join(true, ["query_id", "id"]).count()
    assert n == 2_000 and hits / true.count() >= 0.9
    assert max(r["count"] for r in scored.groupBy("query_id").count().collect()) <= n / 10


def test_all_candidates_are_the_exact_search(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(10)]) for i in range(300)] + [(900, None), (901, [0.0] * 10), (902, [1.0, 2.0]), (903, [None] * 10), (904, [float("nan")] * 10), (905, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = v.where("id < 20 or id = 902").select(F.col("id").alias("query_id"), "embedding")
    book = codes.fit(v, 6, parts=4)
    index = codes.coded(v, book)
    assert index.count() == 301 and all(len(r.code) == 4 for r in index.collect())
    got = codes.topk(queries, v, index, book, 5, 6, 400).select("query_id", "id", "rank").collect()
    want = vectors.topk_many(queries.where("query_id < 20"), v.where("id < 902"), 5).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    few = codes.candidates(queries, index, book, 3, 7, block_rows=16)
    assert all(r["count"] <= 7 for r in few.groupBy("query_id").count().collect())
    assert codes.fit(v.limit(0), 6) is None



def test_no_pair_of_query_and_candidate_is_shuffled(spark):
    """Exact copies tie: the least ids are candidates, in any dealing of blocks, and only the best k of a block move."""
    rnd = random.Random(8)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    v = spark.createDataFrame([(i, base[i % 40]) for i in range(800)], "id long, embedding array<double>").repartition(5)
    queries = v.where("id < 30").select(F.col("id").alias("query_id"), "embedding")
    book = codes.fit(v, 4, parts=4)
    index = codes.coded(v, book)
    few = [(r.query_id, r.id) for r in codes.candidates(queries, index, book, 4, 50).collect()]
    assert len(few) == len(set(few)) == 30 * 50
    assert sorted(few) == sorted((r.query_id, r.id) for r in codes.candidates(queries, index, book, 4, 50, block_rows=64).collect())
    for q in range(30):
        own = {i for p, i in few if p == q}
        assert all(j in own for i in own for j in range(i % 40, i, 40))  # of copies the least ids
    top = codes.topk(queries, v, index, book, 5, 4, 50)
    assert all(r.id in {i for p, i in few if p == r.query_id} for r in top.collect())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan  # blocks meet, and give k rows a query
