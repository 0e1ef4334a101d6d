"""Scores of rankings against a plain loop."""

import math
import random

from graphloom.operators import evaluation


def test_ideal_order_without_sorting_documents(spark):
    rnd = random.Random(4)
    relevant = [(q, d, rnd.choice([0.0, 1.0, 2.0, 2.5])) for q in range(12) for d in rnd.sample(range(60), rnd.randrange(1, 40))]
    retrieved = [(q, r, d) for q in range(12) for r, d in enumerate(rnd.sample(range(60), rnd.randrange(0, 15)), 1)]
    found = evaluation.per_query(spark.createDataFrame(retrieved, "query_id long, rank int, doc_id long"), spark.createDataFrame(relevant, "query_id long, doc_id long, grade double"), 10)
    for r in found.collect():
        grade = {d: g for q, d, g in relevant if q == r.query_id}
        hits = [(rank, grade[d]) for q, rank, d in retrieved if q == r.query_id and rank <= 10 and d in grade]
        ideal = sum(g / math.log2(p + 1) for p, g in enumerate(sorted(grade.values(), reverse=True)[:10], 1))
        assert abs(r.ndcg - (sum(g / math.log2(p + 1) for p, g in hits) / ideal if ideal else 0)) < 1e-9
        assert abs(r.recall - len(hits) / len(grade)) < 1e-9
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
