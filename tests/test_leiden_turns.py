"""What a turn of Leiden shuffles."""

import random
import re

from graphloom.operators import leiden

BY_LINK = re.compile(r"Exchange hashpartitioning\((?:a|b|label)#\d+L?(?:, \w+#\d+L?)*, \d+\), ENSURE_REQUIREMENTS")


def some_edges(spark, seed=3, nodes=60):
    rnd = random.Random(seed)
    rows = [(a, b, rnd.random()) for a in range(nodes) for b in rnd.sample(range(a // 6 * 6, a // 6 * 6 + 6), 3) + [rnd.randrange(nodes)]]
    return spark.createDataFrame(rows, "source long, target long, weight double")


def test_a_turn_shuffles_no_links(spark, monkeypatch):
    plans, plain = [], leiden.checkpointed

    def spied(df):
        if "free" in df.columns and "comm" in df.columns:  # the moves that a turn asks for
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return plain(df)

    monkeypatch.setattr(leiden, "checkpointed", spied)
    monkeypatch.setattr(leiden, "LINK_BYTES", 1_000)  # several tasks
    leiden.leiden(some_edges(spark), max_levels=1, move_turns=2, merge_turns=1)
    assert plans
    for plan in plans:
        assert "REPARTITION_BY_NUM" in plan and not BY_LINK.search(plan), plan


def test_levels_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    edges = some_edges(spark, 5)
    want = sorted(map(tuple, leiden.leiden(edges).collect()))
    monkeypatch.setattr(leiden, "MOST_SENT", 0)
    assert sorted(map(tuple, leiden.leiden(edges).collect())) == want
