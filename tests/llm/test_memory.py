import tracemalloc

import pyarrow as pa

from graphloom.llm import pieces, shared


def test_a_window_of_texts_takes_little_memory():
    texts = pa.array(["some words of a long text, and more " * 30_000] * 12)
    tracemalloc.start()
    for _ in pieces.windows(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_files_of_a_round_of_components_can_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "freed", lambda session: calls.append(session))
    chain = spark.range(40).selectExpr("id a", "id + 1 b")
    assert {r.component for r in shared.connected_components(chain, "a", "b").collect()} == {0}
    assert len(calls) >= 3
