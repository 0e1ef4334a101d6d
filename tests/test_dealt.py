from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import graph, tenancy


def test_large_inputs_are_dealt_by_their_files_and_small_ones_are_not(spark, tmp_path):
    spark.range(0, 1000, 1, 5).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    size = storage.file_bytes(t)
    assert size > 10_000 and storage.file_bytes(t.unionByName(t)) == size
    assert storage.dealt(t, "id") is t
    many = storage.dealt(t, "id", bytes_a_task=1_000)
    assert many.rdd.getNumPartitions() == -(-size // 1_000)
    assert sorted(r.id for r in many.collect()) == list(range(1000))


def test_ids_are_spread_only_up_to_a_bound(spark):
    ids = spark.range(10)
    assert "broadcast" in storage.spread(ids, 10)._jdf.queryExecution().logical().toString().lower()
    assert storage.spread(ids, 9) is ids


def test_steps_give_the_same_when_all_is_dealt(spark, tmp_path, monkeypatch):
    e = spark.createDataFrame([(1, 2, "a", 1.0), (2, 1, "b", 1.0), (1, 3, "a", 0.5), (3, 3, "a", 1.0), (4, 1, None, None), (5, 6, "a", 1.0), (None, 1, "a", 1.0)], "source long, target long, edge_type string, weight double")
    n = spark.createDataFrame([(i, f" Name {i % 4}", "Entity" if i % 2 else "Event", i, "x" if i < 4 else "y") for i in range(1, 7)], "id long, content string, node_type string, timestamp long, namespace string")
    e.write.parquet(f"{tmp_path}/e"), n.write.parquet(f"{tmp_path}/n")

    def results():
        e, n = spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/n")
        some = n.where("id <= 3")
        made = {
            "induced": graph.induced(e, some),
            "incident": graph.incident(e, some),
            "centrality": graph.neighbour_centrality(e, n),
            "remapped": graph.remap(e, some.select(F.col("id").alias("old"), (F.col("id") + 100).alias("new"))),
            "copies": tenancy.merge(n, e, "x", "y", 100)[0],
            "named": tenancy.messages_with_entities(some.select("id"), e, n),
        }
        return {k: sorted(map(str, df.collect())) for k, df in made.items()}

    plain = results()
    assert len(plain["induced"]) == 4 and len(plain["incident"]) == 6 and len(plain["remapped"]) == 4
    assert "id=1, centrality=1.0" in " ".join(plain["centrality"])
    monkeypatch.setattr(storage, "file_bytes", lambda df: 20 * storage.FILE_BYTES_A_TASK)
    assert results() == plain
