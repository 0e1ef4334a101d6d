from graphloom.operators import facts as fact_ops
from graphloom.plans.builder import MemoryGraph
from graphloom.sources import generate
from graphloom.streaming import jobs


def test_upserts_keep_the_last_write(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "id long, content string, seq long"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    query = jobs.sync(jobs.files(spark, source, schema), jobs.upserting(table, ["id"]), str(tmp_path / "cp"))
    query.awaitTermination(60)
    spark.createDataFrame([(2, "d", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    query = jobs.sync(jobs.files(spark, source, schema), jobs.upserting(table, ["id"]), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert {(r.id, r.content) for r in spark.read.parquet(f"{table}/version=1").collect()} == {(1, "b"), (2, "d")}


def test_streaming_contradictions(spark, tmp_path):
    source, out = str(tmp_path / "facts"), str(tmp_path / "out")
    schema = "id long, subject long, predicate string, object string, source_confidence double, timestamp long"
    spark.createDataFrame([(1, 1, "p", "a", 0.5, 0), (2, 1, "p", "b", 0.9, 5), (3, 2, "p", "a", 0.5, 0)], schema).coalesce(1).write.parquet(source)
    found = jobs.contradictions(jobs.files(spark, source, schema), fact_ops.TEMPORAL_SECONDS)
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.winner, r.loser, r.strategy) for r in spark.read.parquet(out).collect()] == [(2, 1, "Confidence")]


def test_generators_depend_on_the_seed_only(spark):
    a, b = generate.nodes(spark, 50, dim=8), generate.nodes(spark, 50, dim=8).repartition(3)
    assert sorted(a.collect()) == sorted(b.collect())
    assert sorted(a.collect()) != sorted(generate.nodes(spark, 50, seed=1, dim=8).collect())
    e = generate.edges(spark, 50, 200).collect()
    assert all(0 <= r.source < 50 and 0 <= r.target < 50 and r.source != r.target and 0.1 <= r.weight < 1 for r in e)
    assert generate.tree(spark, 3, 13).where("source = 1").count() == 3


def test_builder(spark):
    g = MemoryGraph(generate.nodes(spark, 20, dim=4), generate.chain(spark, 20), generate.nodes(spark, 20, dim=4).select("id", "embedding"))
    assert {r.id for r in g.start(5).traverse(2).to_df().collect()} == {3, 4, 5, 6, 7}
    assert g.start(0).find_path(3).first().path == [0, 1, 2, 3]
    assert g.vectors([1.0, 0.0, 0.0, 0.0], 3).to_df().count() == 3
