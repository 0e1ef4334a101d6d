"""State per key and the merge table: results, order, restarts, expiry, crashes."""

import random
import time

import pytest
from graphloom.operators import facts
from graphloom.streaming import jobs, merge, stateful

FACTS = "id long, subject long, predicate string, object string, source_confidence double, timestamp long, state string"


@pytest.fixture(autouse=True)
def rocks(spark):
    stateful.use_rocks(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drain(spark, frame, tmp_path, name="a"):
    """Runs a stream until its input is used up and gives all rows it ever wrote."""
    out = str(tmp_path / f"out-{name}")
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(out)


def some_facts(n, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(4), rnd.choice("pq"), rnd.choice(["a", "b", "c", None]), rnd.random(), i // 3 * 86_400 * 40, rnd.choice(["Accepted", "Accepted", "Superseded"])) for i in range(n)]
    return rows + [(n, None, "p", "a", 0.5, 10**9, "Accepted"), (n + 1, 1, "p", "a", 0.5, None, "Accepted")]


def test_running_contradictions_equal_the_batch(spark, tmp_path):
    rows, source = some_facts(300, 1), str(tmp_path / "in")
    want = sorted(map(tuple, facts.resolve(spark.createDataFrame(rows, FACTS), first_only=True).select("old_id", "new_id", "strategy", "winner", "loser").collect()))
    assert len(want) > 50
    for lo, hi in ((0, 120), (120, 121), (121, 400)):  # a restart between batches; rows of a batch in any order
        part = rows[lo:hi]
        random.Random(lo).shuffle(part)
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(source)
        got = drain(spark, stateful.contradictions(jobs.files(spark, source, FACTS)), tmp_path)
    assert sorted(map(tuple, got.select("old_id", "new_id", "strategy", "winner", "loser").collect())) == want


def test_many_frames_of_one_key(spark, tmp_path):
    """More frames than are held go through the state store."""
    rows = [(i, 1, "p", "b" if i % 7 else "a", 0.5, i, "Accepted") for i in range(400)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        source = str(tmp_path / "in")
        spark.createDataFrame(rows, FACTS).coalesce(1).write.parquet(source)
        got = drain(spark, stateful.contradictions(jobs.files(spark, source, FACTS)), tmp_path)
        want = facts.resolve(spark.createDataFrame(rows, FACTS), first_only=True)
        assert sorted(map(tuple, got.select("old_id", "new_id").collect())) == sorted(map(tuple, want.select("old_id", "new_id").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_late_facts(spark, tmp_path):
    source = str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame([(i, 1, "p", o, 0.5, t, "Accepted") for i, o, t in rows], FACTS).coalesce(1).write.mode("append").parquet(source)

    add((1, "a", 100))
    drain(spark, stateful.contradictions(jobs.files(spark, source, FACTS)), tmp_path)
    add((2, "b", 50))  # late: nothing known is earlier
    assert drain(spark, stateful.contradictions(jobs.files(spark, source, FACTS)), tmp_path).count() == 0
    add((3, "a", 200), (4, "b", 300))
    got = drain(spark, stateful.contradictions(jobs.files(spark, source, FACTS)), tmp_path)
    assert {(r.old_id, r.new_id) for r in got.collect()} == {(2, 3), (1, 4)}


def test_forgotten_keys_start_anew(spark, tmp_path):
    other, key = str(tmp_path / "in2"), "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")  # else a stream with expiry runs empty batches for ever
    spark.createDataFrame([(1, 1, "p", "a", 0.5, 1, "Accepted")], FACTS).coalesce(1).write.parquet(other)
    drain(spark, stateful.contradictions(jobs.files(spark, other, FACTS), ttl_ms=1_000), tmp_path, "ttl")
    time.sleep(2)
    spark.createDataFrame([(2, 1, "p", "b", 0.5, 2, "Accepted")], FACTS).coalesce(1).write.mode("append").parquet(other)
    assert drain(spark, stateful.contradictions(jobs.files(spark, other, FACTS), ttl_ms=1_000), tmp_path, "ttl").count() == 0
    spark.conf.unset(key)


def test_audit_ring(spark, tmp_path):
    schema, source = "namespace string, timestamp long, seq long, action string, user string, status int", str(tmp_path / "in")
    rnd, rows = random.Random(2), []
    for i in range(60):
        rows.append((rnd.choice("ab"), 1_000 + i * 10, i, "search", None, 200 if i % 2 else None))
    for part in (rows[:25], rows[25:45], rows[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        left = drain(spark, stateful.audit_ring(jobs.files(spark, source, schema), capacity=8, retention=100), tmp_path).collect()
    mark = max(r[1] for r in rows)
    for name in "ab":
        mine = [r for r in rows if r[0] == name]
        gone = {r.seq for r in left if r.namespace == name}
        stays = {r[2] for r in mine} - gone
        assert stays == {r[2] for r in mine[-8:] if r[1] >= mark - 100}
        assert {r.reason for r in left} == {"capacity", "retention"}
    assert len({r.seq for r in left}) == len(left)


def table(spark, path):
    return {r.id: r.content for r in merge.read_table(spark, path).collect()}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, content string, seq long, gone boolean"
    into = merge.merging(path, ["id"], buckets=16)
    assert merge.read_table(spark, path) is None
    into(spark.createDataFrame([(i, f"v{i}", 1, False) for i in range(400)] + [(5, "older", 0, False)], schema), 0)
    assert table(spark, path) == {i: f"v{i}" for i in range(400)}
    into(spark.createDataFrame([(7, "new", 5, False), (900, "x", 1, False), (8, "stale", 0, False)], schema), 1)
    assert len(list((tmp_path / "t" / "data" / "version=1").glob("bucket=*"))) <= 3
    assert table(spark, path) == {i: f"v{i}" for i in range(400)} | {7: "new", 900: "x"}
    # a batch that is run again changes nothing
    into(spark.createDataFrame([(7, "again", 9, False)], schema), 1)
    assert table(spark, path)[7] == "new"
    assert [r.content for r in merge.read_table(spark, path, {"id": 900}).collect()] == ["x"]
    assert merge.read_table(spark, path, {"id": 12345}).count() == 0
    into(spark.createDataFrame([(7, None, 10, True)], schema), 2)
    into(spark.createDataFrame([(7, "late", 6, False)], schema), 3)
    alive = {r.id for r in merge.live(merge.read_table(spark, path), "gone").collect()}
    assert 7 not in alive and len(alive) == 400
    for b in range(4, 8):
        into(spark.createDataFrame([(1, f"w{b}", b, False)], schema), b)
    assert table(spark, path)[1] == "w7"
    assert len(list((tmp_path / "t" / "commits").glob("[0-9]*"))) == merge.KEEP
    versions = [p for p in (tmp_path / "t" / "data").glob("version=*") if list(p.glob("bucket=*"))]
    assert len(versions) <= 5  # what no kept pointer names is gone


def test_a_crash_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "id long, content string, seq long"
    into = merge.merging(path, ["id"], buckets=4)
    into(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], schema), 0)
    with monkeypatch.context() as m:
        m.setattr(merge.Commits, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            into(spark.createDataFrame([(1, "c", 2)], schema), 1)
    assert table(spark, path) == {1: "a", 2: "b", None: "n"}
    into(spark.createDataFrame([(1, "c", 2), (None, "m", 2)], schema), 1)
    assert table(spark, path) == {1: "c", 2: "b", None: "m"}
    with pytest.raises(ValueError):
        merge.merging(path, ["id"], buckets=8)(spark.createDataFrame([(1, "c", 2)], schema), 2)


def test_merge_follows_a_stream(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "t"), "id long, content string, seq long"
    for part in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.sync(jobs.files(spark, source, schema), merge.merging(path, ["id"]), str(tmp_path / "cp")).awaitTermination(60)
    assert table(spark, path) == {1: "b", 2: "d"}
