"""Streams past a typed cursor: resuming, text order, rows without a cursor, commits."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
from graphloom.sources.cursor import CursorSource

FOLDER = "/root/testdata/sf0.001"


def run(spark, tmp_path, name, **options):
    spark.dataSource.register(CursorSource)
    out = str(tmp_path / f"out-{name}")
    stream = spark.readStream.format("cursor_rows").options(mark=f"{tmp_path}/mark-{name}", **options).load()
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


def test_given_tables_resume_at_their_cursor(spark, tmp_path):
    for name, cursor, kind in (("events", "ts", "timestamp"), ("conversations", "conv_id", "long")):
        table = pq.read_table(f"{FOLDER}/{name}.parquet").sort_by(cursor)
        n, folder = len(table), tmp_path / name
        folder.mkdir()
        cut = next(i for i in range(n // 2, n) if table[cursor][i] != table[cursor][i - 1])
        pq.write_table(table.slice(0, cut), folder / "a.parquet", row_group_size=100)
        key = "event_id" if name == "events" else "text"
        first = run(spark, tmp_path, name, path=str(folder), cursor=cursor, kind=kind)
        assert sorted(str(r[0]) for r in first.select(key).collect()) == sorted(map(str, table[key].slice(0, cut).to_pylist()))
        pq.write_table(table.slice(cut), folder / "b.parquet")
        both = run(spark, tmp_path, name, path=str(folder), cursor=cursor, kind=kind)
        assert sorted(str(r[0]) for r in both.select(key).collect()) == sorted(map(str, table[key].to_pylist()))
        assert run(spark, tmp_path, name, path=str(folder), cursor=cursor, kind=kind).count() == n


def test_text_compares_as_text_and_null_cursors_come_once(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    put = lambda file, rows: pq.write_table(pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.string())}), folder / file)
    put("a.parquet", [(1, "9"), (2, "10"), (3, None)])
    got = run(spark, tmp_path, "t", path=str(folder), cursor="at", kind="string")
    assert {r.id for r in got.collect()} == {1, 2, 3}
    put("b.parquet", [(4, "95"), (5, "100"), (6, None)])  # "100" is not past "9"
    got = run(spark, tmp_path, "t", path=str(folder), cursor="at", kind="string")
    assert {r.id for r in got.collect()} == {1, 2, 3, 4}
    assert {r.id for r in run(spark, tmp_path, "u", path=str(folder), cursor="at", kind="string", after="9").collect()} == {4}
    mark = tmp_path / "mark-t"
    assert not mark.exists() or json.loads(mark.read_text())["after"] in ("9", "95")


def test_dates_and_whole_files_without_cursors(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    pq.write_table(pa.table({"id": [1, 2], "at": pa.array([dt.date(2024, 1, 2), dt.date(2023, 5, 1)])}), folder / "a.parquet")
    pq.write_table(pa.table({"id": [3], "at": pa.array([None], pa.date32())}), folder / "b.parquet")
    assert {r.id for r in run(spark, tmp_path, "d", path=str(folder), cursor="at", kind="date").collect()} == {1, 2, 3}
    assert {r.id for r in run(spark, tmp_path, "e", path=str(folder), cursor="at", kind="date", after="2023-12-31").collect()} == {1}
