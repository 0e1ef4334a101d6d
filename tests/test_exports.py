"""Nested chunks, exports, model answers, retrieval seeds, versions of an upserted table."""

import re

import pytest
from graphloom.functions import text as tx
from graphloom.operators import relations, vectors
from graphloom.sources import interop
from graphloom.streaming import jobs
from pyspark.sql import functions as F


def chunked(text, limit):
    """A plain loop over pages, paragraphs and sentences."""
    size, out = lambda s: len(s.encode()), []

    def packed(parts, glue):
        done, now = [], ""
        for p in parts:
            if now and size(now) + size(p) + len(glue) > limit:
                done, now = done + [now], ""
            now = now + glue + p if now else p
        return done + [now] if now else done

    def sentences(p):
        done, now = [], ""
        for part in re.split(r"(?<=[!?])|(?<=\.)(?<!\d\.(?=\d))", p):
            now += part
            if part[-1:] in set(".!?") and part and size(now) > 10:
                done, now = done + [now.strip()], ""
        return done + [now.strip()] if now.strip() else done

    for page in (text or "").split("\f"):
        page = page.strip()
        if not page:
            continue
        if size(page) <= limit:
            out.append(page)
            continue
        run = []
        for p in filter(None, (x.strip() for x in page.split("\n\n"))):
            if size(p) > limit:
                out += packed(run, "\n\n") + packed(sentences(p), " ")
                run = []
            else:
                run.append(p)
        out += packed(run, "\n\n")
    return out


def test_nested_chunks_by_a_plain_loop(spark):
    texts = ["Short page.", "", None, "a\f\fb c", "One two three. " * 20, "P one.\n\nP two.\n\n" + "Costs 3.5 now. Ok! Is it? Yes it is. " * 6 + "\n\nlast", "x" * 200, "No. No. No! " * 12 + "\fNext é page\n\n" + "y " * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.document_chunks("t", 80).alias("c")).collect()
    assert {r.i: list(r.c or []) for r in rows} == {i: chunked(t, 80) for i, t in enumerate(texts)}


def test_session_exports_of_each_form(spark):
    values = ['{"entities": [{"uuid": "u", "name": "n"}], "edges": []}', '{"edges": [{"uuid": "e"}]}', '[{"session_id": "s", "messages": [{"role": "user", "content": "hi"}]}]', '{"id": "x"}', '{"edges": []}', "no json", None, '{"facts": []}']
    rows = interop.parse_sessions(spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)).collect()
    assert [r.form for r in rows] == ["envelope", "envelope", "sessions", "session", None, None, None, "envelope"]
    assert rows[0].entities[0].name == "n" and rows[2].sessions[0].messages[0].content == "hi" and rows[3].sessions[0].id == "x"


def test_evidence_and_scalars(spark):
    q = spark.createDataFrame([("q", ["a", "b", "zz"])], "query_id string, evidence array<string>")
    t = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "doc_id string, session_id string")
    assert [tuple(r) for r in interop.evidence_sessions(q, t).collect()] == [("q", "s1")]
    got = spark.createDataFrame([('"x"',), ("5",), ("1.5",), ("true",), ("[1]",), ("{",)], "j string").coalesce(1).select(interop.scalar(F.col("j")).alias("s")).collect()
    assert [r.s and (r.s.kind, r.s.text) for r in got] == [("String", "x"), ("Integer", "5"), ("Float", "1.5"), ("Bool", "true"), ("String", "[1]"), None]


def test_answers_and_fallback(spark):
    rows = spark.createDataFrame([(1, 'x [{"subject":"a","predicate":"p","object":"b","confidence":2}] y'), (2, "none"), (3, '[{"subject":"a","predicate":"p"}]'), (4, '[{"subject":"a","predicate":"p","object":"b","confidence":"high"}]'), (5, None)], "text_id int, output string")
    got = relations.parse_relations(rows)
    assert sorted((r.text_id, r.confidence) for r in got.collect()) == [(1, 1.0), (4, 0.5)]
    other = spark.createDataFrame([(1, "z", "q", "y", 0.3), (2, "z", "q", "y", 0.3)], "text_id int, subject string, predicate string, object string, confidence double")
    both = relations.with_fallback(got.select("text_id", "subject", "predicate", "object", "confidence"), other)
    assert sorted((r.text_id, r.subject) for r in both.collect()) == [(1, "a"), (2, "z"), (4, "a")]


def test_top_k_over_blocks_and_lengths(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(9)] + [(200, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = vectors.topk_many(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 3, block_rows=8).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, x in rows:
        if x is not None and q % 20 == 0:
            best = sorted(((-dot(x, y), i) for i, y in rows if y is not None and len(y) == len(x)))[:3]
            assert [(r.id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in best]


def test_upserted_versions_are_never_lost(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    into = jobs.upserting(path, ["id"])
    batch = lambda rows: spark.createDataFrame(rows, "id int, v string, seq int")
    with pytest.raises(RuntimeError):
        into(batch([(1, "a", 1)]), 3)
    into(batch([(1, "a", 1), (2, "b", 1)]), 0)
    into(batch([(2, "c", 2)]), 1)
    into(batch([(3, "d", 3)]), 5)  # batches 2 to 4 left no version
    into(batch([(3, "d", 3)]), 5)  # run again
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{path}/version=5").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_an_import_parses_its_lines_once(spark):
    """No join's own filter parses lines again, before they are picked."""
    nodes = spark.createDataFrame([(i, f"n{i}", "Entity", 0, "default" if i < 3 else "other") for i in range(6)], "id long, content string, node_type string, timestamp long, namespace string")
    edges = spark.createDataFrame([(i, (i + 1) % 6, "RelatesTo", 0.5) for i in range(6)], "source long, target long, edge_type string, weight double")
    back, links = interop.import_graph(*interop.export_graph(nodes, edges, "default"), "copy", 10)
    assert sorted((r.source, r.target, r.edge_type, r.weight) for r in links.collect()) == [(10, 11, "RelatesTo", 0.5), (11, 12, "RelatesTo", 0.5)]
    assert sorted(r.id for r in back.collect()) == [10, 11, 12]
    for frame in (back, links):
        assert "json" not in frame._jdf.queryExecution().optimizedPlan().toString()
