import re

from graphloom.functions import text as tx
from graphloom.operators import mindset, relations, tenancy
from graphloom.sources import connectors, interop


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_sentences_keep_numbers_whole(spark):
    assert one(spark, tx.sentences("t"), "It cost $99.99. Really? v1.2.3 is out! x") == ["It cost $99.99.", "Really?", "v1.2.3 is out!"]


def plain_chunks(text, limit):
    parts, out, open_ = [p.strip() for p in re.split(r"(?<=[!?])|(?<=[.])(?<![0-9][.](?=[0-9]))", text)], [], ""
    for p in (p for p in parts if len(p.encode()) > 1):
        if open_ and len(open_.encode()) + 1 + len(p.encode()) > limit:
            out.append(open_)
            open_ = p
        else:
            open_ = f"{open_} {p}" if open_ else p
    return out + [open_] if open_ else out


def test_chunks_match_a_plain_restatement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", tx.chunks("text", 300).alias("c")).collect()
    assert all(r.c == plain_chunks(r.text, 300) for r in docs)


def test_small_functions(spark):
    assert one(spark, tx.truncated("t", 5), "héllo wörld") == "héll..."
    assert one(spark, tx.truncated("t", 50), "héllo") == "héllo"
    assert one(spark, tx.stripped_html("t"), "<p>a &lt;b&gt; &amp;amp;</p><br") == "a <b> &amp;"
    assert one(spark, tx.wikilinks("t"), "[[A|x]] [[B#y]] [[A]]") == ["A", "B"]
    assert one(spark, tx.tags("t"), "#a x\n```\n#no\n``` #b/c") == ["a", "b/c"]
    assert one(spark, tx.masked("t"), "sk-123456789") == "sk-****6789"
    assert str(one(spark, tx.partial_date("t"), "2020-05")) == "2020-05-01" and one(spark, tx.partial_date("t"), "May") is None
    assert one(spark, tx.iso_seconds("t"), "2024-01-01T00:00:10.5+02:00") == 1704067210
    assert re.match(tx.glob("**/*.md"), "a/b/c.md") and re.match(tx.glob("**/*.md"), "c.md") and not re.match(tx.glob("*.md"), "a/c.md")


def test_mindset_detection(spark):
    assert one(spark, mindset.analyse("t"), "Please verify this") == "Algorithmic"
    assert one(spark, mindset.analyse("t"), "How do these relate?") == "Spatial"
    assert one(spark, mindset.analyse("t"), "Is it so") == "Algorithmic"
    assert one(spark, mindset.analyse("t"), "checked") is None


def test_relations_take_the_first_signal_and_the_person(spark):
    m = spark.createDataFrame([(1, "Paris", "location", 0, 5, 0.9), (1, "Ana", "person", 24, 27, 0.9)], "text_id long, text string, label string, start int, end int, confidence double")
    b = spark.createDataFrame([(1, "Paris is where lives in Ana")], "text_id long, body string")
    got = {(r.subject, r.object): r.predicate for r in relations.co_occurrence(m, b).collect()}
    assert got == {("Ana", "Paris"): "lives_in"}
    spans = spark.sql("select array(named_struct('start', 0, 'end', 5, 'confidence', 0.5), named_struct('start', 3, 'end', 8, 'confidence', 0.9), named_struct('start', 8, 'end', 9, 'confidence', 0.1)) s")
    assert [x.start for x in spans.select(relations.greedy_spans("s").alias("x")).first().x] == [3, 8]


def test_merge_keeps_one_copy_of_a_content(spark):
    nodes = spark.createDataFrame([(1, "A", "Entity", 0, "s"), (2, "a ", "Entity", 0, "s"), (3, "b", "Entity", 0, "s"), (9, "B", "Entity", 0, "d")], "id long, content string, node_type string, timestamp long, namespace string")
    edges = spark.createDataFrame([(1, 3, "RelatesTo", 1.0), (2, 3, "RelatesTo", 1.0)], "source long, target long, edge_type string, weight double")
    new, moved = tenancy.merge(nodes, edges, "s", "d", 100)
    assert [(r.id, r.content) for r in new.collect()] == [(100, "A")]
    assert {(r.source, r.target) for r in moved.collect()} == {(100, 9)}


def test_memory_exports_of_every_shape(spark):
    raw = spark.createDataFrame([('{"results":[{"id":"1","memory":"x","user_id":"u","created_at":"2024-01-01T00:00:00Z"}]}',), ('{"memories":[{"id":"2","memory":"y","user_id":"u","created_at":"2024-01-02T00:00:00Z"}]}',), ('[{"id":"3","memory":"z"}]',), ('{"id":"4","memory":"w"}',), ("no",)], "value string")
    parsed = interop.parse_memories(raw)
    assert {r.memory for r in parsed.collect()} == {"x", "y", "z", "w"}
    nodes, edges = interop.memories_to_graph(parsed, 7, 50)
    names = {r.id: r.content for r in nodes.collect()}
    assert sorted(names) == [50, 51, 52, 53] and [(names[r.source], names[r.target]) for r in edges.collect()] == [("x", "y")]


def test_export_and_import_of_a_graph(spark):
    nodes = spark.createDataFrame([(1, "A", "Entity", 5, "s"), (2, "b", "Event", 6, "s"), (3, "c", "Event", 6, "t")], "id long, content string, node_type string, timestamp long, namespace string")
    edges = spark.createDataFrame([(1, 2, "Actor", 0.5), (1, 3, "Actor", 0.5)], "source long, target long, edge_type string, weight double")
    n, e = interop.export_graph(nodes, edges, "s")
    back, links = interop.import_graph(n.select("value"), e, "x", 10)
    assert {(r.id, r.content, r.namespace, r.embedding) for r in back.collect()} == {(10, "A", "x", None), (11, "b", "x", None)}
    assert [(r.source, r.target, r.edge_type, r.weight) for r in links.collect()] == [(10, 11, "Actor", 0.5)]


def test_cursors_compare_by_type(spark):
    rows = spark.createDataFrame([(9,), (10,)], "update_id long")
    assert [r.update_id for r in connectors.since(rows, "telegram", 9).collect()] == [10]
    assert connectors.next_cursor(rows, "telegram").first().cursor == "10"
    assert spark.createDataFrame([("a", "", None)], "a string, b string, c string").select(connectors.joined_content(["a", "b", "c"]).alias("x")).first().x == "a"
