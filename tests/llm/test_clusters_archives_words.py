"""Clusters with bounds, seekable archives and spelling variants, each against a plain version."""

import io
import re
import zlib

import numpy as np
import pytest
import zstandard
from graphloom.llm import bundles, drake, spelling
from pyspark.sql import functions as F


def lloyd(rows, k, rounds, scale=64):
    """Every distance of every round, in Python integers."""
    from hashlib import sha256

    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    c = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, one)), j) for j, one in enumerate(c))
    for _ in range(rounds):
        homes = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), h in zip(kept, homes) if h == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=repr), [sha256(",".join(map(str, one)).encode()).hexdigest() for one in c]


@pytest.mark.parametrize("tracked,k", [(1, 6), (4, 16), (20, 7), (3, 40)])
def test_clusters_are_lloyds(spark, tracked, k):
    rng = np.random.default_rng(tracked)
    centres = rng.normal(0, 1, (9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.2, 64)).round(1).tolist()) for i in range(150)]
    rows += [(i, [0.0] * 64) for i in range(150, 200)]  # a hot group of equal vectors
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.25] * 64), (None, [-0.25] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    vectors = vectors.withColumn("cluster", F.lit("x")).withColumn("id", F.lit(1)).withColumn("x", F.lit(2))
    got = drake.cluster(vectors, k=k, rounds=3, tracked=tracked).collect()
    want, sums = lloyd(rows, k, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert all(r.centroid_sha256 == sums[r.cluster] and r.inertia == sum(x[2] for x in want) for r in got)
    assert all(r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) for r in got)
    if k == 16:
        assert sum(r.scanned for r in got) < 0.7 * len(got) * k * 4


def test_clusters_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [None] + [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [float("inf")] * 64), (7, [-0.01] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in drake.cluster(vectors).collect()] == [(7, 0, 0, 0)]
    assert drake.cluster(vectors.where("vec_id < 7")).count() == 0
    with pytest.raises(Exception, match="no exact distances"):
        drake.cluster(spark.createDataFrame([(1, [1e7] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_certify_large_integers():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 26):
        x, c = rng.integers(-size, size, (500, 64)), rng.integers(-size, size, (12, 64))
        state = drake.ranked(x, c, 3)
        for _ in range(4):
            new = c + rng.integers(-max(1, size // 50), max(2, size // 50), c.shape)
            way = drake._up(np.sqrt(drake.own_distances(new, c, np.arange(len(c))).astype(float)))
            state, c = drake.moved_state(x, new, way, state), new
            d = ((x[:, None, :] - c[None]) ** 2).sum(2)
            assert (state[0] == d.argmin(1)).all()


PAGES = [(5, "http://a/", "<p>one"), (3, "http://b/", "<p>one"), (9, None, None), (8, "http://c/ d\r\nX: y", ""), (None, "u", "<p>one"), (4, "http://é/", "ünï \U0001f600 \r\n\r\n WARC/1.1\r\n"), (3, "http://b/", "<p>one"), (11, "long", "x<y>" * 200_000), (-2, "neg", "<p>two")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("first", F.lit("f")).withColumn("key", F.lit(1)).withColumn("shared", F.lit(2))
    index = bundles.write_archives(pages.repartition(3), f"file://{tmp_path}", frame_bytes=300)
    got = sorted((tuple(r) for r in bundles.read_archives(index).collect()), key=repr)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        low = min(p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None)
        want.append((i, len(data), bundles.sha1_32(data), "response" if i == low else "revisit", None if i == low else low))
    assert got == sorted(want, key=repr)
    # a seek reads one frame; a revisit is fetched at its response
    asked = spark.createDataFrame([(5,), (8,), (11,), (4,), (77,), (5,)], "page_id long")
    assert {r.page_id: r.html for r in bundles.fetch(index, asked).collect()} == {5: "<p>one", 8: "", 11: "x<y>" * 200_000, 4: PAGES[5][2]}
    for row in index.groupBy("uri").agg(F.max("frame").alias("frame")).collect():
        reader = bundles.BundleReader(row.uri)
        with open(row.uri.removeprefix("file://"), "rb") as f:
            raw = f.read()
        # any decoder reads the archive whole and skips the seek table
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.frames))) and len(reader.frames) == row.frame + 1
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    for r in index.collect():
        block = bundles.BundleReader(r.uri).frame(r.frame)[r.offset : r.offset + r.length]
        assert block.startswith(b"WARC/1.1") and r.record_id.encode() in block


def test_archives_of_small_payloads_damage_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = {(r.page_id, r.record_type) for r in bundles.round_trip(pages, min_bytes=7).collect()}
    assert not any(kind == "revisit" for _, kind in kinds)
    assert {r.page_id for r in bundles.round_trip(pages, min_bytes=6).where("record_type = 'revisit'").collect()} == {5, None}
    assert bundles.round_trip(pages.limit(0)).count() == 0
    index = bundles.write_archives(pages.coalesce(1), f"file://{tmp_path}")
    path = index.first().uri.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(60)
        f.write(b"\x00\x01\x02\x03")
    with pytest.raises(Exception):
        bundles.read_archives(index).count()


def test_archives_roll_over(spark, tmp_path):
    rng = np.random.default_rng(5)
    pages = spark.createDataFrame([(i, f"u{i}", rng.bytes(400).hex()) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = bundles.write_archives(pages, f"file://{tmp_path}", frame_bytes=2_000, archive_bytes=8_000)
    assert index.select("uri").distinct().count() > 2
    assert bundles.read_archives(index).count() == 60


def near(a, b):
    """Levenshtein distance, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1] == 1


def test_trie_neighbours_are_all_at_distance_one():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(600)} | {"a" * 500, "a" * 501, "a" * 300 + "b" + "a" * 200})
    trie = spelling.Trie.unpack(*spelling.Trie.build(words, [len(w) for w in words]).pack())
    for word in words + ["", "zzzz", "aaaaaaaaaaaa"]:
        if len(word) < 100:
            found = trie.neighbours(word)
            assert sorted(found.values()) == [w for w in words if len(w) < 100 and near(word, w)]
            assert all(trie.value[n] == len(w) for n, w in found.items())
    assert sorted(map(len, trie.neighbours("a" * 500).values())) == [501, 501] and len(trie.neighbours("a" * 501)) == 2


def plain_variants(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in links.items() if v}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, counts[w], form.get(w), root, len(links[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_variants_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["colour", "color", "colours", "Größe", "größen", "straße", "éclair", "eclair", "receive", "recieve", "receives"]
    rows = [(None, None), (1, ""), (2, "Color COLOR color"), (None, "colour " * 5), (3, "a" * 50_000 + " " + "tail word " * 3)]
    rows += [(4, "colouur " * 3), (4, "colouur " * 3), (5, "Àbcde àbcde Àbcde Àbcde"), (6, "abcdef " * 4 + "abcdeg " * 9 + "abcheg " * 20)]
    for i in range(10, 120):
        picked = [base[int(k)] for k in np.minimum(rng.geometric(0.3, 30) - 1, len(base) - 1)]
        for _ in range(2):
            w = picked[int(rng.integers(0, len(picked)))]
            at = int(rng.integers(0, len(w)))
            picked.append(w[:at] + str(rng.choice(list("xyz"))) + w[at + int(rng.integers(0, 2)) :])
        rows.append((i, ", ".join(picked)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("id", F.lit("i"))
    want = plain_variants(rows)
    assert any(r[2] and r[2] != r[3] for r in want)
    for shard_words, group_bytes in ((50_000, 64 << 20), (5, 300)):
        got = spelling.variants(docs.repartition(4), shard_words=shard_words, group_bytes=group_bytes)
        assert sorted(tuple(r) for r in got.select("word", "n", "form", "root", "n_near", "form_n").collect()) == want
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id = 1")).count() == 0
