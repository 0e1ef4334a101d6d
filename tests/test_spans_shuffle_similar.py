"""Span decoding, the exact shuffle, similarity joins and projections against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from graphloom.operators import shuffle, similar, spans, vectors
from pyspark.sql import functions as F

LABELS = ["person", "place"]


def decode(text, scores, width=spans.MAX_WIDTH, threshold=0.5):
    words, at, out = (text or "").split(), 0, []
    places = []
    for w in words:
        at = text.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    for i, s in enumerate(scores or []):
        first, wide, label = i // (width * 2), i // 2 % width, i % 2
        if s is not None and first + wide < len(words) and 1 / (1 + math.exp(-s)) >= threshold:
            out.append((-1 / (1 + math.exp(-s)), first, wide, label))
    kept = []
    for c, first, wide, label in sorted(out):
        a, b = places[first][0], places[first + wide][1]
        if all(b <= x or y <= a for x, y, *_ in kept):
            kept.append((a, b, " ".join(words[first : first + wide + 1]), LABELS[label], round(-c, 9)))
    return sorted(kept)


def test_spans_equal_a_loop(spark):
    rnd = random.Random(5)
    rows = [(1, "Juan  vive  en  Madrid", [5.0] + [-9.0] * 71 + [None, 4.0]), (2, None, [1.0]), (3, "", [1.0]), (4, "no scores", None), (5, "no scores", []), (6, "  leading, blank\n", [0.0] * 48), (7, "ünï \U0001f600 côde", [1.0] * 72)]
    for i in range(10, 60):
        text = "".join(rnd.choice(["New ", "York\t", "City, ", " of", " x\n", " "]) for _ in range(rnd.randrange(12)))
        rows.append((i, text, [rnd.choice([None, rnd.gauss(-2, 2)]) for _ in range(rnd.randrange(0, 24 * 14))]))
    frame = spark.createDataFrame(rows, "id long, text string, scores array<double>").repartition(3)
    got = {r.id: [(m.start, m.end, m.text, m.label, round(m.confidence, 9)) for m in r.mentions] for r in spans.decoded(frame, LABELS).collect()}
    assert got == {i: decode(t, s) for i, t, s in rows}
    assert got[1][0][:4] == (0, 4, "Juan", "person") and got[1][1][:3] == (16, 22, "Madrid")


def test_spans_of_a_scorer_in_a_long_text(spark):
    """A text without sentences is one chunk: 20,000 words and 480,000 scores, a tenth of them sure."""
    scorer = lambda words: np.array([(i * 7 + len(w)) % 11 / 2 - 4.7 for i, w in enumerate(np.repeat(words, 24))])
    rows = [(1, "of the York \u00fcn\U0001f600 City " * 4_000), (2, ""), (3, None), (4, "one")]
    got = {r.id: [(m.start, m.end, m.text, m.label, round(m.confidence, 9)) for m in r.mentions] for r in spans.decoded(spark.createDataFrame(rows, "id long, text string"), LABELS, scorer=scorer).collect()}
    short = " ".join(rows[0][1].split()[:60])
    assert [m for m in got[1] if m[1] < 200] == [m for m in decode(short, list(scorer(short.split()))) if m[1] < 200]
    assert len(got[1]) > 4_000 and got[2] == got[3] == [] and got[4] == decode("one", list(scorer(["one"])))


def plain_shuffle(n, seed):
    a, state = list(range(n)), seed
    for i in range(n - 1, 0, -1):
        state = (state * shuffle.FACTOR + shuffle.STEP) % 2**64
        j = (state >> 33) % (i + 1)
        a[i], a[j] = a[j], a[i]
    return a


@pytest.mark.parametrize("n,seed", [(0, 42), (1, 42), (2, 7), (10, 42), (10, 99), (10_000, 42), (10_000, 2**64 - 1)])
def test_permutation_is_the_generator_s(spark, n, seed):
    got = [r.source for r in shuffle.permutation(spark, n, seed).orderBy("place").collect()]
    assert got == plain_shuffle(n, seed)


def test_shuffled_rows_and_split(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "key long, text string").repartition(5)
    got = shuffle.shuffled(rows, ["key"], seed=3, ratio=0.7).orderBy("place").collect()
    assert [r.key for r in got] == plain_shuffle(101, 3)
    assert [r.split for r in got] == ["train"] * 71 + ["validation"] * 30
    assert shuffle.shuffled(rows.limit(0), ["key"]).count() == 0


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.5, 0.75])
def test_similar_pairs_are_those_of_all_pairs(spark, threshold):
    rnd = random.Random(1)
    vec = {i: [rnd.gauss(0, 1) for _ in range(3)] for i in range(60)}
    vec[0], vec[1] = None, [0.0] * 3
    near = {i: {1000} | {rnd.randrange(100, 112) for _ in range(rnd.randrange(0, 6))} if i % 9 else set() for i in vec}  # 1000 is a hub
    edges = spark.createDataFrame([(i, m, "a", 1.0) for i, ms in near.items() for m in ms], "source long, target long, edge_type string, weight double")
    entities = spark.createDataFrame(list(vec.items()), "id long, embedding array<double>")
    got = {(r.a, r.b): round(r.score, 9) for r in similar.pairs(entities, edges, threshold).collect()}
    want = {}
    for a, b in itertools.combinations(vec, 2):
        union = len(near[a] | near[b])
        score = 0.6 * (len(near[a] & near[b]) / union if union else 0.0) + 0.4 * (cosine(vec[a], vec[b]) if vec[a] and vec[b] else 0.0)
        if score >= threshold:
            want[a, b] = round(score, 9)
    assert got == want and len(want) > 3
    parent = dict(zip(vec, vec))
    for a, b in sorted(want):
        ra, rb = parent[a], parent[b]
        parent = {k: min(ra, rb) if v in (ra, rb) else v for k, v in parent.items()}
    assert {r.id: r.cluster_id for r in similar.clusters(entities, edges, threshold).collect()} == parent


def test_few_pairs_are_checked(spark):
    """Sets of ten members, two of which all share, and three near copies: candidates stay far below all pairs."""
    rnd = random.Random(2)
    sets = {i: {-1, -2} | {rnd.randrange(3_000) for _ in range(8)} for i in range(400)}
    for i in range(3):
        sets[500 + i] = set(list(sets[i])[:9]) | {9_000 + i}
    rows = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id long, member long")
    found = {(r.a, r.b) for r in similar.sharing(rows, 0.5).collect()}
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert true and true <= found and len(found) < 400 * 399 / 2 / 10


def test_projected_search_between_lengths(spark):
    rng = np.random.default_rng(1)
    weights, x = rng.normal(size=(6, 4)), rng.normal(size=(40, 6))
    image = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0]), (92, [0.0] * 6)], "id long, embedding array<double>")
    text = vectors.projected(image, weights)
    want = x @ weights
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    rows = {r.id: r.embedding for r in text.collect()}
    assert set(rows) == set(range(40)) | {92} and np.allclose([rows[i] for i in range(40)], want) and rows[92] == [0.0] * 4
    queries = image.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    got = vectors.cross_modal(queries, text, image.where("id < 40"), weights, 3).collect()
    for q in range(5):
        visual, read = x[q] @ x.T, want[q] @ want.T
        score = {}
        for part, w in ((visual, 0.5), (read, 0.5)):
            for i in np.argsort(-part, kind="stable")[:3]:
                score[int(i)] = score.get(int(i), 0) + w * part[i]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == sorted(score, key=lambda i: (-score[i], i))[:3]
