"""Fitted classifiers on odd rows and long harmless texts, and the bound on what they learn from."""

import numpy as np
import pytest
from graphloom.llm import quality, toxicity
from graphloom.llm.queries import fold
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "Hello <|endoftext|>\n x"), (3, "again"), (None, "no id here"), (4, "alpha beta gamma delta " * 20_000), (5, "a" * 300_000), (6, "Hello"), (7, "Hello")]


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize("module, parts, held", [(toxicity, 3, 1), (quality, 5, 0)])
def test_fitted_models_score_every_odd_row(spark, module, parts, held):
    docs, marks = tables(spark)
    odd = spark.createDataFrame([(i and i + 10**7, t) for i, t in ODD], "doc_id long, text string")
    rows = docs.select("doc_id", "text").where("doc_id is not null").unionByName(odd)
    rows = rows.withColumn("score", F.lit("s")).withColumn("label", F.lit("l")).withColumn("row", F.lit(1))
    got = module.classify(rows, marks, fold(parts, held)).where("doc_id > 10000000 or doc_id is null").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i and i + 10**7) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert abs(score[10**7 + 1] - score[10**7 + 2]) < 1e-6 and abs(score[10**7 + 6] - score[10**7 + 7]) < 1e-6
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_length_alone_is_not_toxic(spark):
    docs, marks = tables(spark)
    rows = toxicity.sample(docs, marks.withColumn("_held", fold(3, 1)), ~F.col("_held"))
    clean = [t for t, y in rows if not y]
    texts = ["a " * 3_000, " ".join(clean[:100]), " ".join(clean), "", "word"]
    got = toxicity.score_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), toxicity.fit(rows)).collect()
    assert len(got) == len(texts) and all(r.score < 0.3 for r in got)


def test_scores_equal_a_plain_loop(spark):
    docs, marks = tables(spark)
    model = toxicity.fit(toxicity.sample(docs, marks.withColumn("_held", fold(3, 1)), ~F.col("_held")))
    ordinary, toxic = (toxicity.Distance._compressor(model[k]) for k in ("ordinary", "toxic"))

    def score(text):
        found = []
        for w in toxicity.WORD.findall((text or "").lower()):
            found += [w[i : i + toxicity.LONGEST_WINDOW] for i in range(0, len(w), toxicity.LONGEST_WINDOW)]
        data = [toxicity.CARRIER + toxicity.OPEN + w.encode() + toxicity.CLOSE for w in found]
        v = sorted((len(ordinary.compress(x)) - len(toxic.compress(x)) for x in data), reverse=True) or [0]
        passed = [sum(x >= t for x in v) for t in toxicity.THRESHOLDS]
        x = [v[0], sum(v[:3]) / len(v[:3]), *[np.log(1 + c) for c in passed], *[min(100 * c / max(len(v), 20), 50) for c in passed[1:]]]
        return 1 / (1 + np.exp(-sum((a - m) / s * w for a, m, s, w in zip(x, model["mean"], model["scale"], model["weights"])) - model["weights"][-1]))

    rows = toxicity.score_rows(docs.where("doc_id < 300"), model).select("row.text", "score").collect()
    assert max(abs(score(r.text) - r.score) for r in rows) < 1e-9


def test_sample_is_bounded_in_rows(spark):
    one = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    same = spark.range(300).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    marks = spark.createDataFrame([(7, 1), (8, 0), (9, 1), (9, 0)], "doc_id long, toxic int")
    docs = one.unionByName(same).unionByName(spark.createDataFrame([(9, "both"), (7, None)], "doc_id long, text string"))
    got = toxicity.sample(docs, marks, F.lit(True), max_toxic=40, max_ordinary=10)
    assert sum(y for _, y in got) == 40 and [t for t, y in got if not y] == ["the same text"]
    assert got == toxicity.sample(docs.repartition(5), marks, F.lit(True), max_toxic=40, max_ordinary=10)


def test_toxicity_fit_holds_the_words_of_one_text():
    """The driver never holds all words of the sample: here 1.2 million, some 60 MB as a list of strings."""
    import tracemalloc

    rows = [(" ".join(f"word{(i * 7 + j) % 900}" for j in range(2_000)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    tracemalloc.start()
    model = toxicity.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "weights" in model and peak < 20 << 20
