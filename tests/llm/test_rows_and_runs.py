"""Very long runs, and rows whose ids are null or repeated."""

import hashlib
import re

import pytest
from graphloom.llm import decontaminate, pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
RUNS = ["1" * 50_000, "a@b" + ".c" * 20_000, "1." * 20_000, "+1" + " 2" * 20_000, "12 a " * 4_000, "a.b-c_d@" * 2_000, "4111 1111 1111 1111 x " * 1_000, "x" * 50_000]


def luhn(x: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(x)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in value.split("."))
    return {"email": True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def test_base_spans_of_very_long_runs(spark):
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string").repartition(8)).collect()}
    for i, text in enumerate(RUNS):
        kinds = {k: p for k, p in KINDS.items() if {"email": "@", "ip": ".", "card": "1", "phone": "+"}[k] in text}  # else Python's matcher is quadratic
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert got[6].n_card == 1_000 and got[1].n_email == 1


def test_templates_of_very_long_runs(spark):
    item = "What is the capital of France today, my dear friend?"
    rows = list(enumerate(RUNS)) + [(100, "word " * 50_000 + item)]
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i: i == 100 for i, _ in rows}


def test_rows_of_one_id_are_judged_alone(spark):
    item = "A heavy train leaves the old station at noon and reaches the sea before the sun goes down"
    rows = [(None, item), (None, "clean words without a number"), (7, "nothing to see here"), (7, "x. " + item), (8, None), (None, None)]
    out = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in out) == [("7", False), ("7", True), ("8", False), ("None", False), ("None", False), ("None", True)]
    docs = spark.createDataFrame([(*r, "h", "s") for r in rows], "doc_id long, text string, _hit string, row string")
    left = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(x)) for i, x in rows if item not in (x or ""))


def test_personal_data_of_rows_with_one_id(spark):
    seeds = [(i, f"Please mail us at user{i}@example.com today or never") for i in range(12)]
    rows = seeds + [(3, "Please mail us at user77(at)example today or never"), (None, "Please mail us at user78(at)example today or never"), (None, "nothing at all")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_discovered) for r in out if r.doc_id in (3, None)) == [("3", 0, 1), ("3", 1, 0), ("None", 0, 0), ("None", 0, 1)]


def test_pipeline_stages_keep_rows_of_null_and_repeated_ids_apart(spark):
    import corpus_pipeline

    folder, steps = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    say = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(None, say(i), "s", 1) for i in range(20)] + [(1, say(100), "s", 2), (1, say(101), "s", 3), (2, say(100), "t", 4), (3, say(102), "t", 5), (3, say(102), "t", 5), (4, None, None, 6), (5, "", "t", 7)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, source string, _times int, _hit string, row int")
    one = steps["near_duplicates"](spark, docs, folder)
    want = [r for i, r in enumerate(rows) if i not in (22, 24)]
    plain = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    assert one.columns == docs.columns and plain(one) == sorted((str(r[0]), str(r[1])) for r in want)
    fair = steps["decontamination"](spark, one, folder)
    assert fair.columns == docs.columns and plain(fair) == plain(one)
    mixed = steps["mixing"](spark, fair, folder)
    taken = [r for r in corpus_pipeline.mixing.mix(fair).collect() if r.taken]
    assert mixed.columns == docs.columns and mixed.count() == sum(-(-r.taken // r["size"]) for r in taken) and mixed.where("doc_id is null").count() < 60
    assert steps["token_shards"](spark, mixed, folder).count() == mixed.count()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), folder).count() == 0, name
