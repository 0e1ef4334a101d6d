"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns - and brute-force versions."""

import hashlib
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from graphloom.llm import decontaminate, embedding_dedup, licenses, minhash, mixing, pii, quality, sstable, token_counts, toxicity
from graphloom.llm.queries import fold
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "alpha beta gamma delta " * 30_000
ODD = [(1, None, "a"), (2, "", None), (3, "Hello <|endoftext|> it's\n  a\ttest…  x", "a"), (3, "again", "b"), (None, "no id here at all", "b"), (4, LONG, "b"), (5, "Hello", "a"), (6, "Hello", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Two columns whose names clash with names that the operators use inside."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.withColumn("id", F.lit("x")).withColumn("size", F.lit(1)).withColumn("score", F.lit("s")).withColumn("key", F.lit(2)).withColumn("label", F.lit("l"))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def operators(spark):
    return {
        "op1": lambda d: decontaminate.decontaminate(d, benchmark(spark, [(1, "no id here at all"), (None, "x"), (2, None)])),
        "op2": mixing.mix,
        "op3": minhash.near_duplicates,
        "op4": lambda d: token_counts.count_tokens(d, WORD),
        "op5": pii.find,
        "op6": lambda d: sstable.token_shards(d, BYTE),
        "op7": lambda d: toxicity.classify(d, labels(spark), fold(3, 1)),
        "op8": licenses.recognise,
        "op10": lambda d: quality.classify(d, labels(spark), fold(5, 0)),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    rows = run(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(x[0]) for x in ODD)
    assert run(odd.limit(0)).count() == 0


def test_token_counts_are_the_library_s(spark, odd):
    t = Tokenizer.from_file(WORD)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in ODD)
    got = token_counts.count_tokens(odd, WORD).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.doc_id for r in got if r.over_limit} == {4}


def test_shards_round_trip_and_lookup(spark, tmp_path):
    t = Tokenizer.from_file(BYTE)
    rows = [(i, f"text {i} " * (i % 40)) for i in range(-50, 400)] + [(None, "z"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = sstable.write_shards(docs, f"file://{tmp_path}", BYTE, shard_bytes=20_000)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(manifest).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x)
    for i, start, n, crc in got:
        ids = [np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4") for x in texts[i]]
        assert start == at and any(len(x) == n and zlib.crc32(x.tobytes()) == crc for x in ids)
        at += n
    assert manifest.count() > 1
    assert [x.tolist() for x in sstable.lookup(manifest, 399)] == [t.encode(dict(rows)[399], add_special_tokens=False).ids + [0]]
    assert len(sstable.lookup(manifest, 7)) == 2 and len(sstable.lookup(manifest, None)) == 1 and sstable.lookup(manifest, 10**9) == []


def test_mix_meets_each_budget(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}" if i % 5 else None) for i in range(2_000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    targets = {}
    for s in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == s]
        targets[s] = own[0].target
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r["size"] for r in own)
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [list(rng.choice(vocabulary, 120)) for _ in range(6)]
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(w)))
    rows += [(500, rows[0][1].upper() + "!"), (501, "short one"), (502, "Short, one."), (503, "..."), (504, "???")]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        similar = minhash.weighted_jaccard([a] * (len(rows) - k - 1), [b for _, b in rows[k + 1 :]])
        for (j, _), s in zip(rows[k + 1 :], similar):
            if s >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, _ in rows}
    assert got[500] == got[0] and got[502] == 501 and got[504] == 504


def test_words_by_unicode_class(spark):
    plain = " ".join(f"he said \"word{i}\" - and left..." for i in range(40))
    curly = plain.replace(' "', " \u201c").replace('"', "\u201d").replace("-", "\u2014").replace("...", "\u2026").replace("and left", "and\u00a0left")
    rng = np.random.default_rng(4)
    for_ = lambda low, high: "".join(chr(c) for c in rng.integers(low, high, 300))
    chinese, thai = for_(0x4E00, 0x9FA0), for_(0x0E01, 0x0E2F)
    other = lambda x: x[:150] + "\u3002" + x[151:]
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"
    rows = [(1, plain), (2, curly), (3, chinese), (4, other(chinese)), (5, thai), (6, other(thai)), (7, for_(0x4E00, 0x9FA0))]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert [len(minhash.word_hashes([x])[0]) for x in (hindi, "\u65e5\u672c go", "\u0e01\u0e34\u0e19", "a\u0301b", "\u00e9\u20ac\u00fc")] == [1, 3, 2, 1, 2]


def test_signatures_estimate_weighted_jaccard():
    a, b = " ".join(f"x{i % 50}" for i in range(600)), " ".join(f"x{i % 50}" for i in range(450)) + " y" * 60
    s, d, w, _ = minhash.multisets([a, b])
    signature = minhash.bag_minhash(s, d, w, 2, 8_192)
    assert abs((signature[0] == signature[1]).mean() - minhash.weighted_jaccard([a], [b])[0]) < 0.03


def test_template_windows_catch_new_numbers_and_names(spark):
    item = "Maria bought 3 apples for 12 dollars. How many apples would Maria get for 48 dollars at the same price?"
    docs = [(1, "So. " + item.replace("Maria", "Peter").replace("12", "20").replace("48", "80").replace("3", "5")), (2, item.replace("would Maria", "would Susan").replace("48", "12")), (3, "Some quite other words stand here, and nothing else is said."), (4, item.upper())]
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), benchmark(spark, [(9, item)])).collect()
    assert {r.doc_id: r.contaminated for r in rows} == {1: True, 2: False, 3: False, 4: True}


def test_short_items_inside_a_line_and_in_one_case(spark):
    items = ["Who wrote Hamlet?", "Name the longest river.", "What is the capital of France?", "A train leaves Rome at noon today", "In which year did Ada Lovelace die?"]
    forms = ["Q: {}", "Here is one: \"{}\"", "- {}", "({})", "so I asked {} and left"]
    docs = [(f.format(c(i)), k) for k, i in enumerate(items) for f in forms for c in (str, str.lower, str.upper)]
    # words in the place of names are held to be the same word
    docs += [("We know that Paris is the capital of Spain", None), ("and Which is the capital of Spain", None)]
    rows = [(n, t) for n, (t, _) in enumerate(docs)]
    got = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark(spark, list(enumerate(items)))).collect()}
    assert [t for n, (t, k) in enumerate(docs) if list(got[n].item_ids) != ([] if k is None else [k])] == []


def test_a_changed_slot_drops_only_its_windows(spark):
    items = {
        1: "Yesterday the gardener Maria planted some roses behind the house, then Maria watered all of them and Maria went home to sleep",
        2: "On foot he walked 5 km along the river and came back after 5 days with nothing but his old hat and a story to tell",
        3: "In the morning 3 geese and a duck crossed the old road near the mill, and in the evening 7 geese came back without the duck",
        4: "At noon old Peter gave an apple to young Susan while nobody looked at the tree",
    }
    docs = [(1, items[1].replace("and Maria", "and Marja")), (2, items[2].replace("5 days", "6 days")), (3, items[3].replace("7", "3")), (4, items[4].replace("Susan", "Peter"))]
    rows = decontaminate.decontaminate(spark.createDataFrame([(i, "So it was. " + x) for i, x in docs], "doc_id long, text string"), benchmark(spark, items.items())).collect()
    got = {r.doc_id: r for r in rows}
    assert {i: list(r.item_ids) for i, r in got.items()} == {i: [i] for i in items}
    assert got[1].coverage < 1 and got[2].coverage < 1 and got[4].coverage == 1


def test_base_spans_by_brute_force(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(x):
        total = 0
        for i, c in enumerate(reversed(x)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    def holds(k, v):
        g = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if k == "ip" else True, "card": 16 <= len(g) <= 19 and luhn(g), "phone": 8 <= len(g) <= 15}[k]

    texts = ["a@b.c@d.e a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (2)", "é😀 a.b+c@x-y.z, +49 (0) 171-234567. 000001.2.3.4", "4111111111111111 4111-1111-1111-1112\n+1234567890123456 +12345678"]
    for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, texts[r.doc_id]) if holds(k, m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"Please mail us at user{i}@example.com today or never") for i in range(12)]
    rows = seeds + [(100, "Please mail us at user77(at)example today or never"), (101, "He had 12 apples on Monday")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_discovered == 1 and got[100].spans.startswith("email:18:") and got[101].n_discovered == 0 and got[0].n_email == 1


def test_patterns_discover_identifiers_without_a_digit(spark):
    names = "ann bob carl dora emil fred gina hans ida jane kurt lena mona nils olga paul rosa sven tina udo vera wim xenia yves zoe".split()
    seeds = [(i, f"Please mail us at {n}.doe@example.com today or never") for i, n in enumerate(names)]
    new = ["jane(at)example", "jane.doe@localhost", "jane_doe"]
    rows = seeds + [(100 + i, f"Please mail us at {n} today or never") for i, n in enumerate(new)] + [(200, "Please come home today or never"), (201, "Please wait (e.g. here) today or never")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i].spans for i in range(3)] == [f"email:18:{18 + len(n)}" for n in new]
    assert [got[i].n_discovered for i in (0, 200, 201)] == [0, 0, 0] and got[0].n_email == 1


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 30, 0) + rng.normal(scale=0.12, size=(600, 16))
    x[10] = x[11]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, x[0].tolist(), None), (1004, [1.0], 1), (1005, [2.0], 1), (None, x[0].tolist(), 0), (1006, [None] * 16, 1)]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), cell_rows=60, block_rows=32).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(600) % 3
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    component = np.arange(600)
    for _ in range(600):
        component = np.minimum(component, np.where(linked, component[None, :], 10**9).min(1))
    by_id = {r.vec_id: r for r in got}
    assert linked.sum() > 100
    assert all(by_id[i].n_links == linked[i].sum() and by_id[i].component_id == component[i] and by_id[i].kept == (component[i] == i) for i in range(600))
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i for i in (1000, 1001, 1002, 1003, 1006)) and by_id[1004].n_links == 1
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_license_rules_need_their_order(spark):
    mit = " ".join(s for i, s in licenses.SENTENCES if i in ("mit-grant", "mit-notice", "mit-warranty"))
    bsd = [s for i, s in licenses.SENTENCES if i in ("bsd-grant", "bsd-source", "bsd-binary")]
    rows = [(1, "Copyright me\n" + mit), (2, " ".join(bsd)), (3, " ".join(bsd[::-1])), (4, "x\nReleased under the MIT license!\ny"), (5, "released under the mit licence")]
    got = {r.doc_id: list(r.licenses) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["BSD-2-Clause"], 3: [], 4: ["MIT"], 5: []}


def test_every_license_rule_matches_its_own_text(spark):
    text = dict(licenses.SENTENCES[::-1])
    rows, want = [], []
    for name, ids in licenses.RULES:
        whole = " ".join(text[i] for i in ids)
        wrapped = textwrap.fill(whole, 72, break_on_hyphens=False)
        comment = "# Copyright 2020 Some Body\n" + textwrap.indent(textwrap.fill(whole, 60, break_on_hyphens=False), "# ") + "\nimport os\n"
        for x in (whole, wrapped, wrapped.replace("\n", "\r\n"), comment):
            rows.append((len(rows), x))
            want.append(name)
    rows.append((len(rows), "Released under the MIT\n\nLicense"))
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, n) for i, n in enumerate(want) if n not in got[i].licenses] == []
    assert got[len(want)].sentence_ids == "" and got[len(want)].n_matches == 0


@pytest.mark.parametrize("module, column, parts, held, least", [(toxicity, "toxic", 3, 1, 0.85), (quality, "quality", 5, 0, 0.93)])
def test_held_out_accuracy(spark, module, column, parts, held, least):
    folder = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = module.classify(docs, marks, fold(parts, held)).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[column] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    scores = toxicity.score_rows(docs, toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{folder}/labels.parquet").withColumn("_held", fold(3, 1)), ~F.col("_held")))).select("row.doc_id", "score").collect()
    clean = steps["toxicity"](spark, docs, folder)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores if r.score < 0.7}
    one = steps["near_duplicates"](spark, clean, folder)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in minhash.near_duplicates(clean).collect() if r.kept}
    fair = steps["decontamination"](spark, one, folder)
    flat = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {r.doc_id for r in fair.collect()} == {r.doc_id for r in one.collect() if not any(i in flat(r.text) for i in items)}
    mixed = steps["mixing"](spark, fair, folder)
    times = {r.doc_id: -(-r.taken // r["size"]) if r["size"] else 0 for r in mixing.mix(fair).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(times.values())
    last = steps["token_shards"](spark, mixed, folder)
    assert last.count() == mixed.count()
