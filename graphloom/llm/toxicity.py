"""Toxicity by compression distance: a zstandard dictionary per class, compared window by window.

A window is one word (letters and digits, lower case) between sentinels.  Each class has a
raw-content dictionary of the windows that recur over its documents; the toxic one holds those
over-represented there.  A window that one dictionary holds whole compresses to a single match,
else to several matches and literals, so ``len(ordinary) - len(toxic)`` is a distance in bytes.
A document's score is a logistic function, calibrated on rows that the dictionaries did not see,
of the largest distances, of how many windows pass each distance threshold and of their share;
a text's length and its harmless windows are no input of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: Matched alike by both dictionaries, so that no window falls back to a stored block.
CARRIER = b" the of and to in that is for it with as by on are this be from or "
OPEN, CLOSE = b"\x02\x02\x02", b"\x03\x03\x03"
THRESHOLDS = (2, 4, 6)
MAX_TOXIC, MAX_ORDINARY = 2_000, 6_000
ORDINARY_WINDOWS, TOXIC_WINDOWS = 3_000, 1_500
MAX_SAMPLE_CHARS = 40_000_000
CACHE_WINDOWS = 500_000
LONGEST_WINDOW = 200

_cache: dict = {}


def windows(text: str) -> list[str]:
    """The words of a whole text; a run longer than ``LONGEST_WINDOW`` is cut into several."""
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST_WINDOW for w in found):
        found = [w[i : i + LONGEST_WINDOW] for w in found for i in range(0, len(w), LONGEST_WINDOW)]
    return found


def _wrap(window: str) -> bytes:
    return OPEN + window.encode("utf-8", "surrogatepass") + CLOSE


class Distance:
    """``len(compressed with ordinary) - len(compressed with toxic)`` of windows, with a bounded cache."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [self._compressor(x) for x in (ordinary, toxic)]
        self.cache: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        parameters = zstd.ZstdCompressionParameters(
            window_log=18, hash_log=13, chain_log=14, search_log=4, min_match=3, target_length=32, strategy=zstd.STRATEGY_BTOPT,
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content + CARRIER, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=parameters)

    def __call__(self, found: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WINDOWS:
            self.cache.clear()
        for w in {w for w in found if w not in self.cache}:
            data = CARRIER + _wrap(w)
            self.cache[w] = len(self.pair[0].compress(data)) - len(self.pair[1].compress(data))
        return np.fromiter(map(self.cache.__getitem__, found), np.int64, len(found))


def features(found: list[str], distance: Distance) -> list[float]:
    v = np.sort(distance(found))[::-1] if found else np.zeros(1, np.int64)
    n = max(len(v), 20)
    counts = [int((v >= t).sum()) for t in THRESHOLDS]
    return [float(v[0]), float(v[:3].mean()), *np.log1p(counts), *(min(100 * c / n, 50.0) for c in counts[1:])]


def fit(rows: list[tuple[str, int]]) -> dict:
    """A model from labelled texts (the bounded sample).

    With fewer than three rows of a class none is left to calibrate on: every score is the share of label 1.
    """
    toxic = sum(1 for _, y in rows if y)
    share = toxic / len(rows) if rows else 0.0
    if min(toxic, len(rows) - toxic) < 3:
        return {"share": share}
    # of each class two rows of three make the dictionaries, the third calibrates
    seen, own = [0, 0], []
    for _, y in rows:
        own.append(seen[y] % 3 != 2)
        seen[y] += 1
    in_toxic, in_ordinary, n = Counter(), Counter(), [0, 0]
    for (t, y), learn in zip(rows, own):  # the words of one text at a time
        if learn:
            (in_toxic if y else in_ordinary).update(set(windows(t)))
            n[y] += 1
    weigh = {w: (k + 0.5) / (n[1] + 1) / ((in_ordinary[w] + 0.5) / (n[0] + 1)) for w, k in in_toxic.items() if k >= min(3, n[1])}
    bad = sorted((w for w, r in weigh.items() if r > 6), key=lambda w: (in_toxic[w], w))[-TOXIC_WINDOWS:]
    plain = sorted((w for w, k in in_ordinary.items() if k >= min(3, n[0])), key=lambda w: (in_ordinary[w], w))[-ORDINARY_WINDOWS:]
    model = {"share": share, "ordinary": b"".join(map(_wrap, plain)), "toxic": b"".join(map(_wrap, bad))}
    distance = Distance(model["ordinary"], model["toxic"])
    use = [i for i in range(len(rows)) if not own[i]]
    x = np.array([features(windows(rows[i][0]), distance) for i in use])
    y = np.array([rows[i][1] for i in use], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    # the sample has more of the rarer class than the table; nothing reweighs it: the score is that of the sample
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return model | {"mean": mean, "scale": scale, "weights": w}


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of labelled texts: the rows of each class that come first by a hash of the id.

    At most ``max_toxic`` + ``max_ordinary`` rows, however many rows an id stands for, and, taken
    in that order, ``MAX_SAMPLE_CHARS`` characters; equal rows count once.  Rows whose label or
    text is null, and ids with both labels, are no training rows.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & learn)
    marked = marked.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most")
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = marked.where("_y = 1").orderBy(*order).limit(max_toxic).unionByName(marked.where("_y = 0").orderBy(*order).limit(max_ordinary))
    # at most max_toxic + max_ordinary narrow rows
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key")).where("_text is not null").join(F.broadcast(chosen), "_id")
    narrow = picked.groupBy("_id", "_key", "_y").agg(F.max(F.length("_text")).alias("n")).withColumn("h", F.xxhash64("_id"))
    first = [r for y, most in ((1, max_toxic), (0, max_ordinary)) for r in narrow.where(F.col("_y") == y).orderBy("h", "_id", "_key").limit(most).collect()]
    total, keys = 0, []
    for r in sorted(first, key=lambda r: (r.h, r["_id"], r["_key"])):
        if total + r.n <= MAX_SAMPLE_CHARS:
            total += r.n
            keys.append((r["_id"], r["_key"]))
    if not keys:
        return []
    keep = docs.sparkSession.createDataFrame(keys, T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_key", T.LongType())]))
    rows = picked.join(F.broadcast(keep), ["_id", "_key"]).groupBy("_id", "_key").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y"), F.min(F.xxhash64("_id")).alias("h")).collect()
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r.h, r["_id"], r["_text"]))]


def score_rows(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``(row, score)``: each input row as a struct beside its score; no shuffle, one batch in memory.

    A null text counts as empty; an empty text is scored like any other (no windows).
    """
    blob = dict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = None
        if "weights" in blob:
            key = hash((blob["ordinary"], blob["toxic"]))
            distance = _cache.get(key)
            if distance is None:
                _cache.clear()
                distance = _cache[key] = Distance(blob["ordinary"], blob["toxic"])
        for batch in batches:
            if distance is None:
                score = np.full(batch.num_rows, blob["share"])
            else:
                x = np.array([features(windows(t.as_py() or ""), distance) for t in batch.column(1)]).reshape(batch.num_rows, len(blob["mean"]))
                # summed row by row: a score does not depend on the batch that its row is in
                z = ((x - blob["mean"]) / blob["scale"] * blob["weights"][:-1]).sum(1) + blob["weights"][-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``; held-out labels are not learnt from.

    ``held_out`` is an expression over ``id_col``.  Null ids are carried (``held_out`` false),
    repeated rows each give a row, other columns are ignored, an empty table gives an empty
    result; without three learnt rows of each label every score is the share of label 1.
    """
    model = fit(sample(docs, labels.withColumn("_held", held_out), ~F.col("_held"), id_col=id_col, text_col=text_col, **sizes))
    scored = score_rows(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), model, text_col)
    return scored.select(F.col(f"row.{id_col}").alias(id_col), "score").select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
