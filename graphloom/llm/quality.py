"""Quality classifier: a byte-level convolutional network in numpy, applied over whole texts.

Bytes are embedded; filters of ``WIDTH`` bytes slide with stride ``STRIDE``; chunks of two
neighbouring halves overlap by one half and cover the whole document.  Each filter is max-pooled
over a chunk, the chunks' pooled values are averaged and their minimum is kept beside it, and a
small dense layer combines them into one probability.

Applying it never multiplies matrices per position: embedding and filter are folded into one
table per tap (256 x filters), so a position is ``WIDTH`` table rows added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.toxicity import sample

WIDTH, STRIDE, FILTERS, EMBED, HIDDEN = 8, 2, 24, 8, 16
HALF = 128  # bytes
POSITIONS = HALF // STRIDE
TAIL = WIDTH - STRIDE
BLOCK_BYTES = 256 << 10
MAX_LOW, MAX_HIGH, STEPS, BATCH, CHUNKS = 2_000, 4_000, 500, 64, 4


def _padded(text: str) -> np.ndarray:
    """The text's bytes, zero-filled to whole halves (one at least) and the filters' tail."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(max(1, -(-len(raw) // HALF)) * HALF + TAIL, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def half_maxima(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Per half (``HALF`` bytes of positions) the largest value of each filter, in blocks of bounded size."""
    n, out = (len(data) - TAIL) // HALF, []
    step = BLOCK_BYTES // HALF
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = data[lo * HALF : hi * HALF + TAIL]
        count = (hi - lo) * POSITIONS
        total = tables[0][part[0 : count * STRIDE : STRIDE]]
        for tap in range(1, WIDTH):
            total += tables[tap][part[tap : tap + count * STRIDE : STRIDE]]
        out.append(total.reshape(hi - lo, POSITIONS, -1).max(1))
    return np.concatenate(out)


def _dense(pooled: np.ndarray, m: dict) -> np.ndarray:
    hidden = np.maximum((pooled - m["mean"]) / m["scale"] @ m["w1"] + m["b1"], 0)
    return hidden @ m["w2"] + m["b2"]


def pool(text: str, m: dict) -> np.ndarray:
    """Mean and minimum over overlapping chunks of the max-pooled filters."""
    halves = half_maxima(_padded(text), m["tables"])
    chunks = halves if len(halves) == 1 else np.maximum(halves[:-1], halves[1:])
    chunks = np.maximum(chunks + m["bias"], 0)
    return np.concatenate([chunks.mean(0), chunks.min(0)])


def probabilities(texts: list[str], m: dict) -> np.ndarray:
    if "tables" not in m:
        return np.full(len(texts), m["share"])
    if not texts:
        return np.zeros(0)
    z = _dense(np.array([pool(t, m) for t in texts]), m)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 7) -> dict:
    """Train on a bounded sample: first the filters end to end on random chunks, then the dense layer on whole texts."""
    y_all = np.array([y for _, y in rows], float)
    share = float(y_all.mean()) if len(rows) else 0.0
    if not len(rows) or share in (0.0, 1.0):
        return {"share": share}
    rng = np.random.default_rng(seed)
    data = [_padded(t) for t, _ in rows]
    span = 2 * HALF + TAIL
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filter": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
        "w": rng.normal(0, 0.3, FILTERS), "b": np.zeros(1),
    }
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    by_class = [np.flatnonzero(y_all == c) for c in (0, 1)]
    taps = np.arange(0, 2 * HALF, STRIDE)[:, None] + np.arange(WIDTH)[None, :]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
        y = y_all[pick]
        x = np.zeros((BATCH, CHUNKS, span), np.uint8)
        for i, d in enumerate(pick):
            n = (len(data[d]) - TAIL) // HALF
            for j, at in enumerate(rng.integers(0, max(1, n - 1), CHUNKS)):
                part = data[d][at * HALF : at * HALF + span]
                x[i, j, : len(part)] = part
        x = x.reshape(-1, span)
        columns = p["embed"][x[:, taps]].reshape(len(x), len(taps), -1)  # chunk, position, taps x embedding
        response = columns @ p["filter"]
        best = response.argmax(1)
        top = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + p["bias"]
        active = np.maximum(top, 0)
        pooled = active.reshape(BATCH, CHUNKS, FILTERS).mean(1)
        prob = 1 / (1 + np.exp(-np.clip(pooled @ p["w"] + p["b"], -30, 30)))
        g = (prob - y) / BATCH
        grad = {"w": pooled.T @ g, "b": g.sum(keepdims=True)}
        g_top = np.repeat(g[:, None] * p["w"][None, :] / CHUNKS, CHUNKS, 0) * (top > 0)
        grad["bias"] = g_top.sum(0)
        chosen = np.take_along_axis(columns, best[:, :, None], 1)  # chunk, filter, taps x embedding
        grad["filter"] = np.einsum("nfd,nf->df", chosen, g_top)
        g_column = (g_top[:, :, None] * p["filter"].T[None]).reshape(-1, WIDTH, EMBED)
        bytes_at = x[np.arange(len(x))[:, None, None], taps[best]].reshape(-1, WIDTH)
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], bytes_at, g_column)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in grad.items():  # Adam
            m1[k] += 0.1 * (v - m1[k])
            m2[k] += 0.01 * (v * v - m2[k])
            p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    tables = np.stack([p["embed"] @ p["filter"][t * EMBED : (t + 1) * EMBED] for t in range(WIDTH)]).astype(np.float32)
    model = {"share": share, "tables": tables, "bias": p["bias"].astype(np.float32)}
    x = np.array([pool(t, model) for t, _ in rows])
    model |= {"mean": x.mean(0), "scale": x.std(0) + 1e-3} | {"w1": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, HIDDEN), "b2": np.zeros(())}
    z = (x - model["mean"]) / model["scale"]
    dense = ("w1", "b1", "w2", "b2")
    m1, m2 = {k: np.zeros_like(model[k]) for k in dense}, {k: np.zeros_like(model[k]) for k in dense}
    for step in range(1, 4 * steps + 1):
        pick = rng.integers(0, len(rows), min(256, len(rows)))
        xb, y = z[pick], y_all[pick]
        hidden = np.maximum(xb @ model["w1"] + model["b1"], 0)
        prob = 1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -30, 30)))
        g = (prob - y) / len(pick)
        gh = g[:, None] * model["w2"][None, :] * (hidden > 0)
        grad = {"w1": xb.T @ gh + 1e-4 * model["w1"], "b1": gh.sum(0), "w2": hidden.T @ g + 1e-4 * model["w2"], "b2": g.sum()}
        rate = 0.01 * (1 - step / (4 * steps + 1))
        for k, v in grad.items():
            m1[k] = m1[k] + 0.1 * (v - m1[k])
            m2[k] = m2[k] + 0.01 * (v * v - m2[k])
            model[k] = model[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", max_low: int = MAX_LOW, max_high: int = MAX_HIGH, steps: int = STEPS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``; held-out labels are not learnt from.

    The score is the probability of quality 1 for the share of classes in the sample.  A null
    text counts as empty (one chunk of zeros), null ids are carried (``held_out`` false), repeated
    rows each give a row, other columns are ignored, an empty table gives an empty result;
    without labels of both classes every score is the share of label 1.
    """
    rows = sample(docs, labels.withColumn("_held", held_out), ~F.col("_held"), "quality", max_high, max_low, id_col, text_col)
    model = fit(rows, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(texts, model), pa.float64())], ["id", "score"])

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows_in.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "score").select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
