"""Decoding of a span recogniser's scores into mentions, by numpy in Arrow functions.

A recogniser scores each (first word, width, label); its scores come as one flat array a text, in
that order.  Decoding needs no model: sigmoid, threshold, places of the words in the text, and
suppression of spans that overlap a surer one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WIDTH, THRESHOLD = 12, 0.5
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _kept(sure: np.ndarray, confidence: np.ndarray, n: int, max_width: int, count: int) -> list[tuple[int, int, int, float]]:
    """``first, width, label, confidence`` of the candidates that stay, by first word; words that one holds are taken."""
    taken, out = bytearray(count), []
    order = np.lexsort((sure, -confidence))  # a score's place is its order by first word, width and label
    for i, c in zip(sure[order].tolist(), confidence[order].tolist()):
        first, width = i // (max_width * n), i // n % max_width
        if 1 not in taken[first : first + width + 1]:
            taken[first : first + width + 1] = b"\1" * (width + 1)
            out.append((first, width, i % n, c))
    return sorted(out)


def decoded(rows: DataFrame, labels: list[str], threshold: float = THRESHOLD, max_width: int = MAX_WIDTH, text_col: str = "text", scores_col: str = "scores", scorer: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``rows`` with ``mentions``: ``array<struct<start, end, text, label, confidence>>`` by start.

    ``scores_col`` holds ``words x max_width x labels`` raw scores of the text, row by row; a
    missing or null score is no candidate.  A candidate is a span inside the text with a sigmoid of at least
    ``threshold``.  Of overlapping ones the surest stays (ties: the earlier first word, the
    narrower, the earlier label).  A null or empty text, or no scores, has no mentions.  A
    ``scorer`` gives the scores of a text's words in place of the column, text by text, so they are
    never held for more than one.  The suppression marks the words that are taken: texts may be long.
    """
    n = len(labels)

    def found(text: str | None, scores: np.ndarray | None, known: np.ndarray | None = None) -> list[tuple]:
        words = list(WORD.finditer(text or ""))
        scores = scorer([m.group() for m in words]) if scorer else scores
        with np.errstate(over="ignore"):
            confidence = 1 / (1 + np.exp(-scores))
        sure = ~(confidence < threshold)  # what is not a number is sure, and the last to stay
        at = np.nonzero(sure if known is None else sure & known)[0]
        at = at[at // (max_width * n) + at // n % max_width < len(words)]
        kept = _kept(at, confidence[at], n, max_width, len(words)) if len(at) else []
        return [(words[f].start(), words[f + w].end(), " ".join(m.group() for m in words[f : f + w + 1]), labels[k], c) for f, w, k, c in kept]

    def listed(out: list[list[tuple]]) -> pa.Array:
        kinds = {"start": pa.int32(), "end": pa.int32(), "text": pa.string(), "label": pa.string(), "confidence": pa.float64()}
        fields = [pa.array([m[i] for row in out for m in row], kind) for i, kind in enumerate(kinds.values())]
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))

    kind = "array<struct<start:int,end:int,text:string,label:string,confidence:double>>"
    if scorer:
        return rows.withColumn("mentions", F.arrow_udf(lambda text: listed([found(t.as_py(), None) for t in text]), kind)(F.col(text_col)))

    def of_columns(text: pa.Array, scores: pa.Array) -> pa.Array:
        values = [s.values if s.is_valid else pa.array([], pa.float64()) for s in scores]
        return listed([found(t.as_py(), v.to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)) for t, v in zip(text, values)])

    return rows.withColumn("mentions", F.arrow_udf(of_columns, kind)(F.col(text_col), F.col(scores_col).cast("array<double>")))
