"""Media rows: frame segments (W8), frame histograms (A19), sound (S31) as grouped or batched functions."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "video_id long, segment int, start_ms long, end_ms long, frames int"


def segments(frames: DataFrame, threshold: float = 0.3, shortest_ms: int = 1_000, longest_ms: int = 30_000) -> DataFrame:
    """Segments of each video's frames ``(video_id, timestamp_ms, scene_change_score)``.

    A frame opens a segment if the scene changes enough after the shortest length, or at the
    longest length; a short tail joins the segment before.  The fold depends on order, so a video
    is one group; its rows are three numbers a frame.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("timestamp_ms")
        cuts, start = [], None
        for at, score in zip(g.timestamp_ms, g.scene_change_score):
            if start is None or (score >= threshold and at - start >= shortest_ms) or at - start >= longest_ms:
                cuts.append(at)
                start = at
        last = g.timestamp_ms.max()
        if len(cuts) > 1 and last - cuts[-1] < shortest_ms:
            cuts.pop()
        number = np.searchsorted(cuts, g.timestamp_ms, side="right") - 1
        rows = g.assign(segment=number).groupby("segment").timestamp_ms.agg(["min", "count"])
        ends = [*cuts[1:], last]
        return pd.DataFrame({"video_id": g.video_id.iloc[0], "segment": rows.index, "start_ms": cuts, "end_ms": ends, "frames": rows["count"].to_numpy()})

    return frames.where("video_id is not null and timestamp_ms is not null").groupBy("video_id").applyInPandas(fold, SEGMENT)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def grey_histogram(pixels: pd.Series) -> pd.Series:
    """256 shares of grey levels of interleaved 8-bit RGB pixels."""

    def one(raw: bytes | None) -> list[float]:
        rgb = np.frombuffer(raw or b"", np.uint8)
        rgb = rgb[: len(rgb) // 3 * 3].reshape(-1, 3)
        grey = (rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
        return (np.bincount(grey, minlength=256) / max(1, len(grey))).tolist()

    return pixels.map(one)


def histogram_change(a, b):
    """Half the symmetric chi-square distance of two histograms, within 0 and 1."""
    term = lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)
    return F.least(F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(1.0))


def sound(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """``(path, seconds, samples)`` of WAV files ``(path, content)``: mono, linear resampling to ``rate``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decoded(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> list[float]:
            with wave.open(io.BytesIO(raw)) as w:
                kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[w.getsampwidth()]
                x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(float)
                x = (x - 128) / 128 if w.getsampwidth() == 1 else x / 2.0 ** (8 * w.getsampwidth() - 1)
                x = x.reshape(-1, w.getnchannels()).mean(1)
                n = int(round(len(x) * rate / w.getframerate()))
                return np.interp(np.arange(n) * w.getframerate() / rate, np.arange(len(x)), x).astype(np.float32).tolist()

        return content.map(one)

    return files.select("path", decoded("content").alias("samples")).withColumn("seconds", F.size("samples") / float(rate))
