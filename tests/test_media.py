import io
import wave

import numpy as np
from graphloom.operators import media, training
from pyspark.sql import functions as F


def test_segments_split_at_scenes_and_join_short_tails(spark):
    rows = [(1, t * 500, 0.9 if t in (1, 6, 12) else 0.0) for t in range(14)]
    frames = spark.createDataFrame(rows, "video_id long, timestamp_ms long, scene_change_score double")
    got = [(r.start_ms, r.end_ms, r.frames) for r in media.segments(frames).orderBy("segment").collect()]
    assert got == [(0, 3000, 6), (3000, 6500, 8)]


def test_histogram_and_sound(spark):
    x = spark.createDataFrame([(bytearray([0, 0, 0] * 4), bytearray([255, 255, 255] * 4))], "a binary, b binary")
    row = x.select(media.grey_histogram("a").alias("a"), media.grey_histogram("b").alias("b")).select(media.histogram_change(F.col("a"), F.col("b")).alias("d"), media.histogram_change(F.col("a"), F.col("a")).alias("z")).first()
    assert row.d == 1.0 and row.z == 0.0
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.full(1600, 16384, "<i2").tobytes())
    got = media.sound(spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")).first()
    assert got.seconds == 0.1 and abs(got.samples[100] - 0.5) < 1e-6


def test_training_rows(spark):
    nodes = spark.createDataFrame([(1, "a", "Entity"), (2, "b", "Entity"), (3, "c", "Event")], "id long, content string, node_type string")
    edges = spark.createDataFrame([(1, 2, "Actor", 1.7), (1, 3, "NextEpisode", 0.5), (3, 1, "Actor", 0.5)], "source long, target long, edge_type string, weight double")
    got = training.samples(nodes, edges).collect()
    assert [(r.id, [(x.object, x.confidence) for x in r.relations]) for r in got] == [(1, [("b", 1.0)])]
    parts = training.split(spark.range(1000), "id")
    assert abs(parts.where("split = 'train'").count() - 900) < 40
