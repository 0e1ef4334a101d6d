"""Fixed values of the data model: node, edge, mindset and state names."""

from pyspark.sql import types as T

# Enumerations of the data model.
NODE_TYPES = ["Entity", "Event", "Fact", "Skill"]
EDGE_TYPES = ["RelatesTo", "CausedBy", "ConflictsWith", "NextEpisode", "HasProperty", "Supersedes", "Actor", "Object", "Location", "Companion"]
RELATION_TYPES = ["RelatesTo", "CausedBy", "HasProperty", "Actor", "Object", "Location", "Companion"]
MINDSETS = ["Convergent", "Divergent", "Algorithmic", "Spatial"]
STATES = ["Accepted", "Contradiction", "Superseded", "Ambiguous"]
MEDIA_TYPES = ["text", "audio", "image", "video_segment"]

NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("namespace", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("source", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
