"""Types, edge tokens, weights and gates."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values
MEMORY_TYPES = ("preference", "skill", "goal", "opinion", "fact", "action", "experience", "achievement")
PROTECTED_TYPES = ("preference", "goal", "opinion")
EDGE_TYPES = ("IMPLIES", "BECAUSE", "CONTRADICTS", "SUPPORTS", "RELATES_TO", "PART_OF", "IS_A")
EDGE_WEIGHTS = {"BECAUSE": 1.0, "IMPLIES": 0.9, "CONTRADICTS": 0.4}
RELATION_WEIGHT = 0.7
REVERSE_DAMPING = {"IMPLIES": 0.9, "BECAUSE": 0.85, "CONTRADICTS": 0.8}
RELATION_DAMPING = 0.6
TERMINAL_STATUS = ("done", "failed", "offline", "stopped", "disconnected", "farewell")

MEMORY = T.StructType([
    T.StructField("memory_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("memory_type", T.StringType()), T.StructField("certainty", T.LongType()), T.StructField("importance", T.LongType()),
    T.StructField("created_at", T.StringType()), T.StructField("valid_from", T.StringType()), T.StructField("context_tags", T.StringType()),
    T.StructField("content_key", T.StringType()),
])
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("edge_type", T.StringType()), T.StructField("strength", T.LongType())])
INSIGHT = T.StructType([T.StructField("insight_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("created_at", T.StringType())])
PENDING = T.StructType([T.StructField("pending_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("raw_message", T.StringType()), T.StructField("created_at", T.TimestampType())])
