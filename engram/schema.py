"""Table schemas and the constants every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Column defaults and search defaults of the memory store.
DEFAULT_SOURCE = "chat"
DEFAULT_IMPORTANCE = 0.5
SEARCH_LIMIT = 10
SEARCH_THRESHOLD = 0.1
STORE_SEARCH_LIMIT = 5
RECENT_LIMIT = 20
DUPLICATE_LIMIT = 5
DUPLICATE_THRESHOLD = 0.3
PREVIEW_ROWS = 3
PREVIEW_HEADING_CHARS = 60
PREVIEW_SUMMARY_CHARS = 100
IVF_LISTS = 100
HEADING_WORDS = 10

# Similarities are reported, and ties are decided, at this many decimals: sums of
# float products differ in the last bits between plans, and ids must break real ties.
SIMILARITY_DECIMALS = 6

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def memories_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", id_type or T.StringType(), False),
            T.StructField("heading", T.StringType(), False),
            T.StructField("summary", T.StringType(), False),
            T.StructField("embedding", T.ArrayType(T.FloatType()), True),
            T.StructField("created_at", T.TimestampType(), False),
            T.StructField("updated_at", T.TimestampType(), False),
            T.StructField("context", T.StringType(), True),
            T.StructField("source", T.StringType(), True),
            T.StructField("importance_score", T.DoubleType(), True),
        ]
    )


def tags_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("memory_id", id_type or T.StringType(), False),
            T.StructField("tag", T.StringType(), False),
            T.StructField("created_at", T.TimestampType(), True),
        ]
    )


def metadata_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("memory_id", id_type or T.StringType(), False),
            T.StructField("key", T.StringType(), False),
            T.StructField("value", T.StringType(), False),
            T.StructField("created_at", T.TimestampType(), True),
        ]
    )
