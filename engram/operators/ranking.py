"""Order, limit and shaping of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema
from engram.functions.vectors import reported, similarity_to

# Winners of a top-k are broadcast to fetch their texts; a longer list joins by shuffle.
MAX_BROADCAST_WINNERS = 10_000


def winners_first(winners: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(winners) if limit <= MAX_BROADCAST_WINNERS else winners


def newest(memories: DataFrame, limit: int) -> DataFrame:
    """A superset of the `limit` newest memories: those not older than the oldest of them.

    That time comes from a pass over created_at alone and is pushed into the scan of the
    other columns, which skips row groups of older memories (see `session.settings`).
    """
    times = memories.select("created_at").orderBy(F.desc("created_at")).limit(limit)
    return memories.where(F.col("created_at") >= times.agg(F.min("created_at")).scalar())


def recent(memories: DataFrame, limit: int = schema.RECENT_LIMIT) -> DataFrame:
    """Newest memories; a recency listing reports similarity 0."""
    return (
        newest(memories, limit)
        .select("id", "heading", "summary", "created_at", F.lit(0.0).alias("similarity"))
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def most_similar(
    memories: DataFrame,
    query: Sequence[float],
    limit: int = schema.STORE_SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD,
) -> DataFrame:
    """(id, similarity) of the closest memories to one vector, threshold before limit.

    Only id and embedding are read. Threshold, order and ties all go by the reported
    similarity; ties go to the lower id.
    """
    scored = memories.select(
        "id", reported(similarity_to("embedding", query)).alias("similarity")
    )
    return (
        scored.where(F.col("similarity") >= threshold)
        .orderBy(F.desc("similarity"), "id")
        .limit(limit)
    )


def topk_similar(
    memories: DataFrame,
    query: Sequence[float],
    limit: int = schema.STORE_SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD,
) -> DataFrame:
    """The closest memories with their texts, which are fetched for the winners only."""
    winners = most_similar(memories, query, limit, threshold)
    return memories.select("id", "heading", "summary", "created_at").join(
        winners_first(winners, limit), "id"
    )


def top_per_query(hits: DataFrame, limit: int) -> DataFrame:
    """Best `limit` hits of each query. The rank filter also trims before the shuffle, so a
    query with very many hits sends only `limit` rows per partition."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= limit
    )


def total_found(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of hits of every query, 0 included."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("found", F.lit(0).cast("long")).alias("total_found")
    )


def order_rank_recency(hits: DataFrame, limit: int = schema.SEARCH_LIMIT) -> DataFrame:
    return hits.orderBy(F.desc("rank"), F.desc("created_at"), "id").limit(limit)


def preview(hits: DataFrame, rows: int = schema.PREVIEW_ROWS) -> DataFrame:
    """The first hits in short, for display."""
    return (
        hits.orderBy(F.desc("similarity"), "id")
        .limit(rows)
        .select(
            "id",
            F.substring("heading", 1, schema.PREVIEW_HEADING_CHARS).alias("heading"),
            F.substring("summary", 1, schema.PREVIEW_SUMMARY_CHARS).alias("summary"),
            "similarity",
        )
    )


def result_shape(memories: DataFrame) -> DataFrame:
    """id, heading, summary and the creation time as ISO text."""
    return memories.select(
        "id",
        "heading",
        "summary",
        F.date_format("created_at", schema.ISO_FORMAT).alias("created_at"),
    )
