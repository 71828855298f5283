"""The searches a user calls: semantic, text, metadata, hybrid, and context fetching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema
from engram.operators import chats, filters, knn
from engram.operators.aggregates import with_tags
from engram.operators.ranking import most_similar, newest, winners_first
from engram.operators.skew import MAX_BROADCAST_IDS
from engram.plans.memorize import Model
from engram.sources.workspace import written


def search_semantic(
    memories: DataFrame,
    tags: DataFrame,
    query: Sequence[float],
    threshold: float = schema.SEARCH_THRESHOLD,
    limit: int = schema.SEARCH_LIMIT,
    min_importance: float | None = 0.0,
    source: str | None = None,
    tag: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Closest memories to a vector under optional filters, with all their tags.

    Cheap filters come before any vector is scored; only ids and vectors are ranked, and
    texts and tags are fetched for the winners. Those are written, `limit` rows at most,
    because two joins read them and the vectors should be scored once.
    """
    kept = filters.by_importance(memories, min_importance)
    kept = filters.by_source(kept, source)
    kept = filters.by_dates(kept, date_from, date_to)
    kept = filters.by_tag(kept, tags, tag)
    winners = written(most_similar(kept, query, limit, threshold), "winners")
    found = memories.select(
        "id", "heading", "summary", "context", "importance_score", "created_at"
    ).join(winners_first(winners, limit), "id")
    ids = winners.select(F.col("id").alias("memory_id"))
    their_tags = tags.join(winners_first(ids, limit), "memory_id", "left_semi")
    return with_tags(found, their_tags).withColumnRenamed("id", "memory_id")


def search_metadata(
    memories: DataFrame,
    tags: DataFrame,
    metadata: DataFrame,
    project: str | None = None,
    any_tag: Sequence[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    limit: int = schema.SEARCH_LIMIT,
) -> DataFrame:
    """Newest memories that pass the project, tag and date filters."""
    kept = _metadata_filters(memories, tags, metadata, project, any_tag, date_from, date_to)
    return (
        kept.select("id", "heading", "summary", "created_at")
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def search_hybrid(
    memories: DataFrame,
    tags: DataFrame,
    metadata: DataFrame,
    query: Sequence[float],
    project: str | None = None,
    any_tag: Sequence[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    threshold: float = schema.SEARCH_THRESHOLD,
    limit: int = schema.SEARCH_LIMIT,
) -> DataFrame:
    """Closest memories to a vector among those that pass the metadata filters."""
    kept = _metadata_filters(memories, tags, metadata, project, any_tag, date_from, date_to)
    winners = winners_first(most_similar(kept, query, limit, threshold), limit)
    return memories.select("id", "heading", "summary", "created_at").join(winners, "id")


def _metadata_filters(memories, tags, metadata, project, any_tag, date_from, date_to):
    kept = filters.by_dates(memories, date_from, date_to)
    kept = filters.by_project(kept, metadata, project)
    return filters.by_any_tag(kept, tags, any_tag)


def fetch_context(
    memories: DataFrame,
    requests: DataFrame,
    dimension: int,
    date_filter: str | None = None,
    model: Model | None = None,
    **options,
) -> DataFrame:
    """Answer a table of requests, from memories created on or after `date_filter` if given.

    requests: query_id, query (text), embedding of the text, and optionally search_type,
    limit (10) and threshold (0.1). With a model the texts are embedded here. A semantic request with a non-empty query is answered
    by similarity, any other by recency; search_type_used says which. A request may ask for any
    number of rows; one that asks for none gets none.
    """
    memories = filters.since(memories, date_filter)
    if model is not None:
        texts = requests.drop("embedding").withColumn("text", F.col("query"))
        requests = chats.embed_texts(texts, model)
    have = set(requests.columns)

    def given(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    limit = given("limit", schema.SEARCH_LIMIT)
    asked = requests.select(
        "query_id",
        "embedding",
        limit.alias("limit"),
        given("threshold", schema.SEARCH_THRESHOLD).cast("double").alias("threshold"),
        F.when(
            (given("search_type", "semantic") == "semantic")
            & (F.coalesce("query", F.lit("")) != ""),
            "semantic",
        ).otherwise("recent").alias("search_type_used"),
    )
    semantic = asked.where(F.col("search_type_used") == "semantic").drop("search_type_used")
    # Each request carries its own limit and threshold into the scan.
    close = knn.nearest_each(memories, semantic, dimension, **options)
    texts = ["id", "heading", "summary", "created_at"]
    close = close.select("query_id", F.lit("semantic").alias("search_type_used"), "rank", "id", "similarity")
    # Hits are at most as many as the requests ask for.
    counted = asked.groupBy("search_type_used").agg(F.sum("limit").alias("rows"), F.max("limit").alias("most"))
    asked_for = {r["search_type_used"]: r for r in counted.collect()}
    hits_at_most = asked_for["semantic"]["rows"] if "semantic" in asked_for else 0
    most_recent_rows = max(1, asked_for["recent"]["most"]) if "recent" in asked_for else 1
    if (hits_at_most or 0) <= MAX_BROADCAST_IDS:
        close = F.broadcast(close)
    close = memories.select(*texts).join(close, "id").select(
        "query_id", "search_type_used", "rank", "similarity", *texts
    )
    latest = (
        newest(memories, most_recent_rows).select(*texts)
        .orderBy(F.desc("created_at"), "id").limit(most_recent_rows)
    )
    # As many rows as a request asks for; every task may hold them if they are few.
    numbered = latest.withColumn(
        "rank",
        F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long"),
    )
    if most_recent_rows <= MAX_BROADCAST_IDS:
        numbered = F.broadcast(numbered)
    by_recency = (
        asked.where((F.col("search_type_used") == "recent") & (F.col("limit") > 0))
        .select(
            "query_id", "search_type_used",
            F.explode(
                F.sequence(F.lit(1).cast("long"), F.col("limit").cast("long"))
            ).alias("rank"),
            F.lit(0.0).alias("similarity"),
        )
        .join(numbered, "rank")
        .select(close.columns)
    )
    return close.unionByName(by_recency)
