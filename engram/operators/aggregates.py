"""Tags per memory, activity and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEW_COLUMNS = [
    "id", "heading", "summary", "context", "source", "importance_score", "created_at",
    "updated_at",
]


def join_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per (memory, tag); untagged memories stay with a NULL tag."""
    return memories.join(
        tags.select(F.col("memory_id").alias("id"), "tag"), "id", "left"
    )


def tags_array(tags: DataFrame) -> DataFrame:
    """Sorted distinct tags per memory, in one shuffle. The sets are built before it, so a
    memory that was tagged very often sends each tag once per partition."""
    return tags.groupBy(F.col("memory_id").alias("id")).agg(
        F.array_sort(F.collect_set("tag")).alias("tags")
    )


def with_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """Add the tags column: an empty array, not NULL, for untagged memories."""
    empty = F.array().cast("array<string>")
    return memories.join(tags_array(tags), "id", "left").withColumn(
        "tags", F.coalesce("tags", empty)
    )


def memories_with_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    return with_tags(memories.select(*VIEW_COLUMNS), tags)


def count_total(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count(F.lit(1)).alias("total_memories"))


def _within(days: int, as_of: str, column: str = "created_at") -> Column:
    return F.col(column) >= F.date_sub(F.to_date(F.lit(as_of)), days).cast("timestamp")


def daily_activity(memories: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (
        memories.where(_within(days, as_of))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("memories"))
        .orderBy("day")
    )


def store_stats(memories: DataFrame, as_of: str) -> DataFrame:
    """Total and recent activity as (metric, day, value) rows, from one pass: the daily
    counts (a row per day) give both."""
    daily = memories.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("value")
    )
    rows = F.array(
        F.struct(
            F.lit("total_memories").alias("metric"),
            F.lit(None).cast("string").alias("day"),
            F.col("value"),
        ),
        F.struct(
            F.lit("recent_activity").alias("metric"),
            F.col("day").cast("string").alias("day"),
            F.col("value"),
        ),
    )
    return (
        daily.select("day", F.explode(rows).alias("row"))
        .where((F.col("row.metric") == "total_memories") | _within(7, as_of, "day"))
        .groupBy("row.metric", "row.day")
        .agg(F.sum("row.value").alias("value"))
    )


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row results side by side: stacked, every column keeps its one value."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _stats(memories: DataFrame, weight: Column, as_of: str) -> DataFrame:
    scored = F.when(F.col("importance_score").isNotNull(), weight)
    return memories.agg(
        F.sum(weight).alias("total_memories"),
        F.sum(F.when(_within(7, as_of), weight).otherwise(0)).alias("recent_memories"),
        F.sum(F.when(_within(30, as_of), weight).otherwise(0)).alias("monthly_memories"),
        (F.sum(F.col("importance_score") * weight) / F.sum(scored)).alias("avg_importance"),
        F.count_distinct("source").alias("unique_sources"),
    )


def _unique_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    known = tags.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return known.agg(F.count_distinct("tag").alias("unique_tags"))


def memory_stats(memories: DataFrame, tags: DataFrame, as_of: str) -> DataFrame:
    """Statistics over (memory, tag) pairs: a memory counts once per tag, at least once.

    The pairs are not built: each memory is weighted by its number of tags instead.
    """
    n_tags = tags.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"))
    slim = memories.select("id", "created_at", "importance_score", "source")
    weighted = slim.join(n_tags, "id", "left")
    weight = F.coalesce("n_tags", F.lit(1).cast("long"))
    return _one_row([_stats(weighted, weight, as_of), _unique_tags(memories, tags)])


def memory_stats_per_memory(memories: DataFrame, tags: DataFrame, as_of: str) -> DataFrame:
    """The same figures with every memory counted once."""
    return _one_row(
        [_stats(memories, F.lit(1).cast("long"), as_of), _unique_tags(memories, tags)]
    )


def status_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(info, value) rows: the number of rows of every table."""
    report = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(f"Total {name}").alias("info"), "value"
        )
        report = row if report is None else report.unionByName(row)
    return report
