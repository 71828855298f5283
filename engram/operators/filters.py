"""Row filters. An absent argument (None) adds no predicate, so pushdown stays exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.skew import broadcast_if_few


def by_importance(memories: DataFrame, minimum: float | None) -> DataFrame:
    """Rows without a score never pass, not even a minimum of 0."""
    if minimum is None:
        return memories
    return memories.where(F.col("importance_score") >= F.lit(float(minimum)))


def by_source(memories: DataFrame, source: str | None) -> DataFrame:
    return memories if source is None else memories.where(F.col("source") == F.lit(source))


def by_dates(
    memories: DataFrame, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Both bounds are inclusive."""
    if date_from is not None:
        memories = memories.where(F.col("created_at") >= F.to_timestamp(F.lit(date_from)))
    if date_to is not None:
        memories = memories.where(F.col("created_at") <= F.to_timestamp(F.lit(date_to)))
    return memories


def since(memories: DataFrame, date: str | None) -> DataFrame:
    return by_dates(memories, date_from=date)


def heading_like(memories: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Headings that contain any of the needles, case-sensitive."""
    condition = F.lit(False)
    for needle in needles:
        condition = condition | F.col("heading").contains(needle)
    return memories.where(condition)


def by_tag(memories: DataFrame, tags: DataFrame, tag: str | None) -> DataFrame:
    return memories if tag is None else by_any_tag(memories, tags, [tag])


def by_any_tag(
    memories: DataFrame, tags: DataFrame, wanted: Sequence[str] | None
) -> DataFrame:
    """Memories that carry at least one of the tags: a semi-join, so no row repeats."""
    if wanted is None:
        return memories
    hits = tags.where(F.col("tag").isin(list(wanted))).select(F.col("memory_id").alias("id"))
    return memories.join(broadcast_if_few(hits), "id", "left_semi")


def by_metadata(
    memories: DataFrame, metadata: DataFrame, key: str, value: str, path: str = "$"
) -> DataFrame:
    """Memories whose metadata under `key` holds `value` at a JSON path."""
    hits = metadata.where(
        (F.col("key") == key) & (F.get_json_object("value", path) == F.lit(value))
    ).select(F.col("memory_id").alias("id"))
    return memories.join(broadcast_if_few(hits), "id", "left_semi")


def by_project(memories: DataFrame, metadata: DataFrame, project: str | None) -> DataFrame:
    return memories if project is None else by_metadata(memories, metadata, "project", project)
