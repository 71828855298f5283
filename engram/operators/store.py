"""Writing memories: defaults, validation, ids, append, upsert, delete, tags, metadata."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import schema
from engram.operators import keyed
from engram.operators.skew import broadcast_if_few
from engram.sources.workspace import written


def memory_id(*natural_key: Column | str) -> Column:
    """Id from content, so that writing the same memory again yields the same id."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                        F.lit("")) for c in natural_key]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def build_memories(rows: DataFrame, as_of: str) -> DataFrame:
    """Fill in the column defaults and order the columns as the table has them."""
    now = F.to_timestamp(F.lit(as_of))
    have = set(rows.columns)

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    created = column("created_at", now)
    return rows.select(
        "id",
        "heading",
        "summary",
        F.col("embedding").cast("array<float>").alias("embedding"),
        created.alias("created_at"),
        (F.coalesce("updated_at", created) if "updated_at" in have else created).alias(
            "updated_at"
        ),
        column("context", F.lit(None).cast("string")).alias("context"),
        column("source", F.lit(schema.DEFAULT_SOURCE)).alias("source"),
        column("importance_score", F.lit(schema.DEFAULT_IMPORTANCE))
        .cast("double")
        .alias("importance_score"),
    )


def validation_error(dimension: int, embedding_required: bool = False) -> Column:
    """First broken rule of a memory row, NULL when it may be stored."""

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    score = F.col("importance_score")
    error = (
        F.when(F.col("id").isNull(), "id is required")
        .when(missing("heading"), "heading is required")
        .when(missing("summary"), "summary is required")
        .when((score < 0) | (score > 1) | F.isnan(score),
              "importance_score must be between 0 and 1")
        .when(F.size("embedding") != dimension, f"embedding must have {dimension} dimensions")
    )
    if embedding_required:
        error = F.coalesce(F.when(F.col("embedding").isNull(), "embedding is required"), error)
    return error


def validate(rows: DataFrame, dimension: int, embedding_required: bool = False) -> DataFrame:
    """Add the error column; `accepted` and `rejected` split on it."""
    return rows.withColumn("error", validation_error(dimension, embedding_required))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNull()).drop("error")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNotNull())


class Stored(NamedTuple):
    """Ids (memory_id) that a batch stored, and rows (id, n, error) that it refused."""

    ids: DataFrame
    refused: DataFrame


def append_memories(rows: DataFrame, path: str, dimension: int, batch_id: str) -> DataFrame:
    """Store the valid rows with new ids as one batch and return their ids (`store_batch`)."""
    return store_batch(rows, path, dimension, batch_id).ids


def store_batch(
    rows: DataFrame, path: str, dimension: int, batch_id: str, buckets: int = keyed.BUCKETS
) -> Stored:
    """Store the valid rows as one batch; an id is stored once in the whole table.

    A batch owns one folder of the table, so writing it again after a failure replaces it
    and never doubles its rows. Of several rows of an id, in one batch or over batches, the first
    stored stays (in one batch the least by heading, summary and so on); the others are refused,
    as are invalid rows. The rows are checked once, since both results read them.
    """
    checked = written(validate(rows, dimension), "checked")
    done = keyed.append(accepted(checked), path, ["id"], batch_id, buckets)
    invalid = rejected(checked).groupBy("id", "error").agg(F.count(F.lit(1)).alias("n"))
    return Stored(
        done.stored.select(F.col("id").alias("memory_id")),
        done.repeated.unionByName(invalid.select("id", "n", "error")),
    )


def latest_changes(changes: DataFrame) -> DataFrame:
    """Newest row per id. max_by aggregates before the shuffle, so an id that changed very
    often sends one row per partition; equal times are decided by the whole row."""
    fields = [c for c in changes.columns if c != "id"]
    order = F.struct("updated_at", *[c for c in fields if c != "updated_at"])
    newest = F.max_by(F.struct(*fields), order).alias("row")
    return changes.groupBy("id").agg(newest).select("id", "row.*")


def upsert_memories(base: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The table after the changes: a changed memory keeps its creation time and gets
    `as_of` as update time, a new one is added, the rest passes through untouched."""
    now = F.to_timestamp(F.lit(as_of))
    newest = written(latest_changes(changes), "changes")
    ids = broadcast_if_few(newest.select("id"))
    untouched = base.join(ids, "id", "left_anti")
    created = base.join(ids, "id", "left_semi").select(
        "id", F.col("created_at").alias("first_created_at")
    )
    changed = (
        newest.join(created, "id", "left")
        .withColumn("created_at", F.coalesce("first_created_at", "created_at"))
        .withColumn("updated_at", F.when(F.col("first_created_at").isNotNull(), now)
                    .otherwise(F.col("updated_at")))
        .select(*base.columns)
    )
    return untouched.select(*base.columns).unionByName(changed)


def delete_memories(
    memories: DataFrame, tags: DataFrame, metadata: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables without the given ids, and whether each id existed."""
    side = broadcast_if_few(written(ids.select("id").distinct(), "ids"))
    children = side.withColumnRenamed("id", "memory_id")
    gone = side.join(
        memories.join(side, "id", "left_semi").select("id", F.lit(True).alias("found")),
        "id", "left",
    ).select("id", F.coalesce("found", F.lit(False)).alias("deleted"))
    return (
        memories.join(side, "id", "left_anti"),
        tags.join(children, "memory_id", "left_anti"),
        metadata.join(children, "memory_id", "left_anti"),
        gone,
    )


def get_by_id(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(broadcast_if_few(ids.select("id")), "id", "left_semi")


def explode_tags(memories: DataFrame, tags: Column) -> DataFrame:
    """(memory_id, tag) rows of an array of tags per memory."""
    return memories.select(F.col("id").alias("memory_id"), F.explode(tags).alias("tag"))


def explode_metadata(memories: DataFrame, entries: Column) -> DataFrame:
    """(memory_id, key, value) rows of a map per memory; values become JSON text."""
    return memories.select(
        F.col("id").alias("memory_id"), F.explode(entries).alias("key", "plain")
    ).select("memory_id", "key", json_text(F.col("plain")).alias("value"))


def json_text(value: Column) -> Column:
    """A scalar as JSON text: the inside of a one-element JSON array."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def dedup_tags(tags: DataFrame) -> DataFrame:
    """One row per (memory, tag)."""
    return tags.select("memory_id", "tag").distinct()


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """Newest value per (memory, key), aggregated before the shuffle."""
    newest = F.max_by(F.struct("value", "created_at"), F.struct("created_at", "value"))
    return (
        metadata.groupBy("memory_id", "key")
        .agg(newest.alias("row"))
        .select("memory_id", "key", "row.value", "row.created_at")
    )


def orphans(children: DataFrame, memories: DataFrame) -> DataFrame:
    """Tag or metadata rows whose memory does not exist."""
    return children.join(
        memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"
    )
