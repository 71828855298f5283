"""Reading memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from engram import schema


def scan_memories(
    spark: SparkSession, path: str, id_type: T.DataType | None = None
) -> DataFrame:
    """The memory table under its declared schema; no inference pass over the files."""
    return spark.read.schema(schema.memories_schema(id_type)).parquet(path)


def scan_tags(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    return spark.read.schema(schema.tags_schema(id_type)).parquet(path)


def scan_metadata(
    spark: SparkSession, path: str, id_type: T.DataType | None = None
) -> DataFrame:
    return spark.read.schema(schema.metadata_schema(id_type)).parquet(path)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: list[str],
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of a live database, read in parallel: one connection per predicate, which
    together must cover the table without overlap (for instance one per day of creation)."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})


def save_bucketed(frame: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table in buckets of a key. Tables with the same number of buckets, such as
    memories by id and tags by memory_id, then join without a shuffle."""
    (
        frame.write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    return frame.sparkSession.table(name)


def spread(table: DataFrame) -> DataFrame:
    """For work that is heavy per row, such as text: a table that arrives in fewer splits
    than there are cores is spread over all of them. A large table is left as it lies."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
