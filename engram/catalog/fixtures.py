"""The memory tables as views over the given test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import store
from engram.session import settings
from engram.sources.tables import spread

DIMENSION = 64
AS_OF = "2024-02-05"
# One query vector for the single-vector searches.
QUERY_VECTOR = [math.sin(i) for i in range(1, DIMENSION + 1)]


class Fixtures:
    """Lazily built DataFrames for one test data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = settings(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self) -> DataFrame:
        """The documents, for work on their texts."""
        return spread(self.table("documents"))

    def raw_memories(self, documents: DataFrame | None = None) -> DataFrame:
        """Every document as a memory row whose defaults are not filled in yet. Documents
        without a vector stay, with a NULL embedding; unlabelled ones have no score."""
        documents = documents or self.table("documents")
        vectors = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        labels = self.table("labels").select("doc_id", "quality")
        first_sentence = F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0))
        second = (F.col("doc_id") * 104729) % 2592000
        return (
            documents.join(vectors, "doc_id", "left")
            .join(labels, "doc_id", "left")
            .select(
                F.col("doc_id").alias("id"),
                F.coalesce(F.nullif(first_sentence, F.lit("")), "source").alias("heading"),
                F.col("text").alias("summary"),
                "embedding",
                F.timestamp_seconds(F.lit(1704067200) + second).alias("created_at"),
                F.col("lang").alias("context"),
                "source",
                F.when(
                    F.col("quality").isNotNull(), (F.col("n_chars") % 101) / F.lit(100.0)
                ).alias("importance_score"),
            )
        )

    def memories(self) -> DataFrame:
        return store.build_memories(self.raw_memories(), AS_OF)

    def memory_texts(self) -> DataFrame:
        """The same memories, for work on their texts."""
        return store.build_memories(self.raw_memories(self.texts()), AS_OF)

    def raw_tags(self) -> DataFrame:
        """Tags as they arrive: of documents their language and, where they are labelled, quality,
        and of users the type of each of their events, so with very many repeats."""
        labelled = self.table("documents").join(self.table("labels"), "doc_id", "left")
        quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
        given = F.array_compact(F.array(F.col("lang"), quality))
        return (
            labelled.select(F.col("doc_id").alias("memory_id"), F.explode(given).alias("tag"))
            .withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
            .unionByName(
                self.events().select(
                    F.col("user_id").alias("memory_id"), F.col("event_type").alias("tag"),
                    F.col("created_at"),
                )
            )
        )

    def events(self) -> DataFrame:
        return self.table("events").withColumn("created_at", F.col("ts").cast("timestamp"))

    def tags(self) -> DataFrame:
        return store.dedup_tags(self.raw_tags())

    def raw_metadata(self) -> DataFrame:
        """Metadata as it arrives: properties and type of every event of a user, and the
        source of every document as its project."""
        entries = F.map_from_arrays(
            F.array(F.lit("props"), F.lit("last_event")),
            F.array(F.col("props"), store.json_text(F.col("event_type"))),
        )
        of_events = self.events().select(
            F.col("user_id").alias("memory_id"), F.explode(entries).alias("key", "value"),
            "created_at",
        )
        of_documents = self.table("documents").select(
            F.col("doc_id").alias("memory_id"), F.lit("project").alias("key"),
            store.json_text(F.col("source")).alias("value"),
            F.to_timestamp(F.lit("2024-01-01")).alias("created_at"),
        )
        return of_events.unionByName(of_documents)

    def metadata(self) -> DataFrame:
        return store.latest_metadata(self.raw_metadata())

    def conversations(self) -> DataFrame:
        return spread(self.table("conversations"))

    def stored_vectors(self) -> DataFrame:
        """Every vector of the embeddings table as (id, embedding)."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    def vector_queries(self) -> DataFrame:
        """Every vector of the embeddings table as (query_id, embedding)."""
        return self.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")

    def text_queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
