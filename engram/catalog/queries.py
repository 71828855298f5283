"""The registered queries: every operator over whole test tables.

Timestamps are reported as ISO text and arrays as joined text, so that results compare
across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram import schema
from engram.catalog.fixtures import AS_OF, DIMENSION, QUERY_VECTOR, Fixtures
from engram.functions import summaries, vectors
from engram.functions import text as tx
from engram.operators import (
    aggregates, ann, chats, embedder, filters, fulltext, fuzzy, knn, lists, pivots, ranking, store,
)
from engram.operators import summarizer as chats_summarizer
from engram.plans import memorize, search
from engram.sources import tables
from engram.sources.workspace import new_path
from engram.streaming import activity, ingest

# Parameters that the SQL twins repeat.
TAG, SOURCE, PROJECT, TAGS = "en", "src3", "src5", ["de", "poor"]
DATE_FROM, DATE_TO, SINCE = "2024-01-08 00:00:00", "2024-01-22 12:00:00", "2024-01-15"
MIN_IMPORTANCE = 0.2
HEADINGS = ["the", "der"]
TEXT_QUERY = "The rean of ther and tion"
FUZZY_QUERY = "than there and the nation"
IVF_PROBES, LSH_TABLES, LSH_BITS = 3, 8, 4
# Tables of the search that probes neighbouring buckets.
PROBED_TABLES = 2
TURNS_PER_PART = 2
INSERTED_FROM = 1_000_000_000
EARLY_SOURCES, STORE_BUCKETS = "src4", 8
# Conversation n is given the vector n - FIRST_VECTOR_OF, so that the first ones have none.
FIRST_VECTOR_OF = 10
LETTERS = "abcdefghijklmnopqrstuvwxyz"
REFUSED_LETTER, REFUSED_PROMPT = "@", "tion."

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Fixtures(spark, sf_dir))
    return function


def iso(column: str) -> Column:
    return F.date_format(column, schema.ISO_FORMAT).alias(column)


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def rounded(column: str) -> Column:
    return F.transform(column, lambda x: F.round(x, 6))


def shown(memories: DataFrame) -> DataFrame:
    return ranking.result_shape(memories)


# Sources, sinks and table upkeep.


@query
def scan_memories(f):
    path = new_path(f.spark, "memories")
    f.memories().write.parquet(path)
    return tables.scan_memories(f.spark, path, T.LongType()).select(
        "id", "heading", "summary", iso("created_at"), iso("updated_at"), "context", "source",
        "importance_score", F.size("embedding").cast("long").alias("dimension"),
    )


@query
def build_memories(f):
    return f.memories().select(
        "id", "heading", "summary", iso("created_at"), iso("updated_at"), "context", "source",
        "importance_score", F.col("embedding").isNull().alias("no_vector"),
    )


def document_rows(f: Fixtures) -> DataFrame:
    """Documents as rows to be stored, before any check: headings may be empty and scores
    out of range."""
    documents = f.table("documents")
    rows = documents.select(
        store.memory_id("doc_id", "text").alias("id"),
        F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("heading"),
        F.col("text").alias("summary"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.col("lang").alias("context"),
        "source",
        (F.col("n_chars") / F.lit(2000.0)).alias("importance_score"),
    )
    return store.build_memories(rows, AS_OF)


@query
def store_memories(f):
    return store.append_memories(
        document_rows(f), new_path(f.spark, "stored"), DIMENSION, batch_id="documents"
    )


@query
def store_batches(f):
    """The documents arrive in three batches: some, all of them twice, and the first again."""
    path, rows = new_path(f.spark, "stored"), document_rows(f)
    early = rows.where(F.col("source") < EARLY_SOURCES)
    store.store_batch(early, path, DIMENSION, "a", STORE_BUCKETS)
    late = store.store_batch(rows.unionByName(rows), path, DIMENSION, "b", STORE_BUCKETS)
    store.store_batch(early, path, DIMENSION, "a", STORE_BUCKETS)
    stored = f.spark.read.parquet(path).select(
        "id", F.lit(1).cast("long").alias("n"), F.concat(F.lit("in batch "), "batch_id").alias("what")
    )
    refused = late.refused.select("id", "n", F.col("error").alias("what"))
    return stored.unionByName(refused).groupBy("id", "what").agg(F.sum("n").alias("n"))


@query
def validate_memories(f):
    return store.validate(document_rows(f), DIMENSION).select("id", "error")


@query
def tag_explode(f):
    labelled = f.table("documents").join(f.table("labels"), "doc_id", "left")
    judged = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return store.explode_tags(
        labelled.withColumnRenamed("doc_id", "id"), F.array_compact(F.array("lang", "source", judged))
    )


@query
def metadata_explode(f):
    return store.explode_metadata(
        f.table("documents").withColumnRenamed("doc_id", "id"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("project"), F.col("source")),
    )


@query
def tags_dedup(f):
    return store.dedup_tags(f.raw_tags())


@query
def metadata_latest(f):
    return store.latest_metadata(f.raw_metadata()).withColumn("created_at", iso("created_at"))


def changes(f: Fixtures) -> DataFrame:
    """A change log: every event rewrites the memory of its user, and the benchmark items
    arrive as new memories."""
    updated = f.events().select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("heading"),
        F.col("props").alias("summary"),
        "created_at",
        F.lit("event").alias("source"),
    )
    inserted = f.table("benchmark").select(
        (F.col("item_id") + INSERTED_FROM).alias("id"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("heading"),
        F.col("text").alias("summary"),
        F.to_timestamp(F.lit("2024-01-31")).alias("created_at"),
        F.lit("benchmark").alias("source"),
    )
    rows = updated.unionByName(inserted).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    return store.build_memories(rows, AS_OF)


@query
def upsert_memories(f):
    return store.upsert_memories(f.memories(), changes(f), AS_OF).select(
        "id", "heading", "summary", "source", "importance_score", iso("created_at"),
        iso("updated_at"),
    )


def toxic_ids(f: Fixtures) -> DataFrame:
    return f.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


@query
def delete_memories(f):
    kept, tags, metadata, gone = store.delete_memories(
        f.memories(), f.tags(), f.metadata(), toxic_ids(f)
    )

    def rows(table: DataFrame, name: str, key: str) -> DataFrame:
        return table.select(F.lit(name).alias("kind"), F.col(key).alias("memory_id"))

    left = rows(kept, "memory", "id").unionByName(rows(tags, "tag", "memory_id")).unionByName(
        rows(metadata, "metadata", "memory_id")
    ).unionByName(rows(gone.where("deleted"), "deleted", "id"))
    return left.groupBy("kind", "memory_id").agg(F.count(F.lit(1)).alias("n"))


@query
def get_by_id(f):
    asked = f.table("events").where("event_type = 'error'").select(
        F.col("user_id").alias("id")
    )
    return shown(store.get_by_id(f.memories(), asked))


@query
def fk_check(f):
    tags = f.table("events").select(
        F.col("event_id").alias("memory_id"), F.col("event_type").alias("tag")
    )
    return store.orphans(tags, f.memories())


# Projections and filters.


@query
def result_shape(f):
    return ranking.result_shape(f.memories())


@query
def filter_similarity(f):
    scored = f.stored_vectors().select(
        "id",
        vectors.reported(vectors.similarity_to("embedding", QUERY_VECTOR)).alias("similarity"),
    )
    return scored.where(F.col("similarity") >= schema.SEARCH_THRESHOLD)


@query
def filter_importance(f):
    return filters.by_importance(f.memories(), MIN_IMPORTANCE).select("id", "importance_score")


@query
def filter_source(f):
    return filters.by_source(f.memories(), SOURCE).select("id", "source")


@query
def filter_dates(f):
    return filters.by_dates(f.memories(), DATE_FROM, DATE_TO).select("id", iso("created_at"))


@query
def filter_since(f):
    return filters.since(f.memories(), SINCE).select("id", iso("created_at"))


@query
def filter_heading_like(f):
    return filters.heading_like(f.memories(), HEADINGS).select("id", "heading")


@query
def filter_metadata(f):
    return filters.by_metadata(
        f.memories(), f.metadata(), "last_event", "error"
    ).select("id", "source")


@query
def filter_project(f):
    return filters.by_project(f.memories(), f.metadata(), PROJECT).select("id", "source")


@query
def filter_tags_any(f):
    return filters.by_any_tag(f.memories(), f.tags(), TAGS).select("id", "context")


# Joins.


@query
def join_tags_left(f):
    return aggregates.join_tags(f.memories().select("id", "source"), f.tags())


@query
def semi_tag(f):
    return filters.by_tag(f.memories(), f.tags(), TAG).select("id", "context")


def topic_queries(f: Fixtures) -> DataFrame:
    """One query per label: the mean of all its vectors."""
    return ann.mean_centroids(f.table("embeddings"), "label").select(
        F.col("list_id").cast("long").alias("query_id"),
        F.col("centroid").cast("array<float>").alias("embedding"),
    )


@query
def query_cross_memories(f):
    return knn.count_above(
        f.stored_vectors(), topic_queries(f), DIMENSION, schema.SEARCH_THRESHOLD
    )


@query
def near_dup_check(f):
    return pivots.near_duplicates(f.stored_vectors(), f.vector_queries(), DIMENSION)


@query
def near_dup_chats(f):
    """Stored documents that resemble the opening of each conversation, by text."""
    documents = f.texts().select(F.col("doc_id").alias("id"), "text")
    model = chats.hashing_embedder()
    stored = chats.embed_texts(documents, model).select("id", "embedding")
    return memorize.similar_memories(
        f.conversations(), stored, model, chats.EMBEDDING_DIMENSION
    )


# Aggregations.


@query
def count_total(f):
    return aggregates.count_total(f.memories())


@query
def daily_activity(f):
    return aggregates.daily_activity(f.memories(), AS_OF).select(
        F.col("day").cast("string").alias("day"), "memories"
    )


@query
def store_stats(f):
    return aggregates.store_stats(f.memories(), AS_OF)


def rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumn("avg_importance", F.round("avg_importance", 6))


@query
def memory_stats(f):
    return rounded_stats(aggregates.memory_stats(f.memories(), f.tags(), AS_OF))


@query
def memory_stats_per_memory(f):
    return rounded_stats(aggregates.memory_stats_per_memory(f.memories(), f.tags(), AS_OF))


@query
def tags_array(f):
    return aggregates.tags_array(f.raw_tags()).select("id", joined("tags"))


@query
def memories_with_tags(f):
    return aggregates.memories_with_tags(f.memories(), f.raw_tags()).select(
        "id", "heading", "summary", "context", "source", "importance_score",
        iso("created_at"), iso("updated_at"), joined("tags"),
    )


@query
def total_found(f):
    hits = pivots.near_duplicates(f.stored_vectors(), f.vector_queries(), DIMENSION)
    return ranking.total_found(f.vector_queries(), hits)


@query
def status_report(f):
    return aggregates.status_report(
        {"memories": f.memories(), "tags": f.tags(), "metadata": f.metadata()}
    )


# Order, limit, top-k.


@query
def recent_memories(f):
    return ranking.recent(f.memories()).withColumn("created_at", iso("created_at"))


@query
def topk_similar(f):
    return ranking.topk_similar(f.memories(), QUERY_VECTOR).withColumn(
        "created_at", iso("created_at")
    )


@query
def topk_similar_batch(f):
    return knn.nearest(f.stored_vectors(), topic_queries(f), DIMENSION)


@query
def order_rank_recency(f):
    ranked = f.memories().select(
        "id", F.round("importance_score", 1).alias("rank"), "created_at"
    )
    return ranking.order_rank_recency(ranked).withColumn("created_at", iso("created_at"))


@query
def preview(f):
    return ranking.preview(ranking.topk_similar(f.memories(), QUERY_VECTOR))


# Scalar functions.


@query
def cosine_similarity(f):
    fixed = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return f.stored_vectors().select(
        "id", vectors.reported(vectors.cosine_similarity("embedding", fixed)).alias("similarity")
    )


@query
def cosine_distance(f):
    fixed = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return f.stored_vectors().select(
        "id", vectors.reported(vectors.cosine_distance("embedding", fixed)).alias("distance")
    )


@query
def l2_normalize(f):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = vectors.l2_normalize(scaled)
    return f.table("embeddings").select(
        F.col("vec_id").alias("id"),
        F.round(vectors.l2_norm(scaled), 6).alias("norm"),
        F.round(F.array_max(unit), 6).alias("largest"),
        F.round(vectors.l2_norm(unit), 6).alias("unit_norm"),
    )


@query
def vector_dim(f):
    return f.stored_vectors().select("id", vectors.vector_dim(F.col("embedding")).alias("dim"))


@query
def zero_vector(f):
    padded = vectors.pad_vector(F.col("embedding"), schema_dimension())
    return f.stored_vectors().select(
        "id",
        vectors.vector_dim(padded).alias("dim"),
        F.round(vectors.l2_norm(padded), 6).alias("norm"),
        vectors.vector_dim(vectors.zero_vector(schema_dimension())).alias("zero_dim"),
    )


def schema_dimension() -> int:
    return chats.EMBEDDING_DIMENSION


@query
def tokenize(f):
    return f.texts().select(
        F.col("doc_id").alias("id"),
        tx.word_count(F.col("text")).alias("n_words"),
        F.array_join(tx.words(F.col("text")), " ").alias("words"),
    )


@query
def weighted_terms(f):
    return fulltext.weighted_terms(f.memory_texts())


@query
def plain_query(f):
    return f.text_queries().select(
        "query_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms")
    )


@query
def text_match(f):
    return fulltext.match_all(f.memory_texts(), f.text_queries()).select("query_id", "id")


@query
def text_rank(f):
    return fulltext.match_all(f.memory_texts(), f.text_queries())


@query
def trigrams(f):
    return f.texts().select(
        F.col("doc_id").alias("id"),
        F.array_join(F.array_sort(tx.trigrams(F.col("text"))), "|").alias("grams"),
    )


@query
def trigram_similarity(f):
    return f.memory_texts().select(
        "id",
        F.round(
            tx.trigram_similarity(tx.trigrams(F.col("heading")), tx.trigrams(F.col("summary"))), 6
        ).alias("similarity"),
    )


@query
def trigram_search(f):
    return fuzzy.trigram_search(f.memory_texts(), FUZZY_QUERY)


@query
def chat_text(f):
    return chats.chat_text(chats.chat_logs(f.conversations()))


@query
def chat_parts(f):
    return chats.chat_text(chats.chat_logs(f.conversations(), TURNS_PER_PART))


@query
def first_turns(f):
    return chats.opening_text(f.conversations())


@query
def embed_text_input(f):
    return f.memories().select(
        "id", tx.embed_text_input(F.col("heading"), F.col("summary")).alias("text")
    )


@query
def prompt_build(f):
    logs = chats.chat_text(chats.chat_logs(f.conversations()))
    context = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return logs.select(
        "conv_id", "part", summaries.build_prompt(context, F.col("chat_text")).alias("prompt")
    )


def responses(f: Fixtures) -> DataFrame:
    """Whole documents as answers in the forms an answer may take, one form per language."""
    text, source = F.col("text"), F.col("source")
    return f.texts().select(
        F.col("doc_id").alias("id"),
        F.when(
            F.col("lang") == "en",
            F.concat(F.lit("Heading: "), source, F.lit("\nSummary: not kept\n"), text),
        )
        .when(F.col("lang") == "fr", F.concat(F.lit("  1. HEADING:\n\n"), text))
        .when(F.col("lang") == "de", F.concat(text, F.lit("\n2. Summary:\n\n "), source))
        .otherwise(text)
        .alias("response"),
    )


@query
def parse_summary(f):
    return responses(f).select(
        "id", summaries.parse_summary(F.col("response")).alias("parsed")
    ).select("id", "parsed.heading", "parsed.summary")


@query
def fallback_summary(f):
    turns = f.conversations().groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return turns.select(
        "conv_id", summaries.fallback_summary(F.col("n")).alias("s")
    ).select("conv_id", "s.heading", "s.summary")


@query
def json_value(f):
    return f.table("events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        store.json_text(F.col("event_type")).alias("as_json"),
        F.get_json_object(store.json_text(F.col("event_type")), "$").alias("from_json"),
    )


@query
def date_functions(f):
    return f.events().select(
        "event_id",
        F.to_date("created_at").cast("string").alias("day"),
        (F.col("created_at") >= F.to_timestamp(F.lit("2024-01-29"))).alias("recent"),
        iso("created_at"),
    )


@query
def string_functions(f):
    line = chats.chat_line(F.col("role"), F.col("text"))
    return f.conversations().select(
        "conv_id", "turn",
        F.lower(tx.strip(line)).alias("line"),
        F.lower(line).startswith("user:").alias("from_user"),
        tx.strip(F.element_at(F.split(line, ":", 2), 2)).alias("said"),
    )


@query
def memory_id(f):
    return f.table("documents").select(
        "doc_id", store.memory_id("doc_id", "source", "text").alias("memory_id")
    )


# Searches and flows.


@query
def search_semantic(f):
    return search.search_semantic(
        f.memories(), f.tags(), QUERY_VECTOR, min_importance=MIN_IMPORTANCE, tag=TAG,
        date_from=DATE_FROM, date_to="2024-02-01 00:00:00",
    ).withColumns({"created_at": iso("created_at"), "tags": joined("tags")})


@query
def search_text(f):
    return fulltext.search_text(f.memory_texts(), TEXT_QUERY).withColumn(
        "created_at", iso("created_at")
    )


@query
def text_index_search(f):
    path = new_path(f.spark, "text-index")
    fulltext.build_index(f.memory_texts(), path)
    return fulltext.search_text(
        f.memories(), TEXT_QUERY, index=f.spark.read.parquet(path)
    ).withColumn("created_at", iso("created_at"))


@query
def trigram_index_search(f):
    path = new_path(f.spark, "gram-index")
    fuzzy.build_index(f.memory_texts(), path)
    return fuzzy.search_index(f.spark.read.parquet(path), f.memories(), FUZZY_QUERY)


@query
def search_text_batch(f):
    return fulltext.search_text_batch(f.memory_texts(), f.text_queries(), limit=3).withColumn(
        "created_at", iso("created_at")
    )


@query
def search_metadata(f):
    return search.search_metadata(
        f.memories(), f.tags(), f.metadata(), any_tag=TAGS, date_to=DATE_TO
    ).withColumn("created_at", iso("created_at"))


@query
def search_hybrid(f):
    return search.search_hybrid(
        f.memories(), f.tags(), f.metadata(), QUERY_VECTOR, project=PROJECT, threshold=0.0
    ).withColumn("created_at", iso("created_at"))


@query
def fetch_context(f):
    label = F.col("label")
    requests = f.table("embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.when(label == 0, "").otherwise(F.concat(F.lit("topic "), label.cast("string"))).alias(
            "query"
        ),
        F.when(label == 1, "recent").otherwise("semantic").alias("search_type"),
        "embedding",
        (label + 1).alias("limit"),
        (label / F.lit(40.0)).alias("threshold"),
    )
    return search.fetch_context(f.memories(), requests, DIMENSION).select(
        "query_id", "search_type_used", "rank", "id", "similarity", "heading"
    )


@query
def summarize_chats(f):
    return chats.summarize_chats(f.conversations()).drop("summarize_error")


@query
def embed_texts(f):
    documents = f.texts().select(F.col("doc_id").alias("id"), "text")
    embedded = chats.embed_texts(documents, chats.hashing_embedder())
    # Every bucket with a weight, in ten thousandths; .501 keeps exact halves off the border.
    cells = F.transform(
        "embedding", lambda x, i: F.struct(i.alias("i"), F.floor(x * 10000.0 + 0.501).alias("w"))
    )
    cells = F.transform(
        F.filter(cells, lambda c: c["w"] > 0), lambda c: F.concat_ws(":", c["i"], c["w"])
    )
    return embedded.select(
        "id",
        "embed_error",
        vectors.vector_dim(F.col("embedding")).alias("dimension"),
        F.array_join(cells, " ").alias("weights"),
    )


def letter_model():
    """A user's model, as a task loads it: letter counts, and an error on some texts."""

    def model(texts):
        if any(REFUSED_LETTER in text for text in texts):
            raise ValueError(f"a text holds {REFUSED_LETTER}")
        return [[float(text.count(letter)) for letter in LETTERS] for text in texts]

    return model


@query
def embed_provided(f):
    """Whole documents embedded by a user's own model."""
    documents = f.texts().select(F.col("doc_id").alias("id"), "text")
    embedded = chats.embed_texts(documents, embedder.provided(letter_model, len(LETTERS)))
    cells = F.transform("embedding", lambda x: F.floor(x * 10000.0 + 0.501).cast("string"))
    return embedded.select(
        "id", "embed_error", vectors.vector_dim(F.col("embedding")).alias("dimension"),
        F.array_join(cells, " ").alias("weights"),
    )


def given_vectors(f: Fixtures) -> Callable[[DataFrame], DataFrame]:
    """Vectors of the embeddings table for conversations."""
    table = f.table("embeddings").select((F.col("vec_id") + FIRST_VECTOR_OF).alias("conv_id"), "embedding")
    return embedder.joined(table, "conv_id", DIMENSION)


@query
def ingest_given_vectors(f):
    """Conversations stored with the given vectors; those without one are rejected, row by row."""
    done = memorize.ingest_conversations(
        f.conversations(), AS_OF, dimension=DIMENSION, model=given_vectors(f)
    )
    stored = done.memories.select(
        F.col("id").alias("memory_id"), F.lit(None).cast("string").alias("error"), "heading",
        vectors.vector_dim(F.col("embedding")).alias("dimension"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("largest"),
    )
    return stored.unionByName(
        done.rejected.select(
            F.col("id").alias("memory_id"), "error", "heading", F.lit(None).cast("long").alias("dimension"),
            F.lit(None).cast("double").alias("largest"),
        )
    )


@query
def memory_pipeline(f):
    """The steps of every conversation. The benchmark items are announced as conversations but
    have no message, so their first step fails; some others have no vector."""
    announced = f.table("benchmark").select((F.col("item_id") + INSERTED_FROM).alias("conv_id"))
    turns = f.conversations().unionByName(announced, allowMissingColumns=True)
    steps = memorize.memorize_chats(turns, AS_OF, DIMENSION, given_vectors(f))
    return steps.select(
        "conv_id", F.col("id").alias("memory_id"), "heading", "summary", "n_turns",
        vectors.vector_dim(F.col("embedding")).alias("embedding_dimension"), "summarize_done",
        "summarize_error", "embed_done", "embed_error", "store_done", "store_error", "error",
    )


def last_speaker_model():
    """A user's model for summaries, as a task loads it: the last line of the prompt's chat is
    the heading, its number of lines the summary; it fails on some."""

    def model(prompts):
        if any(REFUSED_PROMPT in prompt for prompt in prompts):
            raise ValueError(f"a prompt holds {REFUSED_PROMPT}")
        chats_only = [p.split("Chat Log:\n", 1)[1].rsplit("\n\nAnswer with", 1)[0] for p in prompts]
        return [f"Heading: {c.rsplit(': ', 1)[0].rsplit(chr(10), 1)[-1]}\nSummary:\n{c.count(chr(10))} breaks" for c in chats_only]

    return model


@query
def summarize_provided(f):
    """Whole conversations summarised by a user's own model."""
    return chats_summarizer.provided(last_speaker_model)(f.conversations())


@query
def memorize_chats(f):
    return memorize.memorize_chats(f.conversations(), AS_OF).select(
        "conv_id", F.col("id").alias("memory_id"), "heading", "summary", "n_turns",
        vectors.vector_dim(F.col("embedding")).alias("embedding_dimension"),
        "summarize_done", "embed_done", "store_done", "error",
    )


@query
def ingest_conversations(f):
    turns = f.conversations()
    stored = memorize.ingest_conversations(
        turns,
        AS_OF,
        tags=turns.select("conv_id", F.col("role").alias("tag")),
        metadata=turns.groupBy("conv_id").agg(F.max("turn").alias("last")).select(
            "conv_id", F.lit("last_turn").alias("key"),
            F.col("last").cast("string").alias("value"),
        ),
    )
    rows = stored.memories.select(
        F.col("id").alias("memory_id"), F.lit("memory").alias("kind"),
        F.col("heading").alias("value"),
    )
    return rows.unionByName(
        stored.tags.select("memory_id", F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    ).unionByName(
        stored.metadata.select("memory_id", F.col("key").alias("kind"), "value")
    )


@query
def remember_conversations(f):
    """Conversations with tags and metadata stored twice under two batch ids, then found again
    by project, tag and date."""
    turns = f.conversations()
    done = memorize.ingest_conversations(
        turns, AS_OF, dimension=DIMENSION, model=given_vectors(f),
        tags=turns.select("conv_id", F.col("role").alias("tag")),
        metadata=turns.select("conv_id", F.lit("project").alias("key"), F.col("role").alias("value")),
    )
    path = new_path(f.spark, "remembered")
    for batch_id in ("monday", "tuesday"):
        memorize.remember(done, path, batch_id, STORE_BUCKETS)
    memories = tables.scan_memories(f.spark, f"{path}/memories")
    tags = tables.scan_tags(f.spark, f"{path}/tags")
    metadata = tables.scan_metadata(f.spark, f"{path}/metadata")
    kept = filters.by_dates(memories, AS_OF, AS_OF)
    kept = filters.by_any_tag(filters.by_project(kept, metadata, "user"), tags, ["user", "assistant"])
    rows = kept.select(F.col("id").alias("memory_id"), F.lit("memory").alias("kind"), F.col("heading").alias("value"), "created_at", "batch_id")
    rows = rows.unionByName(
        tags.select("memory_id", F.lit("tag").alias("kind"), F.col("tag").alias("value"), "created_at", "batch_id")
    ).unionByName(
        metadata.select("memory_id", F.col("key").alias("kind"), "value", "created_at", "batch_id")
    )
    return rows.withColumn("created_at", iso("created_at"))


def vector_lists(f: Fixtures) -> lists.Lists:
    return lists.build(f.stored_vectors(), DIMENSION)


@query
def ann_ivf_build(f):
    """Lists drawn in two levels, stored and read back."""
    built, path = vector_lists(f), new_path(f.spark, "lists")
    lists.write(built, path)
    sizes = f.spark.read.parquet(path).groupBy("list_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return built.centroids.join(sizes, "list_id", "left").select(
        "list_id",
        F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_vectors"),
        F.round(vectors.l2_norm(F.col("centroid")), 5).alias("centroid_norm"),
    )


def ivf_hits(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Hits, and how many pairs were scored for them."""
    built, asked = vector_lists(f), f.vector_queries()
    probes = lists.probes_for(built, asked, DIMENSION, exclude_self=True)
    hits = lists.search(built, asked, DIMENSION, probes, exclude_self=True)
    return hits, lists.pairs_met(built, asked, DIMENSION, probes)


def lsh_hits(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    memories, asked = f.stored_vectors(), f.vector_queries()
    bits = ann.bits_for(memories.count())
    probes = ann.lsh_probes_for(memories, asked, DIMENSION, PROBED_TABLES, bits, exclude_self=True)
    hits = ann.search_lsh(
        memories, asked, DIMENSION, PROBED_TABLES, bits, exclude_self=True, probes=probes
    )
    return hits, ann.lsh_pairs_met(memories, asked, DIMENSION, PROBED_TABLES, bits, probes)


def exact_hits(f: Fixtures) -> DataFrame:
    return knn.nearest(f.stored_vectors(), f.vector_queries(), DIMENSION, exclude_self=True)


def recall_and_pairs(f: Fixtures, hits: DataFrame, met: DataFrame) -> DataFrame:
    """One row of counts beside one row of counts."""
    share = F.round(F.col("pairs_met") / F.col("pairs"), schema.SIMILARITY_DECIMALS)
    return ann.recall(exact_hits(f), hits).join(F.broadcast(met.withColumn("share_met", share)))


@query
def ann_ivf_search(f):
    return ivf_hits(f)[0]


@query
def ann_lsh_search(f):
    return lsh_hits(f)[0]


@query
def ann_ivf_recall(f):
    return recall_and_pairs(f, *ivf_hits(f))


@query
def ann_lsh_recall(f):
    return recall_and_pairs(f, *lsh_hits(f))


@query
def ann_given_lists_build(f):
    """Lists around given centroids: the mean vectors of the labels."""
    vectors_table = f.table("embeddings").withColumnRenamed("vec_id", "id")
    centroids = ann.mean_centroids(vectors_table, "label")
    path = new_path(f.spark, "ivf")
    ann.build_ivf(vectors_table, centroids, DIMENSION, path)
    index = f.spark.read.parquet(path)
    sizes = index.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return centroids.join(sizes, "list_id", "left").select(
        "list_id",
        F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_vectors"),
        F.round(vectors.l2_norm(F.col("centroid")), 5).alias("centroid_norm"),
    )


@query
def ann_given_lists_search(f):
    """The few closest of the given lists."""
    centroids = ann.mean_centroids(f.table("embeddings"), "label")
    path = new_path(f.spark, "ivf")
    ann.build_ivf(f.stored_vectors(), centroids, DIMENSION, path)
    return ann.search_ivf(
        f.spark.read.parquet(path), centroids, f.vector_queries(), DIMENSION, IVF_PROBES,
        exclude_self=True,
    )


@query
def ann_one_bucket_search(f):
    """Only the bucket that a query is in itself, of few and large ones."""
    return ann.search_lsh(
        f.stored_vectors(), f.vector_queries(), DIMENSION, LSH_TABLES, LSH_BITS,
        exclude_self=True,
    )


# Streams, run until all present input is processed.


@query
def stream_ingest(f):
    rows = document_rows(streamed(f, "documents"))
    stored, refused = new_path(f.spark, "stream"), new_path(f.spark, "stream-rejected")
    ingest.stream_memories(
        rows, stored, refused, new_path(f.spark, "checkpoint"), DIMENSION
    ).awaitTermination()
    kept = f.spark.read.parquet(stored).select("id", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(f.spark.read.parquet(refused).select("id", "error"))


class _Arriving(Fixtures):
    """Fixtures with one table replaced by a stream."""

    def __init__(self, f: Fixtures, name: str, stream: DataFrame):
        self.spark, self.dir, self._name, self._stream = f.spark, f.dir, name, stream

    def table(self, name: str) -> DataFrame:
        return self._stream if name == self._name else super().table(name)


def streamed(f: Fixtures, name: str) -> Fixtures:
    """The fixtures with one table as it arrives. A pattern names the table: a stream takes a
    folder of files or one matching file by it, but no plain path to a file."""
    arriving = f.spark.readStream.schema(f.table(name).schema).parquet(f"{f.dir}/{name}.parque[t]")
    return _Arriving(f, name, arriving)


@query
def stream_daily_activity(f):
    path = new_path(f.spark, "activity")
    activity.stream_daily_activity(
        streamed(f, "events").events(), path, new_path(f.spark, "checkpoint")
    ).awaitTermination()
    return activity.current_activity(f.spark, path).select(
        F.col("day").cast("string").alias("day"), "memories"
    )


@query
def stream_tag_dedup(f):
    tags = streamed(f, "events").events().select(
        F.col("user_id").alias("memory_id"), F.col("event_type").alias("tag"), "created_at"
    )
    path = new_path(f.spark, "tags")
    ingest.stream_unique_tags(
        tags, path, new_path(f.spark, "checkpoint"), delay="60 days"
    ).awaitTermination()
    return f.spark.read.parquet(path).select("memory_id", "tag")
