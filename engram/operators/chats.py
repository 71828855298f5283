"""Chat turns to chat logs, extractive summaries and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram import schema
from engram.functions import text as tx
from engram.functions.summaries import EMPTY_LOG, fallback_summary
from engram.operators.skew import hottest
from engram.sources.workspace import written

SUMMARY_SENTENCES = 3
#: Terms whose weights may travel to the turns.
MAX_BROADCAST_TERMS = 200_000
EMBEDDING_DIMENSION = 1536

SENTENCE = r"[^.!?\n]+[.!?]*"


def chat_line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(": "), text)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Add `place`, the number of a turn inside its conversation in turn order, from 0.

    Turns are dealt in ranges of (conversation, turn), numbered inside each range, and moved on
    by the counts of the ranges before, so that a conversation of any length is cut into tasks.
    """
    dealt = conversations.repartitionByRange("conv_id", "turn").withColumn(
        "range_no", F.spark_partition_id()
    )
    dealt = written(dealt, "turn-ranges")
    ranges = dealt.groupBy("conv_id", "range_no").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = ranges.select(
        "conv_id", "range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conv_id", "range_no").orderBy("turn")
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1)
    return (
        numbered.join(before, ["conv_id", "range_no"])
        .withColumn("place", F.col("place") + F.col("before"))
        .drop("range_no", "before")
    )


def chat_logs(conversations: DataFrame, turns_per_part: int | None = None) -> DataFrame:
    """(conv_id, part, n_turns, chat_log): "role: text" lines in turn order.

    One row per conversation, part 0. With `turns_per_part` a conversation is cut into parts
    of so many turns, counted, not by their numbers; nothing is left out.
    """
    part = F.lit(0).cast("long")
    if turns_per_part is not None:
        conversations = numbered_turns(conversations)
        part = F.floor(F.col("place") / F.lit(turns_per_part)).cast("long")
    lines = F.array_sort(
        F.collect_list(F.struct("turn", chat_line(F.col("role"), F.col("text")).alias("line")))
    )
    return (
        conversations.withColumn("part", part)
        .groupBy("conv_id", "part")
        .agg(lines.alias("lines"))
        .select(
            "conv_id",
            "part",
            F.size("lines").cast("long").alias("n_turns"),
            F.col("lines.line").alias("chat_log"),
        )
    )


def message_counts(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns): rows without a turn number announce a conversation and are no
    messages."""
    return conversations.groupBy("conv_id").agg(F.count("turn").alias("n_turns"))


def chat_text(logs: DataFrame) -> DataFrame:
    return logs.select(
        "conv_id", "part", "n_turns", F.array_join("chat_log", "\n").alias("chat_text")
    )


def opening_text(conversations: DataFrame, turns: int = 3) -> DataFrame:
    """(conv_id, text): the first turns joined by a blank. Only those leave the tasks."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = conversations.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= turns
    )
    lines = F.array_sort(
        F.collect_list(F.struct("turn", chat_line(F.col("role"), F.col("text")).alias("line")))
    )
    return first.groupBy("conv_id").agg(
        tx.first_turns(F.transform(lines, lambda t: t["line"]), turns).alias("text")
    )


def sentences_of(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), tx.strip)
    return F.filter(found, lambda s: s != "")


def sentence_terms(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, sentence_no, term): one row per term occurrence, map-only."""
    sentences = conversations.select(
        "conv_id", "turn", F.posexplode(sentences_of(F.col("text"))).alias("sentence_no", "s")
    )
    found = sentences.select(
        "conv_id", "turn", "sentence_no",
        F.explode(F.split(F.lower("s"), tx.TOKEN_SEPARATOR)).alias("word"),
    ).where((F.col("word") != "") & ~tx.is_stop_word(F.col("word")))
    return found.select(
        "conv_id", "turn", "sentence_no", tx.stem(F.col("word")).alias("term")
    )


def term_weights(terms: DataFrame, conversations: DataFrame) -> DataFrame:
    """(term, idf, occurrences): idf over conversations, counted per task first."""
    n = conversations.agg(F.count_distinct("conv_id")).scalar()
    return (
        terms.groupBy("term", "conv_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("occurrences"))
        .select("term", F.log((1 + n) / (1 + F.col("df"))).alias("idf"), "occurrences")
    )


def score_sentences(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """(conv_id, turn, sentence_no, score): the sum of idf over the root of the length.

    The commonest terms are served by a broadcast of fixed length, and a sentence is summed
    up in the task that reads it. Only its rare terms travel to their weights.
    """
    key = ["conv_id", "turn", "sentence_no"]
    hot = hottest(weights, "term", "occurrences").select("term", "idf")
    summed = (
        terms.join(F.broadcast(hot), "term", "left")
        .groupBy(*key)
        .agg(
            F.coalesce(F.sum("idf"), F.lit(0.0)).alias("common"),
            F.count(F.lit(1)).alias("n"),
            F.collect_list(F.when(F.col("idf").isNull(), F.col("term"))).alias("rest"),
        )
    )
    rare = (
        summed.select(*key, F.explode("rest").alias("term"))
        .join(weights.select("term", "idf"), "term")
        .groupBy(*key)
        .agg(F.sum("idf").alias("rare"))
    )
    total = F.col("common") + F.coalesce("rare", F.lit(0.0))
    return summed.join(rare, key, "left").select(
        *key, F.round(total / F.sqrt("n"), schema.SIMILARITY_DECIMALS).alias("score")
    )


def rank_sentences(
    conversations: DataFrame, sentences: int = SUMMARY_SENTENCES, weights: DataFrame | None = None
) -> DataFrame:
    """(conv_id, turn, sentence_no, score, place) of the best sentences per conversation.

    The place filter trims before the shuffle, so a conversation of any length sends few
    rows.
    """
    terms = sentence_terms(conversations)
    if weights is None:
        weights = written(term_weights(terms, conversations), "term-weights")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn", "sentence_no")
    return score_sentences(terms, weights).withColumn(
        "place", F.row_number().over(order)
    ).where(F.col("place") <= sentences)


def heading_of(sentence: Column) -> Column:
    """The sentence cut to the number of words a heading may have."""
    return F.array_join(F.slice(F.split(sentence, r"\s+"), 1, schema.HEADING_WORDS), " ")


def scored_sentences(conversations: DataFrame, vocabulary: pa.Table, sentences: int) -> DataFrame:
    """(conv_id, turn, sentence_no, sentence, score, n_turns): of each batch of turns the best
    sentences of every conversation, and in its first row the number of its messages.

    vocabulary: term, idf. Nothing is shuffled, and few texts leave a task."""
    terms, idf = vocabulary["term"].combine_chunks(), vocabulary["idf"].to_numpy()
    said = F.when(F.col("turn").isNotNull(), F.col("text"))
    rows = conversations.select("conv_id", "turn", F.posexplode_outer(sentences_of(said)).alias("sentence_no", "sentence"))
    rows = rows.withColumn("terms", tx.terms(F.col("sentence")))
    out = T.StructType([
        rows.schema["conv_id"], rows.schema["turn"], T.StructField("sentence_no", T.IntegerType()),
        T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_turns", T.LongType()),
    ])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            words = batch.column("terms")
            length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            weight = idf[pc.index_in(words.flatten(), value_set=terms).to_numpy(zero_copy_only=False)]
            some = np.flatnonzero(length)
            score = np.full(count, -np.inf)
            if len(some):
                starts = (np.cumsum(length) - length)[some]
                score[some] = np.round(np.add.reduceat(weight, starts) / np.sqrt(length[some]), schema.SIMILARITY_DECIMALS)
            number = pc.fill_null(batch.column("sentence_no"), 0).to_numpy(zero_copy_only=False)
            turn = pc.fill_null(batch.column("turn"), 0).to_numpy(zero_copy_only=False)
            conv = batch.column("conv_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            message = (number == 0) & pc.is_valid(batch.column("turn")).to_numpy(zero_copy_only=False)
            messages = np.bincount(conv[message], minlength=int(conv.max()) + 1)
            order = np.lexsort((number, turn, -score, conv))
            new = np.concatenate([[True], conv[order][1:] != conv[order][:-1]])
            first = np.flatnonzero(new)
            place = np.arange(count) - np.repeat(first, np.diff(np.append(first, count)))
            keep = (place == 0) | (place < sentences) & (score[order] > -np.inf)
            rows_at, head = order[keep], place[keep] == 0
            scored = score[rows_at]
            none = scored == -np.inf
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id").take(pa.array(rows_at)), batch.column("turn").take(pa.array(rows_at)),
                    pa.array(number[rows_at], pa.int32(), mask=none),
                    batch.column("sentence").take(pa.array(rows_at, mask=none)), pa.array(scored, mask=none),
                    pa.array(np.where(head, messages[conv[rows_at]], 0)),
                ],
                names=out.names,
            )

    return rows.mapInArrow(best, out)


def _with_texts(winners: DataFrame, conversations: DataFrame) -> DataFrame:
    """The winners with their sentences, by a join with the turns."""
    return winners.join(
        conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"]
    ).withColumn("sentence", F.get(sentences_of(F.col("text")), F.col("sentence_no")))


def summarize_chats(
    conversations: DataFrame, sentences: int = SUMMARY_SENTENCES, max_terms: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """(conv_id, n_turns, heading, summary, summarize_error) from (conv_id, turn, role, text).

    The summary is the best sentences in their order, the heading comes from the best one.
    A conversation without any scorable sentence gets the fallback texts; one without a message
    (rows without a turn number only announce it) gets an error. With `max_terms` terms at most
    the weights travel to the turns, which are read once more and leave their tasks with the best
    sentences only; else the terms travel to the weights, and the texts of the winners are fetched.
    Rows without a conv_id belong to no conversation.
    """
    conversations = conversations.where("conv_id is not null")
    messages = conversations.where("turn is not null")
    weights = written(term_weights(sentence_terms(messages), messages), "term-weights")
    vocabulary = weights.select("term", "idf").limit(max_terms + 1).toArrow()
    if vocabulary.num_rows <= max_terms:
        found = scored_sentences(conversations, vocabulary, sentences)
        one = Window.partitionBy("conv_id")
        order = one.orderBy(F.desc_nulls_last("score"), "turn", "sentence_no")
        found = found.withColumns({"place": F.row_number().over(order), "n_turns": F.sum("n_turns").over(one)})
        kept = found.where(F.col("place") <= sentences)
        turns = None
    else:
        kept = _with_texts(rank_sentences(messages, sentences, weights), messages)
        turns = message_counts(conversations)
    chosen = kept.groupBy("conv_id").agg(
        *([F.first("n_turns").alias("n_turns")] if turns is None else []),
        F.min_by("sentence", "place").alias("best"),
        F.array_sort(
            F.collect_list(F.when(F.col("score").isNotNull(), F.struct("turn", "sentence_no", "sentence")))
        ).alias("kept"),
    )
    if turns is not None:
        chosen = turns.join(chosen, "conv_id", "left")
    fallback = fallback_summary(F.col("n_turns"))
    some = F.col("n_turns") > 0
    return chosen.select(
        "conv_id",
        "n_turns",
        F.when(some, F.coalesce(heading_of(F.col("best")), fallback["heading"])).alias("heading"),
        F.when(
            some, F.when(F.size("kept") > 0, F.array_join(F.col("kept.sentence"), " ")).otherwise(fallback["summary"])
        ).alias("summary"),
        F.when(~some, EMPTY_LOG).alias("summarize_error"),
    )


def word_buckets(text: Column, dimension: int) -> Column:
    """A bucket number, as text, for every word but stop words; a text of stop words alone
    keeps them. Buckets come from MD5, which every engine computes alike."""

    def kept(found: Column) -> Column:
        rest = F.filter(found, lambda w: ~tx.is_stop_word(w))
        return F.when(F.size(rest) > 0, rest).otherwise(found)

    def bucket(word: Column) -> Column:
        number = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
        return F.pmod(number, F.lit(dimension)).cast("string")

    return F.transform(tx.once(tx.words(F.coalesce(text, F.lit(""))), kept), bucket)


def _with_tokens(texts: DataFrame, dimension: int) -> DataFrame:
    return texts.withColumn("tokens", word_buckets(F.col("text"), dimension))


def _bucket_counts(dimension: int) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dimension)], inputCol="tokens", outputCol="tf"
    )


def hashing_embedder(dimension: int = EMBEDDING_DIMENSION) -> PipelineModel:
    """Hashed word counts of unit length. It depends on no table, so the vectors of every
    ingest and every search compare."""
    return PipelineModel(
        [_bucket_counts(dimension), Normalizer(inputCol="tf", outputCol="unit")]
    )


def fit_embedder(texts: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> PipelineModel:
    """Hashed word counts times smoothed idf, ln((n + 1) / (df + 1)) + 1, of unit length, over
    a `text` column. The model is one vector of `dimension` weights, whatever the size of the
    table; applying it needs no shuffle. Vectors compare only under one model: save it beside
    the store (`model.write().save(path)`) and load it for every later ingest and search."""
    counts = _bucket_counts(dimension)
    fitted = IDF(inputCol="tf", outputCol="tfidf").fit(
        counts.transform(_with_tokens(texts, dimension))
    )
    weights = Vectors.dense(fitted.idf.toArray() + 1)
    return PipelineModel(
        [
            counts,
            ElementwiseProduct(scalingVec=weights, inputCol="tf", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="unit"),
        ]
    )


def embed_texts(texts: DataFrame, model: PipelineModel | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add embedding and embed_error. A text without weight gets NULL and an error, never
    a zero vector. The model is one of `hashing_embedder`, `fit_embedder`, or an embedder of
    `embedder`, which runs a user's model or joins given vectors."""
    if not isinstance(model, PipelineModel):
        return model(texts)
    vector = vector_to_array("unit", "float32")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    weightless = F.array_max(F.col("vector")) <= 0  # weights are never negative
    dimension = len(model.stages[0].vocabulary)
    return (
        model.transform(_with_tokens(texts, dimension))
        .withColumn("vector", vector)
        .withColumn(
            "embed_error",
            F.when(empty, "text is required and cannot be empty").when(
                weightless, "text has no weighted terms"
            ),
        )
        .withColumn("embedding", F.when(F.col("embed_error").isNull(), F.col("vector")))
        .drop("tokens", "tf", "tfidf", "unit", "vector")
    )
