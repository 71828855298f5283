"""Weighted full-text search over heading, summary and context.

A query matches a memory that has all of its terms. The rank is the weighted number of
occurrences per query term; heading counts most, then summary, then context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram import schema
from engram.functions import text as tx
from engram.operators.ranking import order_rank_recency, winners_first
from engram.operators.skew import SHARES, salted_join, text_parts
from engram.sources.workspace import written

MAX_BROADCAST_TERMS = 200_000

FIELDS = {"a": "heading", "b": "summary", "c": "context"}


def field_terms(memories: DataFrame, *carried: str) -> DataFrame:
    """(id, carried columns, field, term): one row per term occurrence, map-only."""
    fields = F.array(
        *[
            F.struct(F.lit(mark).alias("field"), F.coalesce(F.col(name), F.lit("")).alias("text"))
            for mark, name in FIELDS.items()
        ]
    )
    texts = memories.select("id", *carried, F.explode(fields).alias("f"))
    found = texts.select(
        "id",
        *carried,
        "f.field",
        F.explode(F.split(F.lower("f.text"), tx.TOKEN_SEPARATOR)).alias("word"),
    )
    kept = found.where((F.col("word") != "") & ~tx.is_stop_word(F.col("word")))
    return kept.select("id", *carried, "field", tx.stem(F.col("word")).alias("term"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("field") == mark).alias(f"tf_{mark}") for mark in FIELDS]


class Counted(NamedTuple):
    """Terms of some memories: the place of each memory's first row, and for every term of a
    memory, by memory and term, the memory's number, the term's code and its counts by field."""

    first: np.ndarray
    memory: np.ndarray
    term: np.ndarray
    terms: pa.Array
    tf: np.ndarray


def _whole_memories(batches: Iterator[pa.RecordBatch], count: Callable[[pa.Table, Counted], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `field_terms`, in which a memory's terms stand together, counted per memory where
    they are read: what one row of the table holds needs no shuffle."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        memory = np.searchsorted(starts, np.arange(rows.num_rows), "right") - 1
        coded = rows["term"].combine_chunks().dictionary_encode()
        field = pc.index_in(rows["field"], value_set=pa.array(list(FIELDS))).to_numpy()
        key = memory.astype(np.int64) << 32 | coded.indices.to_numpy()
        key, of = np.unique(key, return_inverse=True)
        tf = np.bincount(of * len(FIELDS) + field, minlength=len(key) * len(FIELDS)).reshape(-1, len(FIELDS))
        return count(rows, Counted(starts, key >> 32, key & 0xFFFFFFFF, coded.dictionary, tf))

    def starts_of(rows: pa.Table) -> np.ndarray:
        ids = rows["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            starts = starts_of(rows)
            if len(starts) > 1:  # the last memory may go on
                yield done(rows.slice(0, int(starts[-1])), starts[:-1])
                held = rows.slice(int(starts[-1])).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield done(rows, starts_of(rows))


def weighted_terms(memories: DataFrame) -> DataFrame:
    """(id, term, tf_a, tf_b, tf_c) of memories with unique ids, counted where they are read."""
    names = [f"tf_{mark}" for mark in FIELDS]
    out = T.StructType([
        memories.schema["id"], T.StructField("term", T.StringType()), *[T.StructField(n, T.LongType()) for n in names],
    ])

    def count(rows: pa.Table, found: Counted) -> pa.RecordBatch:
        ids = rows["id"].combine_chunks().take(pa.array(found.first[found.memory]))
        return pa.RecordBatch.from_arrays(
            [ids, found.terms.take(pa.array(found.term)), *[pa.array(x) for x in found.tf.T]], names=["id", "term", *names]
        )

    return field_terms(memories).select("id", "field", "term").mapInArrow(lambda rows: _whole_memories(rows, count), out)


def _weight() -> Column:
    return (
        tx.HEADING_WEIGHT * F.col("tf_a")
        + tx.SUMMARY_WEIGHT * F.col("tf_b")
        + tx.CONTEXT_WEIGHT * F.col("tf_c")
    )


def _rank(total: Column, n_terms: Column) -> Column:
    return F.round(total / n_terms, schema.SIMILARITY_DECIMALS)


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The terms of one query, by the same column functions as the texts, on one row."""
    return spark.range(1).select(tx.query_terms(F.lit(query)).alias("terms")).first().terms


def _asks(wanted: list[str]) -> Column:
    """A query without terms matches nothing."""
    return F.col("term").isin(wanted) if wanted else F.lit(False)


class TermSets(NamedTuple):
    """Distinct sets of terms under one key each, as runs of codes into a sorted vocabulary, and
    for every term the sets that are looked up by it: the term of a set that fewest sets have."""

    keys: pa.Array
    vocabulary: pa.Array
    at: np.ndarray
    size: np.ndarray
    codes: np.ndarray
    by_term: np.ndarray
    sets: np.ndarray


def _term_sets(keys: pa.Array, terms: list[list[str]]) -> TermSets:
    size = np.array([len(t) for t in terms], np.int64)
    vocabulary, codes = np.unique(np.array([w for t in terms for w in t], object), return_inverse=True)
    at = np.cumsum(size) - size
    common = np.bincount(codes, minlength=len(vocabulary))
    rarest = np.array([min(codes[a : a + n].tolist(), key=lambda c: (common[c], c)) for a, n in zip(at, size)], np.int64)
    order = np.argsort(rarest, kind="stable")
    by_term = np.searchsorted(rarest[order], np.arange(len(vocabulary) + 1))
    return TermSets(keys, pa.array(vocabulary.tolist(), pa.string()), at, size, codes, by_term, order)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _set_matches(found: Counted, sets: TermSets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(memory, set, rank) of every memory that has all terms of a set."""
    code = pc.index_in(found.terms, value_set=sets.vocabulary).to_numpy(zero_copy_only=False)[found.term].astype(np.int64)
    key = found.memory << 32 | code
    order = np.argsort(key)
    key, weight = key[order], (found.tf @ np.array([tx.HEADING_WEIGHT, tx.SUMMARY_WEIGHT, tx.CONTEXT_WEIGHT]))[order]
    # Each term of a memory opens the sets that are looked up by it.
    term = key & 0xFFFFFFFF
    opened = sets.by_term[term + 1] - sets.by_term[term]
    memory, tried = np.repeat(key >> 32, opened), sets.sets[_ranges(sets.by_term[term], opened)]
    size = sets.size[tried]
    asked = np.repeat(memory, size) << 32 | sets.codes[_ranges(sets.at[tried], size)]
    place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    has = key[place] == asked
    if not len(tried):
        return memory, tried, np.zeros(0)
    first = np.cumsum(size) - size
    all_of = np.add.reduceat(has, first) == size
    rank = np.round(np.add.reduceat(np.where(has, weight[place], 0.0), first) / size, schema.SIMILARITY_DECIMALS)
    return memory[all_of], tried[all_of], rank[all_of]


def _in_place(memories: DataFrame, keys: pa.Array, terms: list[list[str]], key: T.StructField, carried: list[str]) -> DataFrame:
    """(key, id, carried columns, rank) of the memories that have every term of a set, each
    judged in its own row. The sets travel to the tasks, so their size is the caller's to check."""
    sets = _term_sets(keys, terms)
    out = T.StructType([key, memories.schema["id"], *[memories.schema[c] for c in carried], T.StructField("rank", T.DoubleType())])

    def count(rows: pa.Table, found: Counted) -> pa.RecordBatch:
        memory, of, rank = _set_matches(found, sets)
        taken = pa.array(found.first[memory])
        return pa.RecordBatch.from_arrays(
            [sets.keys.take(pa.array(of)), *[rows[c].combine_chunks().take(taken) for c in ("id", *carried)], pa.array(rank)],
            names=out.names,
        )

    spark = memories.sparkSession
    asked = spark.createDataFrame([(t,) for t in sets.vocabulary.to_pylist()], "term string")
    rows = field_terms(memories, *carried).join(F.broadcast(asked), "term", "left_semi")
    return rows.select("id", *carried, "field", "term").mapInArrow(lambda batches: _whole_memories(batches, count), out)


def matches(memories: DataFrame, query: str) -> DataFrame:
    """(id, created_at, rank) of the memories that have every term of one query, each judged in
    its own row."""
    wanted = terms_of(memories.sparkSession, query)
    key = T.StructField("set_id", T.LongType())
    if not wanted:
        return memories.where(F.lit(False)).select("id", "created_at", F.lit(0.0).alias("rank"))
    return _in_place(memories, pa.array([0]), [wanted], key, ["created_at"]).drop("set_id")


def build_index(memories: DataFrame, path: str) -> None:
    """Store the weighted terms, in each file in term order: a search then reads the pages of
    its terms only.

    Memories are dealt by id into parts of bounded text, in which their terms are counted. Terms
    are dealt by their hash, one of very many memories into several parts by id, which needs no
    pass over the counts before.
    """
    parts = text_parts(memories, list(FIELDS.values()))
    dealt = memories.select("id", "created_at", *FIELDS.values()).repartition(parts, "id")
    counted = field_terms(dealt, "created_at").groupBy("id", "created_at", "term").agg(*_counts())
    share = F.pmod(F.xxhash64("id"), F.lit(min(parts, SHARES)))
    (
        counted.repartition(parts, "term", share)
        .sortWithinPartitions("term", "id")
        .write.parquet(path)
    )


def index_matches(index: DataFrame, query: str) -> DataFrame:
    """The same as `matches`, from a stored index."""
    wanted = terms_of(index.sparkSession, query)
    n_terms = F.lit(len(wanted))
    return (
        index.where(_asks(wanted))
        .groupBy("id", "created_at")
        .agg(F.count(F.lit(1)).alias("found"), F.sum(_weight()).alias("total"))
        .where(F.col("found") == n_terms)
        .select("id", "created_at", _rank(F.col("total"), n_terms).alias("rank"))
    )


def search_text(
    memories: DataFrame,
    query: str,
    limit: int = schema.SEARCH_LIMIT,
    index: DataFrame | None = None,
) -> DataFrame:
    """The best matches of one query by rank, then recency, from an index if there is one."""
    found = matches(memories, query) if index is None else index_matches(index, query)
    best = order_rank_recency(found, limit).select("id", "rank")
    return memories.select("id", "heading", "summary", "context", "created_at").join(
        winners_first(best, limit), "id"
    )


def query_term_sets(queries: DataFrame) -> DataFrame:
    """(query_id, set_id, terms): queries that still have a term."""
    sets = queries.select("query_id", tx.query_terms(F.col("text")).alias("terms"))
    return sets.where(F.size("terms") > 0).select(
        "query_id", F.sha2(F.array_join("terms", " "), 256).alias("set_id"), "terms"
    )


def _few_sets(sets: DataFrame) -> pa.Table | None:
    """The sets (set_id, terms) themselves if they hold MAX_BROADCAST_TERMS terms at most."""
    total = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    return sets.toArrow() if total <= MAX_BROADCAST_TERMS else None


def match_sets(memories: DataFrame, sets: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(set_id, id, carried columns, rank) of the memories that have every term of a set
    (set_id, terms).

    Sets that fit a checked bound travel to the memories, and every memory is judged in its own
    row. More of them meet by joins on their rarest terms.
    """
    few = _few_sets(sets)
    if few is None:
        found = _match_many_sets(memories, sets)
        return found.join(memories.select("id", *carried), "id") if carried else found
    if not few.num_rows:
        few_out = memories.where(F.lit(False))
        return few_out.select(F.lit("").alias("set_id"), "id", *carried, F.lit(0.0).alias("rank"))
    return _in_place(memories, few["set_id"].combine_chunks(), few["terms"].to_pylist(), sets.schema["set_id"], list(carried))


def _match_many_sets(memories: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, id, rank), by joins.

    Each set first meets the memories that have its rarest term, the smallest group it
    could be found in, and only those are checked for the other terms. Joins on a term are
    salted, since one term may occur in a third of all memories.
    """
    asked = sets.select(
        "set_id", "terms", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")
    )
    vocabulary = asked.select("term").distinct()
    postings = salted_join(weighted_terms(memories), vocabulary, ["term"], ["id"], "left_semi")
    postings = written(postings, "postings")
    spread = postings.groupBy("term").agg(F.count(F.lit(1)).alias("memories"))
    rarest = (
        asked.join(spread, "term")
        .groupBy("set_id", "terms", "n_terms")
        .agg(
            F.count(F.lit(1)).alias("known"),
            F.min_by("term", F.struct("memories", "term")).alias("term"),
        )
        .where(F.col("known") == F.col("n_terms"))
        .select("set_id", "terms", "n_terms", "term")
    )
    candidates = salted_join(postings.select("id", "term"), rarest, ["term"], ["id"]).select(
        "set_id", "n_terms", "id", F.explode("terms").alias("term")
    )
    return (
        candidates.join(postings, ["id", "term"])
        .groupBy("set_id", "id", "n_terms")
        .agg(F.count(F.lit(1)).alias("found"), F.sum(_weight()).alias("total"))
        .where(F.col("found") == F.col("n_terms"))
        .select("set_id", "id", _rank(F.col("total"), F.col("n_terms")).alias("rank"))
    )


def match_all(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank): all matches of a query table (query_id, text). Queries with the
    same terms are answered once, under the lowest of their ids."""
    sets = query_term_sets(queries).groupBy("set_id", "terms").agg(
        F.min("query_id").alias("query_id")
    )
    asked = sets.select(F.col("query_id").alias("set_id"), "terms")
    return match_sets(memories, asked).select(F.col("set_id").alias("query_id"), "id", "rank")


def search_text_batch(
    memories: DataFrame, queries: DataFrame, limit: int = schema.SEARCH_LIMIT
) -> DataFrame:
    """(query_id, id, rank, created_at, place): the best matches of every query. The limit
    is taken per term set, trimmed before the shuffle, and then handed to its queries."""
    asked = query_term_sets(queries)
    sets = asked.select("set_id", "terms").distinct()
    dated = match_sets(memories, sets, ("created_at",))
    order = Window.partitionBy("set_id").orderBy(F.desc("rank"), F.desc("created_at"), "id")
    best = dated.withColumn("place", F.row_number().over(order).cast("long")).where(
        F.col("place") <= limit
    )
    return salted_join(
        asked.select("query_id", "set_id"), best, ["set_id"], ["query_id"]
    ).drop("set_id")
