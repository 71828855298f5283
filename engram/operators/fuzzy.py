"""Fuzzy lookup of misspelt or partial text by shared trigrams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import schema
from engram.functions import text as tx
from engram.operators.ranking import winners_first
from engram.operators.skew import SHARES, text_parts


def grams_of(spark: SparkSession, query: str) -> list[str]:
    """The grams of one query, by the same column function as the texts, on one row."""
    return spark.range(1).select(tx.trigrams(F.lit(query)).alias("grams")).first().grams


def trigram_search(
    memories: DataFrame,
    query: str,
    limit: int = schema.SEARCH_LIMIT,
    threshold: float = tx.TRIGRAM_THRESHOLD,
) -> DataFrame:
    """Memories whose heading or summary resembles the query; no shuffle but the top-k."""
    wanted = grams_of(memories.sparkSession, query)
    grams = F.array(*[F.lit(g) for g in wanted]).cast("array<string>")

    def resembles(name: str) -> Column:
        return tx.trigram_similarity(tx.trigrams(F.coalesce(F.col(name), F.lit(""))), grams)

    best = F.round(
        F.greatest(resembles("heading"), resembles("summary")), schema.SIMILARITY_DECIMALS
    )
    # A row below the threshold gets no similarity, and rows without one sort last: the
    # filter follows the limit, so that the similarity is computed once per row.
    kept = tx.once(best, lambda s: F.when(s >= threshold, s))
    return (
        memories.select("id", "heading", kept.alias("similarity"))
        .orderBy(F.desc_nulls_last("similarity"), "id")
        .limit(limit)
        .where(F.col("similarity").isNotNull())
    )


def build_index(memories: DataFrame, path: str) -> None:
    """Store (gram, n_grams, field, id), in each file the rows of a gram together, by n_grams: a
    search then reads the pages of its grams only, and of those the texts of fitting size.

    Grams are dealt by their hash into parts of bounded size, and a gram of very many texts into
    several of them by id, which needs no pass over the grams before. One number, the gram's hash
    before the size, is the whole order inside a part: a number sorts faster than three columns,
    and two grams of one hash only share their pages.
    """
    parts = text_parts(memories, ["heading", "summary"])

    def grams(name: str) -> Column:
        found = tx.trigrams(F.coalesce(F.col(name), F.lit("")))
        return F.struct(F.lit(name).alias("field"), found.alias("grams"))

    fields = memories.select("id", F.explode(F.array(grams("heading"), grams("summary"))).alias("f"))
    rows = fields.select("id", "f.field", F.size("f.grams").alias("n_grams"), F.explode("f.grams").alias("gram"))
    share = F.pmod(F.xxhash64("id"), F.lit(min(parts, SHARES)))
    order = F.shiftleft(F.hash("gram").cast("long"), 32) + F.col("n_grams")
    (
        rows.repartition(parts, "gram", share)
        .withColumn("order", order)
        .sortWithinPartitions("order")
        .drop("order")
        .write.parquet(path)
    )


def search_index(
    index: DataFrame,
    memories: DataFrame,
    query: str,
    limit: int = schema.SEARCH_LIMIT,
    threshold: float = tx.TRIGRAM_THRESHOLD,
) -> DataFrame:
    """The same as `trigram_search`, from a stored index.

    A text with less than threshold times the grams of the query, or more than the reverse,
    cannot reach the threshold, whatever it shares; such sizes are not read.
    """
    wanted = grams_of(memories.sparkSession, query)
    asked = len(wanted)
    spare = 10.0**-schema.SIMILARITY_DECIMALS
    fits = F.col("n_grams") >= math.floor(asked * (threshold - spare))
    if threshold > spare:
        fits = fits & (F.col("n_grams") <= math.ceil(asked / (threshold - spare)))
    shared = F.count(F.lit(1))
    share = shared / (F.col("n_grams") + asked - shared)
    best = (
        index.where(F.col("gram").isin(wanted) & fits if wanted else F.lit(False))
        .groupBy("id", "field", "n_grams")
        .agg(F.round(share, schema.SIMILARITY_DECIMALS).alias("similarity"))
        .groupBy("id")
        .agg(F.max("similarity").alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .orderBy(F.desc("similarity"), "id")
        .limit(limit)
    )
    return memories.select("id", "heading").join(winners_first(best, limit), "id")
