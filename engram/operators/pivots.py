"""Exact threshold search that leaves out rows by the triangle inequality on angles.

A bounded number of rows serve as pivots. A memory belongs to its closest pivot and, inside it, to
the ring of angles it lies in; for every ring the least and largest angle are known. A query whose
angle to a pivot differs from all of a ring's by more than the threshold's angle cannot reach the
threshold with any memory of it, so it never travels there. What is left is scored as always.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import schema
from engram.functions.vectors import unit_rows
from engram.operators import knn
from engram.operators.lists import id_hash
from engram.sources.workspace import written

#: Most pivots, which the driver and every task hold, and rings of a pivot over half a turn.
MAX_PIVOTS, RINGS = 1024, 16
#: Angles and similarities are taken wider by this, for rounding.
SLACK = 1e-6


def pivots_for(rows: int) -> int:
    return max(1, min(MAX_PIVOTS, math.isqrt(rows) // 2))


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _lists(found: list[np.ndarray], positions: np.ndarray, count: int) -> pa.Array:
    """A list column of `count` rows with the given numbers at some positions."""
    lengths = np.zeros(count + 1, np.int32)
    lengths[positions + 1] = [len(x) for x in found]
    flat = np.concatenate(found) if found else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(flat.astype(np.int32)))


def ringed(memories: DataFrame, dimension: int, pivots: np.ndarray) -> DataFrame:
    """(id, embedding, list_ids, angle): the ring of each memory around its closest pivot; rows
    without a usable vector are in none."""

    @F.arrow_udf("array<int>")
    def ring(vectors: pa.Array) -> pa.Array:
        positions, rows = unit_rows(vectors, dimension)
        away = angles(rows, pivots)
        near = away.argmin(axis=1)
        at = np.minimum(away[np.arange(len(rows)), near] / math.pi * RINGS, RINGS - 1).astype(np.int64)
        return _lists(list((near * RINGS + at)[:, None]), positions, len(vectors))

    @F.arrow_udf("double")
    def angle(vectors: pa.Array) -> pa.Array:
        positions, rows = unit_rows(vectors, dimension)
        out = np.full(len(vectors), np.nan)
        out[positions] = angles(rows, pivots).min(axis=1, initial=math.pi)
        return pa.array(out, mask=np.isnan(out))

    return memories.select("id", "embedding", ring("embedding").alias("list_ids"), angle("embedding").alias("angle"))


def _rings_near(pivots: np.ndarray, extents: np.ndarray, threshold: float) -> tuple[np.ndarray, Callable]:
    """The rings of extents (ring, least angle, largest angle), and which of them may hold a memory
    within the threshold of each of some unit vectors, as a matrix."""
    extents = extents[np.argsort(extents[:, 0])]
    number, low, high = extents[:, 0].astype(np.int64), extents[:, 1] - SLACK, extents[:, 2] + SLACK
    reach = math.acos(max(-1.0, min(1.0, threshold - SLACK))) + SLACK

    def near(rows: np.ndarray, some=slice(None)) -> np.ndarray:
        away = angles(rows, pivots)[:, number[some] // RINGS]
        return (away - reach <= high[some]) & (away + reach >= low[some])

    return number, near


def asked_rings(pivots: np.ndarray, extents: np.ndarray, threshold: float) -> Callable:
    """The same for `knn.nearest_met`, of some of the rings."""
    number, near = _rings_near(pivots, extents, threshold)
    return lambda rows, numbers: near(rows, np.searchsorted(number, numbers))


def reachable(queries: DataFrame, dimension: int, pivots: np.ndarray, extents: np.ndarray, threshold: float) -> DataFrame:
    """(query_id, embedding, list_id): one row for every ring that may hold a memory within the
    threshold. extents: ring, least angle, largest angle."""
    number, near = _rings_near(pivots, extents, threshold)

    @F.arrow_udf("array<int>")
    def rings(vectors: pa.Array) -> pa.Array:
        positions, rows = unit_rows(vectors, dimension)
        return _lists([number[x] for x in near(rows)], positions, len(vectors))

    return queries.select("query_id", "embedding", F.explode(rings("embedding")).alias("list_id"))


def prepared(memories: DataFrame, dimension: int, count: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Memories with the ring they are in, the pivots, and the extents of the rings."""
    usable = memories.select("id", "embedding").where(F.size("embedding") == dimension)
    count = count or pivots_for(usable.count())
    chosen = usable.orderBy(id_hash("id"), "id").limit(count).toArrow()
    _, pivots = unit_rows(chosen["embedding"].combine_chunks(), dimension)
    if not len(pivots):
        pivots = np.eye(1, dimension)
    mine = written(ringed(usable, dimension, pivots), "pivots-rings")
    extents = mine.select(F.explode("list_ids").alias("ring"), "angle").groupBy("ring").agg(F.min("angle"), F.max("angle"))
    rows = extents.toArrow()  # at most MAX_PIVOTS * RINGS
    table = np.stack([c.to_numpy().astype(float) for c in rows.columns], axis=1) if rows.num_rows else np.zeros((0, 3))
    return mine.select("id", "embedding", "list_ids"), pivots, table


def nearest_above(
    memories: DataFrame, queries: DataFrame, dimension: int, limit: int = schema.DUPLICATE_LIMIT,
    threshold: float = schema.DUPLICATE_THRESHOLD, exclude_self: bool = False, count: int | None = None, **options,
) -> DataFrame:
    """(query_id, id, similarity, rank): the same as `knn.nearest`, hit for hit, but queries meet
    only the rings that they can reach."""
    mine, *rings = prepared(memories, dimension, count)
    asks = asked_rings(*rings, threshold)
    return knn.nearest_met(mine, queries, dimension, asks, limit, threshold, exclude_self, **options)


def pairs_met(memories: DataFrame, queries: DataFrame, dimension: int, threshold: float, count: int | None = None) -> DataFrame:
    """(pairs, pairs_met, rings, rings_met): pairs of queries and memories, and of queries and
    rings, in all and those that are left to be scored."""
    mine, *found = prepared(memories, dimension, count)
    asked = reachable(queries, dimension, *found, threshold)
    sizes = written(mine.select(F.explode("list_ids").alias("list_id")).groupBy("list_id").agg(F.count(F.lit(1)).alias("n")), "pivots-sizes")
    total, rings = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    met = asked.join(sizes, "list_id").agg(F.sum("n").alias("pairs_met"), F.count(F.lit(1)).alias("rings_met"))
    return met.select(
        (F.lit(queries.count()) * F.lit(total or 0)).alias("pairs"), "pairs_met",
        (F.lit(queries.count()) * F.lit(rings)).alias("rings"), "rings_met",
    )


def near_duplicates(memories: DataFrame, new_rows: DataFrame, dimension: int, **options) -> DataFrame:
    """Stored memories that resemble each new row (query_id, embedding), itself excluded."""
    return nearest_above(memories, new_rows, dimension, exclude_self=True, **options)
