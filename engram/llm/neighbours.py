"""Approximate nearest neighbours by cross-polytope hashing.

1. A pseudo-rotation flips signs and applies the fast Hadamard transform, three times over. A unit
   vector falls into the cell of its nearest signed axis; a table's cell is that of one rotation, or
   of two for tables with many vectors.
2. How many cells of a table a query probes is measured: for a bounded sample of the queries the
   true neighbours are found among all rows, and as many cells are probed as lead to TARGET of
   them. Probes go by how much nearer the best axes are than those of the cell.
3. Cells are dealt to groups of about GROUP vectors, so that a query travels to few of them. A group
   that holds more (copies of one vector share a cell) is cut into blocks, as are its queries, and
   each pair of blocks is one task, which scores the vectors of probed cells in double precision
   and keeps each query's best.
4. A query that meets fewer candidates than it should return is compared with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.sources.workspace import written

LIMIT = 5
#: Share of the sample's true neighbours that the probes must lead to.
TARGET = 0.96
#: Queries in the sample, the ones with the lowest hash of their id.
SAMPLE = 256
TABLES = 4
SEED = 20240601
#: Vectors of a group of cells, and of a block; queries of a block.
GROUP, BLOCK, ASKED = 8_192, 32_768, 8_192
#: Blocks are counted on one in so many rows, by hash.
COUNTED = 16
#: Pairs scored at once, and vectors hashed at once.
PAIRS, SLICE = 1 << 17, 512

HITS = "query_id long, vec_id long, score double"
HIT_TYPES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
ROUTED = "vec_id long, embedding array<{}>, table int, part int, codes array<int>"


def usable(vector: Column) -> Column:
    """Whether a vector holds neither null nor a number that is not finite, and is not zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as rows, each scaled by a power of two, which changes no score."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), n // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), n)
        step *= 2
    return rows / np.sqrt(n)


def axes(units: np.ndarray, table: int, turns: int) -> list[np.ndarray]:
    """The coordinates of unit rows along all signed axes, after each rotation of a table."""
    size = 1 << max(0, int(units.shape[1] - 1).bit_length())
    padded = np.zeros((len(units), size))
    padded[:, : units.shape[1]] = units
    out = []
    for turn in range(turns):
        signs = np.random.default_rng([SEED, table, turn, size]).integers(0, 2, (3, size)) * 2.0 - 1.0
        turned = padded
        for flip in signs:
            turned = hadamard(turned * flip)
        out.append(np.concatenate([turned, -turned], axis=1))
    return out


def cells(units: np.ndarray, table: int, turns: int) -> np.ndarray:
    """The cell of each unit row in a table."""
    out = np.zeros(len(units), np.int64)
    for along in axes(units, table, turns):
        out = out * along.shape[1] + along.argmax(axis=1)
    return out


def costs(units: np.ndarray, table: int, turns: int) -> list[np.ndarray]:
    """For every rotation of a table, how far behind the best axis each axis is, squared."""
    return [(along.max(axis=1, keepdims=True) - along) ** 2 for along in axes(units, table, turns)]


def probe_order(units: np.ndarray, table: int, turns: int, probes: int) -> np.ndarray:
    """The `probes` cells of a table that each unit row comes closest to, in any order."""
    cost = costs(units, table, turns)
    width = cost[0].shape[1]
    probes = min(probes, width**turns)
    order = np.argsort(cost[0], axis=1, kind="stable")
    if turns == 1:
        return order[:, :probes]
    other = np.argsort(cost[1], axis=1, kind="stable")
    a, b = np.take_along_axis(cost[0], order, 1), np.take_along_axis(cost[1], other, 1)
    # Of cell (i, j) by rank, (i + 1)(j + 1) cells cost no more: only few are worth a look.
    i, j = np.divmod(np.arange(width * width), width)
    fit = (i + 1) * (j + 1) <= probes
    i, j = i[fit], j[fit]
    total = a[:, i] + b[:, j]
    if total.shape[1] > probes:
        best = np.argpartition(total, probes - 1, axis=1)[:, :probes]
    else:
        best = np.broadcast_to(np.arange(total.shape[1]), total.shape)
    return np.take_along_axis(order, i[best], 1) * width + np.take_along_axis(other, j[best], 1)


def rank_of(units: np.ndarray, cell: np.ndarray, table: int, turns: int) -> np.ndarray:
    """The probe, from 1, at which each unit row comes to a cell of a table."""
    cost = costs(units, table, turns)
    width, rows = cost[0].shape[1], np.arange(len(units))
    if turns == 1:
        return (cost[0] < cost[0][rows, cell][:, None]).sum(axis=1) + 1
    mine = cost[0][rows, cell // width] + cost[1][rows, cell % width]
    below = np.zeros(len(units), np.int64)
    for r in range(len(units)):
        below[r] = np.searchsorted(np.sort(cost[1][r]), mine[r] - cost[0][r] - 1e-12).sum()
    return below + 1


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` best pairs of each query."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < limit]


def scored(asked: np.ndarray, asked_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pairs: Iterator, limit: int) -> pa.Table:
    """The best candidates of each query among pairs (places of queries, places of rows): cosines
    in double precision, each summed by itself, so that equal vectors score alike."""
    norms, own = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (rows, asked))
    best_q, best_v, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for q, v in pairs:
        other = asked_ids[q] != ids[v]
        q, v = q[other], v[other]
        score = np.einsum("ij,ij->i", asked[q], rows[v]) / (own[q] * norms[v])
        q, v, score = np.append(best_q, q), np.append(best_v, v), np.append(best_s, score)
        keep = best_of(asked_ids[q], ids[v], score, limit)
        best_q, best_v, best_s = q[keep], v[keep], score[keep]
    return pa.table({"query_id": asked_ids[best_q], "vec_id": ids[best_v], "score": best_s}, schema=HIT_TYPES)


def probed_pairs(probes: pa.Table, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries with the rows whose cell they probe."""
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    lists = probes["codes"].combine_chunks()
    wanted = lists.flatten().to_numpy(zero_copy_only=False)
    query = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    low, high = np.searchsorted(sorted_code, wanted), np.searchsorted(sorted_code, wanted, "right")
    met = np.flatnonzero(high > low)
    query, low, size = query[met], low[met], (high - low)[met]
    cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, int(size.sum()) + PAIRS, PAIRS))
    cuts = [0, *np.unique(np.minimum(cuts + 1, len(size))).tolist()]
    for a, b in zip(cuts, cuts[1:]):
        yield np.repeat(query[a:b], size[a:b]), order[ranges(low[a:b], size[a:b])]


def against(batches: Iterator[pa.RecordBatch], asked: np.ndarray, asked_ids: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to the best of the task for a bounded block of queries."""
    units = asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True))
    for batch in batches:
        rows, ids = matrix(batch.column(1), asked.shape[1]), batch.column(0).to_numpy()
        near = units @ (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).T
        few = min(limit + 1, len(rows))  # one may be the query itself
        best = np.argpartition(-near, few - 1, axis=1)[:, :few]
        pairs = np.repeat(np.arange(len(asked)), few), best.ravel()
        yield from scored(asked, asked_ids, rows, ids, iter([pairs]), limit).to_batches()


def routed(batches: Iterator[pa.RecordBatch], dimension: int, turns: int, groups: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to one row per table and group of cells: with its own cell, or with
    the cells that it probes if there are `probes`."""
    for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
        rows = matrix(batch.column(1), dimension)
        units = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        for table in range(TABLES):
            width = (2 << max(0, int(dimension - 1).bit_length())) ** turns
            code = probe_order(units, table, turns, probes) if probes else cells(units, table, turns)[:, None]
            code = np.sort(code, axis=1)
            part = code * groups // width
            row = np.repeat(np.arange(len(rows)), code.shape[1])
            flat, part = code.ravel(), part.ravel()
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
            offsets = pa.array(np.append(new, len(flat)).astype(np.int32))
            taken = pa.array(row[new])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken), batch.column(1).take(taken), pa.array(np.full(len(new), table, np.int32)),
                    pa.array(part[new].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                ],
                names=["vec_id", "embedding", "table", "part", "codes"],
            )


def met(mine: pa.Table, asked: pa.Table, dimension: int, limit: int) -> pa.Table:
    """The best of a block of vectors for a block of queries of the same cells."""
    if not mine.num_rows or not asked.num_rows:
        return HIT_TYPES.empty_table()
    code = mine["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return scored(
        matrix(asked["embedding"].combine_chunks(), dimension), asked["vec_id"].to_numpy(),
        matrix(mine["embedding"].combine_chunks(), dimension), mine["vec_id"].to_numpy(), probed_pairs(asked, code), limit,
    )


def probes_for(rows: DataFrame, asked: DataFrame, dimension: int, turns: int, limit: int) -> int:
    """Probes that lead to TARGET of the true neighbours of SAMPLE queries at most."""
    sample = asked.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return 1
    vectors, ids = matrix(sample["embedding"].combine_chunks(), dimension), sample["vec_id"].to_numpy()
    close = rows.mapInArrow(partial(against, asked=vectors, asked_ids=ids, limit=limit), HITS)
    # SAMPLE * limit rows at most.
    close = rows.join(F.broadcast(top(close, limit)), "vec_id").select("query_id", "embedding").toArrow()
    if not close.num_rows:
        return 1
    order = np.argsort(ids, kind="stable")
    mine = vectors[order[np.searchsorted(ids[order], close["query_id"].to_numpy())]]
    true = matrix(close["embedding"].combine_chunks(), dimension)
    mine, true = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (mine, true))
    soonest = np.min([rank_of(mine, cells(true, t, turns), t, turns) for t in range(TABLES)], axis=0)
    return int(np.quantile(soonest, TARGET, method="inverted_cdf"))


def top(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best of each query, every candidate once."""
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "vec_id", "score")


def in_blocks(mine: DataFrame, asked: DataFrame, route, probe, compare, vectors: int = BLOCK, queries: int = ASKED) -> DataFrame:
    """Rows and queries, each routed to (table, part), meet in pairs of blocks of bounded size.

    How many blocks a part has is counted on a share of the rows, so that few vectors are hashed
    twice; a part that the share misses is one block."""
    keys = ["table", "part"]

    def sizes(side: DataFrame, routing, most: int, name: str) -> DataFrame:
        share = routing(side.where(F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(COUNTED)) == 0))
        return share.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * COUNTED / most).cast("int").alias(name))

    # One row per group of cells.
    blocks = written(sizes(mine, route, vectors, "m").join(sizes(asked, probe, queries, "n"), keys, "full"), "neighbours-blocks")

    def dealt(side: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        def count(name: str) -> Column:
            return F.coalesce(name, F.lit(1))

        return side.join(blocks, keys, "left").select(
            *keys, F.pmod(F.xxhash64("vec_id", "embedding"), count(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), count(other_blocks) - 1)).alias(other), "vec_id", "embedding", "codes",
        )

    left, right = dealt(route(mine), "a", "m", "b", "n"), dealt(probe(asked), "b", "n", "a", "m")
    cell = [*keys, "a", "b"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, HITS)


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the `limit` nearest vectors found for every query.

    Both tables hold `vec_id` and `embedding`; other columns are not read. score is the cosine in
    double precision, ties go to the smaller vec_id. A row is no candidate of the query with its
    vec_id. Rows that share a vec_id count as one candidate, and one query, that is as near as the
    nearest of them. Rows without vec_id, vectors that are null, zero or hold null or numbers that
    are not finite, and those whose length is not the commonest one (the larger of equally common
    ones) take no part. A query gets fewer than `limit` rows only if there are fewer candidates. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession

    def clean(table: DataFrame) -> DataFrame:
        kind = table.schema["embedding"].dataType.elementType
        kind = "float" if isinstance(kind, T.FloatType) else "double"
        table = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"))
        return table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    rows, asked = clean(vectors), clean(queries)
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = common.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, count = common["d"], common["n"]
    rows, asked = (x.where(F.size("embedding") == dimension) for x in (rows, asked))
    width = 2 << max(0, int(dimension - 1).bit_length())
    turns = 2 if count > width**1.5 else 1
    probes = probes_for(rows, asked, dimension, turns, limit)
    groups = int(min(width**turns, -(-count // GROUP)))

    def to_cells(probes: int):
        run = partial(routed, dimension=dimension, turns=turns, groups=groups, probes=probes)
        return lambda side: side.mapInArrow(run, ROUTED.format(side.schema["embedding"].dataType.elementType.simpleString()))

    def compare(mine: pa.Table, asked: pa.Table) -> pa.Table:
        return met(mine, asked, dimension, limit)

    found = written(top(in_blocks(rows, asked, to_cells(0), to_cells(probes), compare), limit), "neighbours")
    # All candidates are due to a query that met fewer than `limit`.
    enough = found.groupBy("query_id").count().where(F.col("count") >= limit)
    starved = asked.join(enough, asked.vec_id == enough.query_id, "left_anti")
    if starved.isEmpty():
        return found

    def whole(table: DataFrame) -> DataFrame:
        return table.select("*", F.lit(0).alias("table"), F.lit(0).alias("part"), F.array(F.lit(0)).alias("codes"))

    rest = top(in_blocks(rows, starved, whole, whole, compare), limit)
    return found.join(starved.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
