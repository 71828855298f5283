"""Approximate nearest memories: lists around given centroids, and random hyperplanes with probes
of neighbouring buckets. `lists` draws centroids itself, in two levels.

Both only decide which memories a query meets; similarities are exact, and lists of any
size are handled by `knn.nearest`, which cuts them into blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import schema
from engram.functions.vectors import l2_normalize, unit_rows
from engram.operators import knn, lists
from engram.operators.lists import SAMPLE, TARGET, id_hash
from engram.operators.skew import broadcast_if_few
from engram.sources.workspace import written

CENTROID_DECIMALS = 6
KMEANS_SEED = 7
KMEANS_ROUNDS = 10
#: Costs of buckets that are held at once, and the last bucket where there is no other of its cost.
COSTS_AT_ONCE, NO_LAST = 1 << 19, float(1 << 62)
#: Rows of a bucket that `bits_for` aims at, and most buckets that are tried when probes are
#: measured.
ROWS_PER_BUCKET, MOST_PROBES = 8, 4096


def mean_centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(list_id, centroid): mean vector per group, summed per task before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    means = vectors.where(F.col("embedding").isNotNull()).groupBy(group).agg(mean.alias("mean"))
    return means.select(
        F.col(group).cast("int").alias("list_id"),
        F.transform(
            vector_to_array("mean"), lambda x: F.round(x, CENTROID_DECIMALS)
        ).alias("centroid"),
    )


def kmeans_centroids(
    vectors: DataFrame,
    lists: int = schema.IVF_LISTS,
    seed: int = KMEANS_SEED,
    fraction: float = 1.0,
) -> DataFrame:
    """(list_id, centroid) by k-means over unit vectors.

    k-means reads its input many times; on a large table a small fraction places the
    centroids as well. They only draw the borders of the lists: all memories are indexed.
    """
    if fraction < 1.0:
        vectors = vectors.sample(fraction, seed=seed)
    units = vectors.where(F.col("embedding").isNotNull()).select(
        array_to_vector(l2_normalize(F.col("embedding"))).alias("features")
    )
    model = KMeans(
        k=lists, seed=seed, maxIter=KMEANS_ROUNDS, featuresCol="features"
    ).fit(units)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>")


def assign_lists(vectors: DataFrame, centroids: DataFrame, dimension: int) -> DataFrame:
    """Add list_id, the list with the closest centroid; rows without a usable vector drop. Any
    number of lists: `knn.nearest` cuts them into blocks."""
    closest = lists.probed(centroids, vectors.select(F.col("id").alias("query_id"), "embedding"), dimension, 1)
    return vectors.join(closest.select(F.col("query_id").alias("id"), "list_id"), "id")


def build_ivf(memories: DataFrame, centroids: DataFrame, dimension: int, path: str) -> None:
    """Write the memories one folder per list. Rebalancing cuts a list that holds many rows
    into several files and keeps small lists in one."""
    assigned = assign_lists(memories.select("id", "embedding"), centroids, dimension)
    assigned.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def search_ivf(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    dimension: int,
    probes: int,
    limit: int = schema.SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD,
    exclude_self: bool = False,
    **options,
) -> DataFrame:
    """Best memories of the `probes` lists closest to each query.

    Over an index written by `build_ivf` the list filter prunes folders.
    """
    near = lists.probed(centroids, queries, dimension, probes).select("query_id", "list_id")
    asked = written(queries.select("query_id", "embedding").join(near, "query_id"), "ivf-asked")
    needed = broadcast_if_few(asked.select("list_id").distinct())
    met = index.join(needed, "list_id", "left_semi").withColumn("list_ids", F.array("list_id"))
    return knn.nearest(
        met, asked, dimension, limit, threshold, exclude_self, lists=True, **options
    )


def hyperplanes(tables: int, bits: int, dimension: int) -> np.ndarray:
    """Planes with entries +1 or -1, taken from digests so that any engine can redo them."""
    signs = [
        1.0 if hashlib.md5(f"{t}-{b}-{d}".encode()).hexdigest()[0] < "8" else -1.0
        for t in range(tables)
        for b in range(bits)
        for d in range(dimension)
    ]
    return np.array(signs).reshape(tables * bits, dimension)


def bits_for(rows: int) -> int:
    """Planes that leave about ROWS_PER_BUCKET rows in a bucket of a table."""
    return max(1, int(math.log2(max(2, rows / ROWS_PER_BUCKET))))


def closest_buckets(margins: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` buckets that rows come closest to, closest first: planes are crossed in the
    order of the sum of the margins crossed, ties by bucket number. Plane by plane only the best
    sums go on, as each later plane adds to a sum or leaves it."""
    rows, bits = margins.shape
    cost, bucket = np.zeros((rows, 1)), np.zeros((rows, 1), np.int64)
    for bit in range(bits):
        margin = margins[:, bit : bit + 1]
        side = (margin >= 0).astype(np.int64) << bit
        cost = np.concatenate([cost, cost + np.abs(margin)], axis=1)
        bucket = np.concatenate([bucket + side, bucket + (side ^ (1 << bit))], axis=1)
        order = np.lexsort((bucket, cost), axis=1)[:, :probes]
        cost, bucket = np.take_along_axis(cost, order, 1), np.take_along_axis(bucket, order, 1)
    return bucket


def lsh_buckets(embedding, tables: int, bits: int, dimension: int, probes: int = 1):
    """Array column with bucket ids of every table, table * 2^bits + side of each plane: the
    `probes` that a vector comes closest to, its own first."""
    planes = hyperplanes(tables, bits, dimension)
    probes = min(probes, 1 << bits)

    @F.arrow_udf("array<long>")
    def buckets(vectors: pa.Array) -> pa.Array:
        positions, rows = unit_rows(vectors, dimension)
        margins = (rows @ planes.T).reshape(len(rows), tables, bits)
        ids = [closest_buckets(margins[:, t], probes) + (t << bits) for t in range(tables)]
        lengths = np.zeros(len(vectors) + 1, np.int32)
        lengths[positions + 1] = tables * probes
        flat = np.concatenate(ids, axis=1).ravel() if len(rows) else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(flat))

    return buckets(embedding)


class ProbedBuckets(knn.Asks):
    """The buckets of `lsh_buckets` for `knn.nearest_met`: which of some buckets each of some unit
    vectors probes. A vector's cuts are, for each table, the cost and the number of the last bucket it
    probes, or no number where none after it costs as much."""

    def __init__(self, tables: int, bits: int, dimension: int, probes: int):
        self.planes, self.buckets = hyperplanes(tables, bits, dimension), np.arange(1 << bits)
        self.tables, self.bits, self.probes = tables, bits, probes

    def margins(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each table's planes cost to cross, and the own bucket. Summed alike for one vector
        and for many, as costs are compared with cuts."""
        margins = np.einsum("ij,kj->ik", vectors, self.planes).reshape(len(vectors), self.tables, self.bits)
        own = ((margins >= 0).astype(np.int64) << np.arange(self.bits)).sum(axis=2)
        return np.abs(margins), own

    def costs(self, cross: np.ndarray) -> np.ndarray:
        """Of every set of planes crossed, added in the order of the planes."""
        cost = np.zeros((len(cross), 1))
        for bit in range(self.bits):
            cost = np.concatenate([cost, cost + cross[:, bit : bit + 1]], axis=1)
        return cost

    def __call__(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        cross, own = self.margins(vectors)
        out = np.zeros((len(vectors), len(numbers)), bool)
        for t in range(self.tables):
            mine = np.flatnonzero(numbers >> self.bits == t)
            cost = np.take_along_axis(self.costs(cross[:, t]), self.buckets ^ own[:, t : t + 1], 1)
            out[:, mine] = knn.lowest(cost, self.probes)[:, numbers[mine] - (t << self.bits)]
        return out

    def closest(self, cross: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, float, float, np.ndarray]]:
        """(position, cut, last, sets of planes crossed) of some vectors in one table."""
        step = max(1, COSTS_AT_ONCE >> self.bits)
        for start in range(0, len(cross), step):
            cost = self.costs(cross[start : start + step])
            if self.probes >= cost.shape[1]:
                for i in range(len(cost)):
                    yield start + i, np.inf, NO_LAST, self.buckets
                continue
            cut = np.partition(cost, self.probes - 1, axis=1)[:, self.probes - 1]
            within = cost <= cut[:, None]
            for i in range(len(cost)):
                sets, last = np.flatnonzero(within[i]), NO_LAST
                if len(sets) > self.probes:
                    order = np.lexsort((sets ^ own[start + i], cost[i, sets]))[: self.probes]
                    sets = sets[order]
                    last = sets[-1] ^ own[start + i]
                yield start + i, cut[i], last, sets

    def cuts(self, vectors: np.ndarray) -> np.ndarray:
        cross, own = self.margins(vectors)
        out = np.empty((len(vectors), self.tables, 2))
        for t in range(self.tables):
            for i, cut, last, _ in self.closest(cross[:, t], own[:, t]):
                out[i, t] = cut, last
        return out.reshape(len(vectors), -1)

    def pairs(self, vectors: np.ndarray, cuts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        cross, own = self.margins(vectors)
        cuts = cuts.reshape(-1, self.tables, 2)

        def tell(query: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            table, bucket = numbers >> self.bits, numbers & ((1 << self.bits) - 1)
            crossed, margin, cost = bucket ^ own[query, table], cross[query, table], np.zeros(len(query))
            for bit in range(self.bits):
                cost += margin[:, bit] * (crossed >> bit & 1)
            cut, last = cuts[query, table].T
            return (cost < cut) | (cost == cut) & (bucket <= last)

        return tell

    def held(self, vectors: np.ndarray, numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
        cross, own = self.margins(vectors)
        sizes = np.zeros(self.tables << self.bits, n.dtype)
        sizes[numbers] = n
        out = np.zeros(len(vectors), n.dtype)
        for t, size in enumerate(sizes.reshape(self.tables, -1)):
            for i, _, _, sets in self.closest(cross[:, t], own[:, t]):
                out[i] += size[sets ^ own[i, t]].sum()
        return out


def probed_buckets(tables: int, bits: int, dimension: int, probes: int) -> ProbedBuckets:
    return ProbedBuckets(tables, bits, dimension, probes)


def lsh_probes_for(
    memories: DataFrame, queries: DataFrame, dimension: int, tables: int, bits: int, limit: int = schema.SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD, exclude_self: bool = False, sample: int = SAMPLE, target: float = TARGET,
) -> int:
    """Buckets to probe in each table so that `target` of the exact hits of a bounded sample of
    the queries, the ones with the lowest hash of their id, are in them; MOST_PROBES at most."""
    some = written(queries.orderBy(id_hash("query_id"), "query_id").limit(sample), "lsh-sample")
    exact = knn.nearest(memories, some, dimension, limit, threshold, exclude_self).select("query_id", "id")
    own = F.explode(lsh_buckets("embedding", tables, bits, dimension)).alias("bucket")
    hits = memories.select("id", "embedding").join(F.broadcast(exact), "id")  # sample * limit rows
    hits = hits.select("query_id", "id", own)
    most = min(1 << bits, MOST_PROBES)
    near = some.select("query_id", F.posexplode(lsh_buckets("embedding", tables, bits, dimension, most)).alias("at", "bucket"))
    near = near.select("query_id", "bucket", (F.col("at") % most + 1).alias("probe"))
    first = hits.join(near, ["query_id", "bucket"], "left").groupBy("query_id", "id").agg(
        F.coalesce(F.min("probe"), F.lit(most)).alias("probe")
    )
    return int(first.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY probe)")).first()[0] or 1)


def search_lsh(
    memories: DataFrame,
    queries: DataFrame,
    dimension: int,
    tables: int = 8,
    bits: int = 4,
    limit: int = schema.SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD,
    exclude_self: bool = False,
    probes: int = 1,
    **options,
) -> DataFrame:
    """Best memories of the `probes` buckets of every table that a query comes closest to."""
    own = lsh_buckets("embedding", tables, bits, dimension)
    return knn.nearest_met(
        memories.select("id", "embedding", own.alias("list_ids")), queries, dimension,
        probed_buckets(tables, bits, dimension, probes), limit, threshold, exclude_self, **options,
    )


def lsh_pairs_met(memories: DataFrame, queries: DataFrame, dimension: int, tables: int, bits: int, probes: int) -> DataFrame:
    """(pairs, pairs_met): all pairs of a query and a row, and those in a probed bucket, each
    counted once per table."""
    own = memories.select(F.explode(lsh_buckets("embedding", tables, bits, dimension)).alias("bucket"))
    sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    asks = probed_buckets(tables, bits, dimension, probes)
    met = knn.pairs_asked(queries, sizes.withColumnRenamed("bucket", "list_id"), dimension, asks)
    met = met.groupBy("query_id").agg(F.sum("n").alias("n"))
    return met.agg(
        (F.count(F.lit(1)) * (sizes.agg(F.sum("n")).scalar() / tables)).cast("long").alias("pairs"),
        F.sum("n").alias("pairs_met"),
    )


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """How many of the exact hits were found, over all queries."""
    found = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("hit").alias("found_hits"),
        F.round(F.count("hit") / F.count(F.lit(1)), schema.SIMILARITY_DECIMALS).alias("recall"),
    )
