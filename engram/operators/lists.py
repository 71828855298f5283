"""Vector lists in two levels: centroids of centroids, as many as the rows ask for.

Top centroids cut the table into about as many parts as a part then has lists. Within a part the
lists are drawn by a hash of the id, one per `rows_per_list` rows, so that parts with many rows get
many lists. Both levels move to the means of their rows once or more. Rows and queries meet
centroids through `knn.nearest`, which cuts any number of either into blocks, so neither the
lists nor the queries have a bound. How many lists a query probes is measured on a sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema
from engram.functions.vectors import unit_rows
from engram.operators import knn
from engram.sources.workspace import written

CENTROID_DECIMALS = 6
#: Least rows of a list, on average, and how they grow with the root of the table.
LEAST_ROWS, ROOT_SHARE = 4, 16
ROUNDS = 1
#: Queries that the probes are measured on, and the share of their exact hits to be found.
SAMPLE, TARGET = 256, 0.95


class Lists(NamedTuple):
    """centroids: list_id, centroid; members: id, embedding, list_id. Rows without a usable
    vector are in no list."""

    centroids: DataFrame
    members: DataFrame


def rows_per_list(rows: int) -> int:
    return max(LEAST_ROWS, math.isqrt(rows) // ROOT_SHARE)


def id_hash(column: str):
    """A number from 0 up to 2^32 that every engine computes alike."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long")


def assigned(rows: DataFrame, centroids: DataFrame, dimension: int, part: bool = False) -> DataFrame:
    """rows (id, embedding, part) with list_id, the list of the closest centroid (list_id,
    centroid, part), of the same part if asked for; rows without a usable vector drop."""
    mine = centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("embedding"), *(["part"] if part else []))
    asked = rows.select(F.col("id").alias("query_id"), "embedding", *(["part"] if part else []))
    if part:
        mine = mine.withColumn("list_ids", F.array("part"))
        asked = asked.withColumnRenamed("part", "list_id")
    closest = knn.nearest(mine, asked, dimension, limit=1, threshold=-1.0, lists=part)
    closest = closest.select(F.col("query_id").alias("id"), F.col("id").alias("list_id"))
    return written(rows.join(closest, "id"), "lists-assigned")


def means(members: DataFrame, *carried: str) -> DataFrame:
    """(list_id, centroid, carried columns): the mean vector of every list."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    found = members.groupBy("list_id", *carried).agg(mean.alias("mean"))
    centroid = F.transform(vector_to_array("mean"), lambda x: F.round(x, CENTROID_DECIMALS))
    return written(found.select("list_id", centroid.alias("centroid"), *carried), "lists-means")


def build(vectors: DataFrame, dimension: int, rows: int | None = None, rounds: int = ROUNDS) -> Lists:
    """Lists of a table (id, embedding) with unique ids, of `rows` rows each on average, by
    default a number that grows with the root of the table."""
    vectors = vectors.select("id", "embedding").where(F.size("embedding") == dimension)
    count = vectors.count()
    rows = rows or rows_per_list(count)
    tops = max(1, math.ceil(math.sqrt(count / rows)))
    # As many rows as there are top centroids are numbered in one task: the root of the lists.
    seeds = vectors.orderBy(id_hash("id"), "id").limit(tops)
    number = F.row_number().over(Window.orderBy(id_hash("id"), "id")).cast("long")
    centroids = seeds.select(number.alias("list_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    members = assigned(vectors, centroids, dimension)
    for _ in range(rounds):
        centroids = means(members)
        members = assigned(vectors, centroids, dimension)
    parted = members.withColumnRenamed("list_id", "part")
    drawn = parted.where(id_hash("id") < int(2**32 / rows)).select(
        "part", F.col("id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("centroid")
    )
    # Each part's own centroid is a list as well, so that none is without one.
    own = centroids.select(F.col("list_id").alias("part"), F.lit("").alias("name"), "centroid")
    lists = drawn.unionByName(own)
    # One row per list is numbered in one task, without its vector.
    numbers = lists.select("part", "name", F.row_number().over(Window.orderBy("part", "name")).cast("long").alias("list_id"))
    lists = written(lists.join(numbers, ["part", "name"]).drop("name"), "lists-drawn")
    parted = parted.select("id", "embedding", F.col("part"))
    for _ in range(rounds):
        found = assigned(parted, lists, dimension, part=True)
        lists = means(found, "part")
    found = assigned(parted, lists, dimension, part=True)
    return Lists(lists.select("list_id", "centroid"), found.select("id", "embedding", "list_id"))


def write(lists: Lists, path: str, lists_per_folder: int = 64) -> None:
    """Store the members by list: folders of so many lists, sorted by list inside, so that a
    search reads the folders and row groups of its lists. Rebalancing cuts hot folders."""
    folder = F.floor(F.col("list_id") / lists_per_folder).cast("int")
    placed = lists.members.withColumn("folder", folder).hint("rebalance", "folder")
    placed.sortWithinPartitions("folder", "list_id").write.partitionBy("folder").parquet(path)


def probed(centroids: DataFrame, queries: DataFrame, dimension: int, probes: int) -> DataFrame:
    """(query_id, list_id, rank): the lists closest to each query."""
    mine = centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("embedding"))
    found = knn.nearest(mine, queries, dimension, limit=probes, threshold=-1.0)
    return found.select("query_id", F.col("id").alias("list_id"), "rank")


class ClosestLists(knn.Asks):
    """The `probes` lists whose centroids are closest, ties to the lower list. A vector's cuts are the
    similarity and the number of the last of them."""

    def __init__(self, points: np.ndarray, known: np.ndarray, probes: int):
        self.points, self.known, self.probes = points, known, probes

    def near(self, vectors: np.ndarray) -> np.ndarray:
        return np.round(vectors @ self.points.T, schema.SIMILARITY_DECIMALS)

    def __call__(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros((len(vectors), len(numbers)), bool)
        near = knn.lowest(-self.near(vectors), self.probes)
        place = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        return near[:, place] & (self.known[place] == numbers)

    def cuts(self, vectors: np.ndarray) -> np.ndarray:
        out = np.tile([-np.inf, self.known[-1] if len(self.known) else 0.0], (len(vectors), 1))
        step = max(1, knn.SCORES_AT_ONCE // max(1, len(self.known)))
        for start in range(0, len(vectors) if self.probes < len(self.known) else 0, step):
            near = self.near(vectors[start : start + step])
            cut = np.partition(near, len(self.known) - self.probes, axis=1)[:, len(self.known) - self.probes]
            out[start : start + step, 0] = cut
            over = np.flatnonzero(np.count_nonzero(near >= cut[:, None], axis=1) > self.probes)
            for i in over.tolist():
                left = self.probes - np.count_nonzero(near[i] > cut[i])
                out[start + i, 1] = self.known[np.flatnonzero(near[i] == cut[i])[left - 1]]
        return out

    def pairs(self, vectors: np.ndarray, cuts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def tell(query: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            if not len(self.known):
                return np.zeros(len(query), bool)
            place = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
            near = np.round(np.einsum("ij,ij->i", vectors[query], self.points[place]), schema.SIMILARITY_DECIMALS)
            cut, last = cuts[query].T
            return ((near > cut) | (near == cut) & (numbers <= last)) & (self.known[place] == numbers)

        return tell


def closest_lists(centroids: DataFrame, dimension: int, probes: int) -> ClosestLists | None:
    """The same choice as a function for `knn.nearest_met`, which holds the centroids; None if
    they pass the bound of a broadcast. Their number grows with the root of the table."""
    mine = centroids.select(F.col("list_id").alias("query_id"), F.col("centroid").alias("embedding"))
    table = knn.few_queries(mine.orderBy("query_id"), dimension, knn.MAX_BROADCAST_BYTES)
    if table is None:
        return None
    at, points = unit_rows(table["embedding"].combine_chunks(), dimension)
    known = table["query_id"].to_numpy()[at]

    return ClosestLists(points, known, probes)


def by_repeats(queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The queries whose id comes once, and the others, None if there are none: rows that share an
    id share its probes."""
    counts = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    again = written(counts.where("n > 1 and query_id is not null").select("query_id"), "lists-repeated")
    if again.isEmpty():
        return queries, None
    return queries.join(again, "query_id", "left_anti"), queries.join(again, "query_id", "left_semi")


def probes_for(
    lists: Lists, queries: DataFrame, dimension: int, limit: int = schema.SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD, exclude_self: bool = False, sample: int = SAMPLE, target: float = TARGET,
) -> int:
    """Lists to probe so that `target` of the exact hits of a bounded sample of the queries, the
    ones with the lowest hash of their id, are in them."""
    some = written(queries.orderBy(id_hash("query_id"), "query_id").limit(sample), "lists-sample")
    exact = knn.nearest(lists.members, some, dimension, limit, threshold, exclude_self)
    where = exact.join(lists.members.select("id", "list_id"), "id").select("query_id", "list_id")
    ranks = probed(lists.centroids, some, dimension, lists.centroids.count())
    at = where.join(ranks, ["query_id", "list_id"])
    return int(at.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY rank)")).first()[0] or 1)


def search(
    lists: Lists, queries: DataFrame, dimension: int, probes: int, limit: int = schema.SEARCH_LIMIT,
    threshold: float = schema.SEARCH_THRESHOLD, exclude_self: bool = False, **options,
) -> DataFrame:
    """(query_id, id, similarity, rank): the best of the `probes` lists closest to each query."""
    met = lists.members.withColumn("list_ids", F.array("list_id"))
    asks = closest_lists(lists.centroids, dimension, probes)
    hits = None
    if asks is not None:
        single, queries = by_repeats(queries)
        hits = knn.nearest_met(met, single, dimension, asks, limit, threshold, exclude_self, **options)
        if queries is None:
            return hits
    asked = probed(lists.centroids, queries, dimension, probes).select("query_id", "list_id")
    asked = written(queries.join(asked, "query_id"), "lists-asked")
    more = knn.nearest(met, asked, dimension, limit, threshold, exclude_self, lists=True, **options)
    return more if hits is None else hits.unionByName(more)


def pairs_met(lists: Lists, queries: DataFrame, dimension: int, probes: int) -> DataFrame:
    """(pairs, pairs_met): all pairs of a query and a row, and those that a search scores."""
    sizes = lists.members.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    asks = closest_lists(lists.centroids, dimension, probes)
    met = None
    if asks is not None:
        single, queries = by_repeats(queries)
        met = knn.pairs_asked(single, sizes, dimension, asks)
    if queries is not None:
        more = probed(lists.centroids, queries, dimension, probes).join(sizes, "list_id").select("query_id", "n")
        met = more if met is None else met.unionByName(more)
    return met.groupBy("query_id").agg(F.sum("n").alias("n")).agg(
        (F.count(F.lit(1)) * total).alias("pairs"), F.sum("n").alias("pairs_met")
    )
