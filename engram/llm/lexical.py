"""Ranked lexical search of items over all documents by a tree of frequency-ordered term vectors.

1. Documents are counted: those with a term, all their terms, and how many hold each item term.
2. Every document is restricted to the terms of the items, rarest first. Read in that order the
   restricted vectors are paths of a trie; the table is cut into ranges of paths, so that documents
   with a rare term in common lie in one tree.
3. Each task reads its range in runs of bounded size and builds a tree over each: documents that
   share a path share its nodes, and a node knows the largest tf of every term and the smallest m
   below it. Those bound the score of any document below, since a term adds more the larger tf and
   the smaller m are.
4. Every item walks the tree depth first, best bound first, and leaves out each node whose bound
   is below the item's lowest place so far. What a task has found is carried to its next run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import words
from engram.sources.workspace import written

#: Places per item.
LIMIT = 10
#: Terms of items that one pass over the documents looks for.
PASS_TERMS = 1_000_000
#: Terms of restricted documents under one tree, about.
TREE_TERMS = 1_000_000
#: Documents of a leaf.
LEAF = 2
#: Leading terms that cut the table into ranges.
LEAD = 4
#: Numerators of the score: weight of the document length, and the scales.
SCALE, PART, FLAT, LONG = 1_000_000_000, 1000, 10, 90

VECTORS = "doc_id long, length long, path binary, tfs binary"
HITS = "item long, item_id long, doc_id long, score long"
HIT_TYPES = pa.schema([(n, pa.int64()) for n in ("item", "item_id", "doc_id", "score")])


class Items(NamedTuple):
    """Items of one pass: the number of the first, their ids, and their terms as places in the
    frequency order."""

    first: int
    ids: list[int | None]
    terms: list[np.ndarray]


class Tree(NamedTuple):
    """A run of restricted documents in path order as a trie without single-child nodes.

    Node i covers the documents from `start[i]` up to `end[i]`; `children[i]` are its nodes, none
    for a leaf. What a term of weight 1 adds to a document below a node at most, by the node's
    largest tf of the term and its smallest m, stands term by term: that of term t is at `at[t]` to
    `at[t + 1]` in `node` and `most`. What it adds to a document is in `term` and `adds`, those of
    document d at `own[d]` to `own[d + 1]`.
    """

    start: np.ndarray
    end: np.ndarray
    children: list[np.ndarray]
    at: np.ndarray
    node: np.ndarray
    most: np.ndarray
    own: np.ndarray
    term: np.ndarray
    adds: np.ndarray


def term_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text) to counts: key 0 holds documents with a term and all terms, any other key is a
    wanted term with the documents that hold it."""
    hashed = words.hasher(words.NOT_ALNUM)
    holders, documents, total = np.zeros(len(wanted), np.int64), 0, 0
    for batch in words.sliced(batches, 0):
        found = hashed(batch.column(0))
        sizes = np.diff(found.first)
        documents, total = documents + int((sizes > 0).sum()), total + int(sizes.sum())
        row, place, _ = restricted(found, wanted)
        holders += np.bincount(place, minlength=len(wanted))
    used = np.flatnonzero(holders)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(holders[used], documents)), pa.array(np.append(used * 0, total))],
        names=["place", "n", "terms"],
    )


def restricted(found: words.Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in `wanted`, tf) of every wanted term of the texts, by row and place."""
    place = np.searchsorted(wanted, found.hash)
    place[place == len(wanted)] = 0
    use = np.flatnonzero(wanted[place] == found.hash) if len(wanted) else np.zeros(0, np.int64)
    row = np.searchsorted(found.first, use, "right") - 1
    key, tf = np.unique(row.astype(np.int64) << 32 | place[use], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


def vector_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to restricted vectors; `order` is the place of each wanted term in the
    frequency order. Documents without a wanted term are left out, as they score nothing."""
    hashed = words.hasher(words.NOT_ALNUM)
    for batch in words.sliced(batches, 1):
        found = hashed(batch.column(1))
        row, place, tf = restricted(found, wanted)
        term = order[place]
        by = np.argsort(row << 32 | term)
        row, term, tf = row[by], term[by], tf[by]
        rows, counts = np.unique(row, return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array(np.diff(found.first)[rows]),
                words.binary(cuts, term.astype(">u4")), words.binary(cuts, tf.astype(np.uint32)),
            ],
            names=["doc_id", "length", "path", "tfs"],
        )


def tree_of(paths: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray) -> Tree:
    """The tree of documents whose paths are in order."""
    n, size = len(paths), np.array([len(p) for p in paths])
    shared = [0] * (n + 1)  # leading terms that a document shares with the one before
    for i in range(1, n):
        a, b = paths[i - 1], paths[i]
        both = min(len(a), len(b))
        differ = np.flatnonzero(a[:both] != b[:both])
        shared[i] = int(differ[0]) if len(differ) else both
    lcp = np.array(shared[:n])
    start, end, children, stack = [0], [n], [[]], [0]
    while stack:
        node = stack.pop()
        a, b = start[node], end[node]
        if b - a <= LEAF:
            continue
        # The children part where neighbours share fewest terms; small neighbours share a leaf.
        inner = lcp[a + 1 : b]
        cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
        grouped = [a]
        for x, y in zip(cuts[1:], cuts[2:]):
            if y - grouped[-1] > LEAF:
                grouped.append(x)
        grouped.append(b)
        for x, y in zip(grouped, grouped[1:]):
            children[node].append(len(start))
            stack.append(len(start))
            start.append(x)
            end.append(y)
            children.append([])
    starts, ends = np.array(start), np.array(end)
    doc = np.repeat(np.arange(n), size)
    term, tf = np.concatenate(paths).astype(np.int64), np.concatenate(tfs).astype(np.int64)
    # A document's entry belongs to every node above it: level by level, from the leaves up.
    above = np.full(len(start), -1)
    for node, below in enumerate(children):
        above[below] = node
    leaves = np.flatnonzero([not c for c in children])
    leaves = leaves[np.argsort(starts[leaves])]
    at = leaves[np.searchsorted(starts[leaves], doc, "right") - 1]
    key, most, have = term << 32 | at, tf, []
    while len(key):
        by = np.argsort(key, kind="stable")
        key, most = key[by], most[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, most = key[first], np.maximum.reduceat(most, first)
        have.append((key, most))
        up = above[key & 0xFFFFFFFF]
        key, most = (key >> 32 << 32 | up)[up >= 0], most[up >= 0]
    key, most = (np.concatenate(x) for x in zip(*have))
    by = np.argsort(key, kind="stable")
    key, most = key[by], most[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, most = key[first], np.maximum.reduceat(most, first)
    least = np.array([m[a:b].min() for a, b in zip(start, end)])
    node = key & 0xFFFFFFFF
    return Tree(
        starts, ends, [np.array(c, np.int64) for c in children],
        np.searchsorted(key >> 32, np.arange(int(term.max()) + 2)), node, part(most, least[node]),
        np.concatenate([[0], np.cumsum(size)]), term, part(tf, m[doc]),
    )


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score."""
    return SCALE * tf // (PART * tf + 8 * m)


def walk(tree: Tree, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: list, limit: int) -> int:
    """Put the documents of the tree that are among the best of an item into `best`, a heap of
    (score, -id) with the lowest place first; returns the number of leaves that were read.

    `weights` has a weight for every term, 0 for those that the item does not have."""
    bound = np.zeros(len(tree.start), np.int64)
    for t in terms[terms < len(tree.at) - 1].tolist():
        x = slice(tree.at[t], tree.at[t + 1])
        bound[tree.node[x]] += weights[t] * tree.most[x]
    read, stack = 0, [0]
    while stack:
        node = stack.pop()
        if bound[node] <= 0 or len(best) == limit and bound[node] < best[0][0]:
            continue
        if len(below := tree.children[node]):
            stack.extend(below[np.argsort(bound[below], kind="stable")].tolist())
            continue
        read += 1
        a, b = int(tree.start[node]), int(tree.end[node])
        x = slice(tree.own[a], tree.own[b])
        score = np.add.reduceat(weights[tree.term[x]] * tree.adds[x], tree.own[a:b] - tree.own[a])
        least = best[0][0] if len(best) == limit else 1
        for i in np.flatnonzero(score >= least).tolist():
            entry = (int(score[i]), -int(ids[a + i]))
            if len(best) < limit:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return read


NO_ID = np.iinfo(np.int64).max


def searched(batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, documents: int, total: int, limit: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, length, path, tfs) in path order to the best documents of the task for every item."""
    best: list[list] = [[] for _ in items.ids]
    weights = np.zeros(len(weight), np.int64)

    def run(rows: list) -> None:
        ids, lengths, paths, tfs = zip(*rows)
        m = FLAT + LONG * np.array(lengths, np.int64) * documents // total
        ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        tree = tree_of(list(paths), list(tfs), m)
        for terms, own in zip(items.terms, best):
            weights[terms] = weight[terms]
            walk(tree, terms, weights, ids, own, limit)
            weights[terms] = 0

    rows, held = [], 0
    for batch in batches:
        for doc_id, length, path, tfs in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((doc_id, length, np.frombuffer(path, ">u4").astype(np.int64), np.frombuffer(tfs, np.uint32)))
            held += len(rows[-1][2])
            if held >= TREE_TERMS:
                run(rows)
                rows, held = [], 0
    if rows:
        run(rows)
    out = [
        (items.first + n, i, None if -e[1] == NO_ID else -e[1], e[0])
        for n, (i, own) in enumerate(zip(items.ids, best)) for e in own
    ]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), HIT_TYPES)], schema=HIT_TYPES)


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to the distinct terms of every item, packed."""
    hashed = words.hasher(words.NOT_ALNUM)
    for batch in words.sliced(batches, 1):
        found = hashed(batch.column(1))
        rows = [np.unique(found.hash[found.of(i)]) for i in range(batch.num_rows)]
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(np.diff(cuts)), words.binary(cuts, np.concatenate(rows))],
            names=["item_id", "n_terms", "terms"],
        )


def one_pass(docs: DataFrame, items: pa.Table, first: int, limit: int) -> DataFrame:
    """The best documents of items (item_id, terms) that fit one pass."""
    spark = docs.sparkSession
    lists = [np.frombuffer(t, np.uint64) for t in items["terms"].to_pylist()]
    wanted = np.unique(np.concatenate(lists))
    counts = docs.select("text").mapInArrow(lambda rows: term_rows(rows, wanted), "place long, n long, terms long")
    counts = counts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).toArrow().to_pydict()
    seen = {p: (n, t) for p, n, t in zip(counts["place"], counts["n"], counts["terms"])}
    documents, total = seen.pop(-1, (0, 0))
    holders = np.zeros(len(wanted), np.int64)
    holders[list(seen)] = [n for n, _ in seen.values()]
    # Terms that no document holds stand last, where no path leads.
    by = np.lexsort((np.arange(len(wanted)), holders, holders == 0))
    order = np.empty(len(wanted), np.int64)
    order[by] = np.arange(len(wanted))
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * holders[by] + 1))).astype(np.int64)
    asked = Items(first, items["item_id"].to_pylist(), [np.sort(order[np.searchsorted(wanted, t)]) for t in lists])
    vectors = written(
        docs.select("doc_id", "text").mapInArrow(lambda rows: vector_rows(rows, wanted, order), VECTORS), "lexical-vectors"
    )
    lead = F.substring("path", 1, 4 * LEAD)
    ranged = vectors.withColumn("__lead", lead).repartitionByRange("__lead", "doc_id").sortWithinPartitions("path", "doc_id")
    hits = ranged.drop("__lead").mapInArrow(lambda rows: searched(rows, asked, weight, documents, total, limit), HITS)
    return written(hits, "lexical-hits")


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_id, rank, doc_id, score): the `limit` documents of every item with the highest score.

    docs hold `doc_id` and `text`, items `item_id` and `text`; other columns are not read. Every
    row of docs is a document, so repeated rows take a place each; among equal scores the lower
    doc_id comes first and a null one last. Rows of items that are equal in id and terms count
    once; those that share only an id are ranked each for itself. A null or empty text has no term: such a
    document scores nothing, such an item gets no row. An empty table gives an empty result.
    Items pass the driver in runs of PASS_TERMS terms at most, each of which reads the documents.
    """
    spark = docs.sparkSession
    words.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    split = items.mapInArrow(item_terms, "item_id long, n_terms long, terms binary").where("n_terms > 0").distinct()
    split = written(split, "lexical-items")
    passes = max(1, -(-(split.agg(F.sum("n_terms")).first()[0] or 0) // PASS_TERMS))
    found = None
    for number in range(passes):
        mine = split.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == number).toArrow()
        if mine.num_rows:
            hits = one_pass(docs, mine, number << 40, limit)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], HITS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("item_id", F.col("rank").cast(T.IntegerType()), "doc_id", "score")
