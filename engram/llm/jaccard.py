"""Exact Jaccard join of documents on their word n-grams, by signature trees.

1. Every text becomes its set of distinct shingle hashes; equal sets become one.
2. A census of a fixed part of the shingle space leaves out sets that cannot be linked: of the
   shingles of a linked set at most the share 1 - t is missing from its partner, so a set whose
   shared shingles are too few has no partner. Nothing that could link is lost.
3. Sets that share a rare shingle of their prefix form a group. A pair across groups overlaps
   too little (prefix filter), so each group gets a signature tree of its own.
4. The trees are walked in pairs of nodes (`clusters`), and leaves are compared exactly.

Shingles are 64-bit hashes; two different ones are taken as one with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import census, clusters, words
from engram.operators import skew
from engram.sources.workspace import written

#: The census looks at shingles whose hash is a multiple of this.
CENSUS_STEP = 4
#: Sets below a leaf of a tree inside a task.
LEAF = 32


def set_rows(batches: Iterator[pa.RecordBatch], size: int, step: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, set_key, tokens): every step-th shingle of each set."""
    hashed = words.hasher()
    for batch in words.sliced(batches, 1):
        found = hashed(batch.column(1))
        grams = words.windows(found.hash, size)
        n, keys, picked = [], [], []
        for row in range(batch.num_rows):
            tokens = words.shingles(found, row, grams, size)
            n.append(len(tokens))
            keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            picked.append(tokens[tokens % np.uint64(step) == 0] if step > 1 else tokens)
        at = np.cumsum([0, *map(len, picked)])
        flat = np.concatenate(picked) if picked else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), words.binary(at, flat)],
            names=["doc_id", "n", "set_key", "tokens"],
        )


SETS = "doc_id long, n long, set_key binary, tokens binary"


def sets_of(docs: DataFrame, size: int, step: int) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(lambda rows: set_rows(rows, size, step), SETS)


def packed_cells(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(rep, n, tokens) to census cells."""
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        tokens, counts = words.unpacked(batch.column(2))
        docs = np.repeat(np.arange(batch.num_rows), counts)
        yield from census.cells(batch.column(0).to_numpy(), docs, tokens, parts, task * 1009 + i)


def may_link(sets: DataFrame, percent: int, step: int) -> DataFrame:
    """Sets (rep, n, tokens) whose counted shingles are shared often enough for a link."""
    total = sets.agg(F.sum(F.length("tokens"))).first()[0] or 0
    parts = census.parts_for(total // 8)
    buckets = 4 * parts
    found = census.answers(sets.mapInArrow(lambda rows: packed_cells(rows, parts), census.CELL), buckets)

    def dealt(batches):
        for batch in batches:
            bucket = census.bucket_of(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), batch.column(1), batch.column(2)], names=["bucket", "rep", "n", "counted"])

    def judged(rows: pa.Table, shared: pa.Table) -> pa.Table:
        known = census.by_key(shared)
        common = np.array([len(known.get(k, ())) for k in rows["rep"].to_pylist()], np.int64)
        n = rows["n"].to_numpy()
        keep = pa.array(rows["counted"].to_numpy() - common <= n * (100 - percent) // 100)
        return rows.select(["rep", "n"]).filter(keep)

    sizes = sets.select("rep", "n", F.floor(F.length("tokens") / 8).cast("long").alias("counted"))
    sizes = sizes.mapInArrow(dealt, "bucket int, rep long, n long, counted long")
    return sizes.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(judged, "rep long, n long")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets with their tokens as lists and as a bitmap of BITS bits."""
    for batch in batches:
        tokens, counts = words.unpacked(batch.column(3))
        bit = (tokens >> np.uint64(20)) % np.uint64(clusters.BITS)
        dense = np.zeros((batch.num_rows, clusters.BITS), np.uint8)
        dense[np.repeat(np.arange(batch.num_rows), counts), bit.astype(np.int64)] = 1
        lanes = np.packbits(dense, axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(tokens.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), lists, batch.column(3), *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(len(clusters.LANES)))],
            names=["node", "size", "list", "tokens", *clusters.LANES],
        )


LISTED = "node long, size long, list array<long>, tokens binary, " + ", ".join(f"{b} long" for b in clusters.LANES)


def groups(sets: DataFrame, percent: int) -> DataFrame:
    """(node, group): sets that share a prefix shingle, directly or through others."""
    tokens = sets.select("node", "size", F.explode("list").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.ceil(F.col("size") * percent / 100)
    prefix = (
        tokens.join(df, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .withColumn("length", F.size("shared") - need + 1).where("length > 0")
        .select("node", F.explode(F.expr("slice(shared, 1, cast(length as int))")).alias("s"))
        .select("node", F.col("s.token").alias("token"))
    )
    prefix = written(prefix, "jaccard-prefix")
    lowest = prefix.groupBy("token").agg(F.min("node").alias("b"))
    edges = prefix.join(lowest, "token").select(F.col("node").alias("a"), "b").distinct()
    return clusters.components(edges, "jaccard-groups").withColumnRenamed("component", "group")


def overlaps(x_tokens: list[np.ndarray], y_tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: frequent tokens by a matrix product,
    rare ones by counting pairs."""
    nx, ny = len(x_tokens), len(y_tokens)
    flat = np.concatenate([*x_tokens, *y_tokens])
    row = np.repeat(np.arange(nx + ny), [len(t) for t in (*x_tokens, *y_tokens)])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(start, len(flat)))
    left = np.add.reduceat((row < nx).astype(np.int64), start)
    both = (left > 0) & (left < count)
    out = np.zeros((nx, ny), np.int64)
    frequent = both & (left * (count - left) > 64)
    rare = both & ~frequent
    ids = np.repeat(np.cumsum(frequent) - 1, count)
    keep = np.repeat(frequent, count)
    ids, rows = ids[keep], row[keep]
    for a in range(0, int(frequent.sum()), 4096):
        here = (ids >= a) & (ids < a + 4096)
        dense = np.zeros((nx + ny, min(4096, int(frequent.sum()) - a)), np.float32)
        dense[rows[here], ids[here] - a] = 1
        out += np.rint(dense[:nx] @ dense[nx:].T).astype(np.int64)
    # Rare tokens have few holders on either side (64 pairs at most): pair them place by place.
    at, n_left, n_all = start[rare], left[rare], count[rare]
    i = 0
    while len(at):
        j = 0
        while (use := (n_left > i) & (n_all - n_left > j)).any():
            np.add.at(out, (row[at[use] + i], row[at[use] + n_left[use] + j] - nx), 1)
            j += 1
        i += 1
        more = n_left > i
        at, n_left, n_all = at[more], n_left[more], n_all[more]
    return out


def leaf_mask(bits: np.ndarray, n: np.ndarray, other_bits: np.ndarray, other_n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of leaves whose members can overlap enough."""
    def nodes(b, s):
        cuts = np.arange(0, len(s), LEAF)
        hidden = s - np.bitwise_count(b).sum(axis=1)
        return (np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(s, cuts), np.maximum.reduceat(s, cuts), np.maximum.reduceat(hidden, cuts))

    (xb, x_least, x_most, xh), (yb, y_least, y_most, yh) = nodes(bits, n), nodes(other_bits, other_n)
    common = np.array([np.bitwise_count(yb & b).sum(axis=1) for b in xb]).astype(np.int64)
    overlap = np.minimum(xh[:, None], yh[None, :]) + common
    need = (x_least[:, None] + y_least[None, :]) * percent
    sizes = (100 * x_most[:, None] >= percent * y_least[None, :]) & (100 * y_most[None, :] >= percent * x_least[:, None])
    return sizes & (overlap * (100 + percent) >= need)


def compare(left: pa.Table, right: pa.Table | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks, or inside one, reduced to pairs that join the same nodes."""
    def block(table):
        n = table["size"].to_numpy()
        order = np.argsort(n, kind="stable")
        tokens = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
        bits = np.zeros((len(n), clusters.BITS // 64), np.uint64)
        for k, t in enumerate(tokens):
            bit = (t >> np.uint64(20)) % np.uint64(clusters.BITS)
            np.bitwise_or.at(bits[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return table["node"].to_numpy()[order], n[order], [tokens[k] for k in order], bits[order]

    x = block(left)
    y = block(right) if right is not None else x
    mask = leaf_mask(x[3], x[1], y[3], y[1], percent)
    keep_x = np.flatnonzero(np.repeat(mask.any(axis=1), LEAF)[: len(x[1])])
    keep_y = np.flatnonzero(np.repeat(mask.any(axis=0), LEAF)[: len(y[1])])
    if not len(keep_x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = overlaps([x[2][k] for k in keep_x], [y[2][k] for k in keep_y])
    size = x[1][keep_x][:, None] + y[1][keep_y][None, :]
    links = 100 * both >= percent * (size - both)
    return spanning(x[0][keep_x], y[0][keep_y], links)


def spanning(x: np.ndarray, y: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few pairs that join the nodes which the links join: each node and the lowest one."""
    lx, ly = x.copy(), y.copy()
    top = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(lx, np.where(links, ly[None, :], top).min(axis=1, initial=top))
        ny = np.minimum(ly, np.where(links, nx[:, None], top).min(axis=0, initial=top))
        if np.array_equal(nx, lx) and np.array_equal(ny, ly):
            break
        lx, ly = nx, ny
    a, b = np.concatenate([x, y]), np.concatenate([lx, ly])
    return a[a != b], b[a != b]


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Documents with a `doc_id` and a `text` to doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word
    shingles (A-Z lower-cased). component_id is the lowest doc_id reachable. Texts without a
    word, null or empty, have no shingles and link with nothing; shorter texts have one shingle,
    their whole sequence. A null doc_id links with nothing and gets a null component. Repeated
    rows give repeated rows; rows that share an id but not a text count as linked. Other columns
    are ignored; an empty table gives an empty result.
    """
    words.bounded_batches(docs.sparkSession)
    found = written(sets_of(docs, size, CENSUS_STEP), "jaccard-sets")
    usable = found.where("n > 0 and doc_id is not null")
    classes = written(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens")),
        "jaccard-classes",
    )
    kept = written(may_link(classes.select("rep", "n", "tokens"), percent, CENSUS_STEP), "jaccard-kept")
    keys = classes.select("rep", "set_key")
    chosen = docs.join(skew.broadcast_if_few(kept.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    full = sets_of(chosen, size, 1)
    full = full.join(keys, (full.doc_id == keys.rep) & (full.set_key == keys.set_key), "left_semi")
    full = full.dropDuplicates(["doc_id", "set_key"]).select("doc_id", "n", "set_key", "tokens")
    members = written(full.mapInArrow(listed, LISTED), "jaccard-full")
    by_group = groups(members.select("node", "size", "list"), percent)
    trees = members.drop("list").join(by_group, "node")
    joined = clusters.linked(trees, percent / 100, lambda a, b: compare(a, b, percent), "jaccard")
    # Every document goes to its class, and the class to its component.
    rep = keys.join(joined, keys.rep == joined.node, "left").select("set_key", F.coalesce("component", "rep").alias("root"))
    out = found.select("doc_id", "n", "set_key").join(rep, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
