"""Exact links inside groups of any size, as a signature tree walked level by level.

The nodes of the tree are, from the top: the size bands of a group, the blocks of a band, and
inside a task the leaves of a block. Every node holds the size range of its members, the OR of
their token bitmaps, and the most tokens that any member hides behind a bit it already has.
Two nodes are compared only if the largest overlap these allow can make a link, so the walk
descends in pairs and a pair of blocks becomes one task, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.components import components
from engram.sources.workspace import written

#: Members of a block; a task compares two blocks.
BLOCK = 512
#: Rows of several small tasks that are handed over together, on average.
CHUNK_ROWS = 4096
BITS = 1024
LANES = [f"bits{i}" for i in range(BITS // 64)]


def fits(ratio: float) -> Column:
    """Whether members of nodes l and r can reach a similarity of `ratio`: sizes first, then
    the most tokens they can have in common."""
    sizes = (F.col("l.most") >= ratio * F.col("r.least")) & (F.col("r.most") >= ratio * F.col("l.least"))
    common = sum((F.bit_count(F.col(f"l.{b}").bitwiseAND(F.col(f"r.{b}"))) for b in LANES), F.lit(0))
    overlap = F.least(F.col("l.hidden"), F.col("r.hidden")) + common
    need = (F.col("l.least") + F.col("r.least")) * (ratio / (1 + ratio))
    return sizes & (overlap + 1e-6 >= need)


def node(members: DataFrame, *keys: str) -> DataFrame:
    """Tree nodes over members or lower nodes."""
    return members.groupBy(*keys).agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.max("hidden").alias("hidden"),
        *[F.bit_or(b).alias(b) for b in LANES],
    )


def linked(members: DataFrame, ratio: float, compare: Callable, name: str) -> DataFrame:
    """Components of the links inside groups: rows (node, component) for linked nodes only.

    members: group long, node long, size long, bits0..bits15 long, and what `compare` reads.
    compare(table, table or None) gets one block, or two blocks of a group, as Arrow tables and
    returns two lists of nodes, whose pairs must join exactly what the blocks' links join.
    A link needs sizes whose quotient is at least `ratio`.
    """
    carried = [c for c in members.columns if c not in LANES]
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1 / ratio))).cast("int")
    placed = members.withColumn("band", band)
    counts = placed.groupBy("group", "band").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = placed.join(counts, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = written(
        placed.withColumns({"least": F.col("size"), "most": F.col("size"),
                            "hidden": F.col("size") - sum((F.bit_count(b) for b in LANES), F.lit(0))}),
        f"{name}-members",
    )
    counted = placed.groupBy("group", "band", "block").agg(F.count(F.lit(1)).alias("rows"))
    leaves = written(node(placed, "group", "band", "block").join(counted, ["group", "band", "block"]), f"{name}-nodes")
    tops = node(leaves, "group", "band")
    l, r = tops.alias("l"), tops.alias("r")
    near = F.col("r.band") - F.col("l.band")
    pairs = l.join(r, F.col("l.group") == F.col("r.group")).where(near.between(0, 1) & fits(ratio))
    pairs = pairs.select(F.col("l.group").alias("group"), F.col("l.band").alias("lb"), F.col("r.band").alias("rb"))
    l, r, p = leaves.alias("l"), leaves.alias("r"), pairs.alias("p")
    pairs = (
        p.join(l, (F.col("p.group") == F.col("l.group")) & (F.col("p.lb") == F.col("l.band")))
        .join(r, (F.col("p.group") == F.col("r.group")) & (F.col("p.rb") == F.col("r.band")))
        .where(((F.col("l.band") < F.col("r.band")) | (F.col("l.block") <= F.col("r.block"))) & fits(ratio))
    )
    work = written(
        pairs.select(
            F.col("p.group").alias("group"), F.struct("l.band", "l.block").alias("left"),
            F.struct("r.band", "r.block").alias("right"), (F.col("l.rows") + F.col("r.rows")).alias("rows"),
        ),
        f"{name}-pairs",
    )
    chunks = max(1, (work.agg(F.sum("rows")).first()[0] or 0) // CHUNK_ROWS)
    sides = F.array_distinct(F.array("left", "right"))
    work = work.select("group", "left", "right", F.explode(sides).alias("side"))
    work = work.select(
        "group", F.col("side.band").alias("band"), F.col("side.block").alias("block"),
        F.xxhash64("group", "left", "right").alias("task"), (F.col("side") == F.col("left")).alias("is_left"),
    )
    dealt = work.join(placed.select(*carried, "band", "block"), ["group", "band", "block"])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("task", "ascending"), ("is_left", "descending")])
        task, is_left = table["task"].to_numpy(), table["is_left"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
        out_a, out_b = [], []
        for start, end in zip(cut.tolist(), cut[1:].tolist()):
            middle = start + int(is_left[start:end].sum())
            if end - start > 1:
                a, b = compare(table.slice(start, middle - start), table.slice(middle, end - middle) if middle < end else None)
                out_a.extend(a)
                out_b.extend(b)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    dealt = dealt.withColumn("chunk", F.pmod("task", F.lit(chunks)))
    found = dealt.groupBy("chunk").applyInArrow(run, "a long, b long")
    return components(found, f"{name}-links")
