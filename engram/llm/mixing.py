"""Mixing sources to target weights, counted in words.

Every document gets a hash key. Within its source the keys are cut into ranges of about
RANGE_ROWS rows, which sorts the source in a distributed way: words are summed per range, the
sums are added up over the ranges of a source, and inside a range over its documents. Each
source is then cut at its exact budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators import skew
from engram.sources.workspace import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
RANGE_ROWS = 2_000
#: Keys are the first 60 bits of an MD5 of seed and id.
KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def mix_key(seed: str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Sources (source, total, rows) with their target added.

    Sources by code point, null last, take the weights in turn. A target is the smaller of
    `epochs` times its source and a common level times its weight; the level is what spends the
    whole budget, so it equals resharing the excess by weight until no target is above its
    bound. One row per source passes through one window: a mix names its sources, it does not
    have one per document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("bound", F.col("total") * float(epochs))
    everything = W.partitionBy()
    below = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("total").over(everything) * share
    rows = rows.withColumns({
        "budget": budget,
        "left": budget - F.coalesce(F.sum("bound").over(below), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
    })
    full = F.col("bound") * F.col("open") <= F.col("left") * F.col("weight")
    rows = rows.withColumn("full", full)
    level = F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("weight"), F.col("left") / F.col("open")))).over(everything)
    target = F.when(F.col("full"), F.col("bound")).otherwise(level["col2"] * F.col("weight"))
    return rows.withColumn("target", target).select("source", "total", "rows", "target")


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """Documents (doc_id, source, text) to doc_id, row_key, size, source_size, target, taken,
    copies: how often the mix takes the document, the last time perhaps in part.

    size is the number of words of the text (null: 0); taken counts words with repeats. The
    order in a source is that of a hash of seed and doc_id, ties by doc_id and text, so reruns
    agree; a null source is a source of its own, a null doc_id comes first among equal hashes,
    repeated rows are taken one by one. No document is taken more than `epochs` times. Other
    columns are ignored; an empty table gives an empty plan.
    """
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        mix_key(seed).alias("key"), F.xxhash64("doc_id", "source", "text").alias("row_key"),
    )
    sized = written(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows"))
    aims = written(targets(totals, weights, share, epochs), "mix-targets").withColumnsRenamed({"source": "s", "rows": "n"})
    few = skew.broadcast_if_few(aims, 100_000)
    ranges = F.greatest(F.ceil(F.col("n") / RANGE_ROWS), F.lit(1)).cast("long")
    half = KEY_BITS // 2
    place = F.shiftright(F.shiftright("key", half) * ranges, half)
    rows = sized.join(few, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", place)
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("words"))
    before = W.partitionBy("s").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("s").alias("of"), F.col("range").alias("at"), "before")
    inside = W.partitionBy("s", "range").orderBy("key", "doc_id", "row_key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, F.col("s").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    spent = F.floor("target").cast("long")
    whole = F.when(F.col("total") > 0, F.expr("cast(floor(target) as long) div total")).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), spent - F.col("whole") * F.col("total") - F.col("ahead")))
    rows = rows.withColumn("ahead", ahead).withColumn("whole", whole).withColumn("part", rest)
    return rows.select(
        "doc_id", "row_key", "size", F.col("total").alias("source_size"), "target",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("long")).otherwise(0).cast("long").alias("copies"),
        "part",
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of a mix with all their columns and two more: one row per copy, `copy`
    (from 1) and `words`, the number of words it counts for. The copy that the budget of its
    source cuts through holds only these first words, joined by single spaces. Columns named
    copy or words are replaced. Rows equal in id, source and text are planned one by one."""
    plan = planned(docs, **how).where("copies > 0")
    plan = plan.groupBy("row_key").agg(F.collect_list(F.struct("copies", "part", "size")).alias("__plans"))
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "source", "text"))
    distinct = rows.join(plan.withColumnRenamed("row_key", "__row"), "__row").dropDuplicates(["__row"])
    each = distinct.withColumn("__plan", F.explode("__plans"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__plan.copies"))))
    cut = (F.col("copy") == F.col("__plan.copies")) & F.col("__plan.part").between(1, F.col("__plan.size") - 1)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("__plan.part").cast("int")), " ")
    return each.withColumns({
        "words": F.when(cut, F.col("__plan.part")).otherwise(F.col("__plan.size")),
        "text": F.when(cut, head).otherwise(F.col("text")),
    }).drop("__row", "__plan", "__plans")
