"""Quality rules with thresholds learned from the corpus, in DataFrame functions only.

Shares of symbols, repeated lines and repeated words, and the mean word length, are gathered in
mergeable quantile sketches per language and source: counts of logarithmic cells a thousandth
wide, each with its least value. Counts merge alike in any order, so reruns agree, and a quantile is
exact where its cell holds one value, else less than a thousandth low. A document is an outlier of its group
if a share lies above the upper quartile by more than FENCE times the quartile distance plus a
least distance, or the mean word length lies as far on either side. Groups of fewer than
LEAST_ROWS documents take the merged sketch of their language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import skew
from engram.sources.workspace import written

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FENCE = 3.0
LEAST_ROWS = 30
#: Cells of a sketch per unit of the natural logarithm, and the cell of zero.
CELLS, ZERO = 1000, -1_000_000
#: Measures with the least distance from the quartile that counts as odd.
MEASURES = {"symbol_share": 0.1, "dup_line_share": 0.3, "repeat_share": 0.15, "mean_word": 3.0}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(hashes: Column) -> Column:
    """Words in windows of 8 that the text holds twice or more, from the hashes of its words."""
    def places(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"])))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(places(windows), covered))

    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, count))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = docs.select(
        "doc_id", "lang", "source",
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), repeated_words(h).alias("r"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )
    n = F.col("n_words")
    rows = rows.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.d").alias("n_dup_lines"), F.col("l.n").alias("n_lines"), F.col("w.r").alias("n_repeat_words"),
    )
    some = F.greatest(n, F.lit(1))
    return rows.withColumns({
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / some,
        "mean_word": F.col("word_chars") / some,
    })


def cells(rows: DataFrame) -> DataFrame:
    """(lang, source, m, cell, n, least): how many documents that pass the base rules fall into
    each cell of a measure. A group has as many rows as its values span cells, whatever its size."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in MEASURES])
    flat = rows.where("not base_failed").select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.m", "x.v")
    cell = F.when(F.col("v") > 0, F.floor(F.log("v") * CELLS)).otherwise(F.lit(ZERO)).alias("cell")
    return flat.groupBy("lang", "source", "m", cell).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))


def quartiles(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, low and high quartile of every measure) from cells; those of a key merge."""
    merged = cells.groupBy(*keys, "m", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    group = Window.partitionBy(*keys, "m")
    merged = merged.withColumns({"upto": F.sum("n").over(group.orderBy("cell")), "total": F.sum("n").over(group)})

    def quantile(m: str, share: float) -> Column:
        return F.min(F.when((F.col("m") == m) & (F.col("upto") >= share * F.col("total")), F.col("least")))

    columns = [quantile(m, q).alias(f"{m}_{name}") for m in MEASURES for q, name in ((0.25, "low"), (0.75, "high"))]
    return merged.groupBy(*keys).agg(F.max("total").alias("n"), *columns)


def bounds(rows: DataFrame) -> DataFrame:
    """(lang, source, low and high of every measure), from sketches of documents that pass the
    base rules."""
    sketches = written(cells(rows), "rules-cells")
    own = quartiles(sketches, "lang", "source")
    whole = quartiles(sketches, "lang")
    whole = whole.select(F.col("lang").alias("of"), *[F.col(c).alias(f"{c}_all") for c in whole.columns if c not in ("lang", "n")])
    own = own.join(whole, F.col("lang").eqNullSafe(F.col("of")))
    out = []
    for m, least in MEASURES.items():
        low, high = (F.when(F.col("n") >= LEAST_ROWS, F.col(f"{m}_{q}")).otherwise(F.col(f"{m}_{q}_all")) for q in ("low", "high"))
        reach = FENCE * (high - low) + least
        out += [(high + reach).alias(f"{m}_high"), (low - reach).alias(f"{m}_low")]
    return own.select(F.col("lang").alias("b_lang"), F.col("source").alias("b_source"), *out)


def judged(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) to their counts, base_failed and kept.

    kept is false if the base rules fail, else the verdict of the group's thresholds. Null lang
    and source are groups of their own; a group in which every document fails the base rules has
    no thresholds and needs none; repeated rows are judged alike; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = written(measured(docs), "rules-measures")
    limits = skew.broadcast_if_few(written(bounds(rows), "rules-bounds"), 100_000)
    same = F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
    odd = F.lit(False)
    for m in MEASURES:
        odd = odd | (F.col(m) > F.col(f"{m}_high"))
    odd = odd | (F.col("mean_word") < F.col("mean_word_low"))
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return rows.join(limits, same, "left").withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
