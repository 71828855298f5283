"""Spelling variants: words one edit apart, found by edit-matrix rows over sorted word lists.

1. Words are counted over whole texts by DataFrame functions.
2. Words one edit apart agree in all but one place of the longer one. So they agree outside the
   first or outside the second half of its places: each word stands in the lists of words that
   share what is outside of such a window, once with itself as the longer one and once as the
   shorter. A list of more than MOST words is cut into lists of half the window, down to windows
   of one place, which bounds every list.
3. A list is sorted, and its words are walked by common beginnings: the three middle cells of the
   edit matrix's row (the band within one edit) are worked out once for each distinct beginning,
   taken over by all words that share it, and a beginning whose cells are all above one edit ends
   the walk for its whole range of words. All words of a task walk together, level by level.
4. A pair is reported in the one window that holds its first differing place. Each word takes the
   most frequent of its near words as its form, if it is ten times as frequent, and forms are
   followed to their last by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.skew import broadcast_if_few
from engram.sources.workspace import written

#: Words of at least so many code points that occur at least so often.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent.
TIMES = 10
#: A run whose checksum this divides loses a code point.
SLIP = 31
#: Most words of a list.
MOST = 20_000
#: Rows of lists that a task works on at once, and words that walk together.
ROWS, WALKERS = 200_000, 16_384

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, best_n long, best string"
#: A cell above one edit.
FAR = 2


class Lists(NamedTuple):
    """Sorted lists of words, one after the other: for every row the code points that follow the
    beginning its list shares, what they start at and how many they are, the leading code points
    it shares with the row before (-1 at the start of a list), and its list's first and last row
    (and one), longer length and window."""

    codes: np.ndarray
    at: np.ndarray
    size: np.ndarray
    shared: np.ndarray
    first: np.ndarray
    end: np.ndarray
    longer: np.ndarray
    window: np.ndarray


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    # A run that is shorter than a word may be cannot become one, so only longer ones are taken.
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_CHARS},}}"), 0)).alias("run")
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.select("run", F.crc32(named.cast("binary")).alias("h"))
    cut = F.overlay("run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))
    found = runs.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = found.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _window(start: Column, width: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), width.cast("int").alias("width"))


def halves(rows: DataFrame, start: Column, width: Column) -> DataFrame:
    """Rows (word, n, longer) with the lists of the two halves of a window."""
    half = F.ceil(width / 2)
    rows = rows.withColumn("window", F.explode(F.array(_window(start, half), _window(start + half, width - half))))
    rows = rows.select("word", "n", "longer", "window.start", "window.width").where("width > 0")
    after = F.col("longer") - F.col("start") - F.col("width")
    key = F.xxhash64("longer", "start", "width", F.left("word", F.col("start")), F.right("word", after))
    return rows.withColumn("key", key)


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for (word, n): for every word that has near words, how many
    they are and the most frequent of them."""
    sized = vocab.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    rows, found = halves(sized, F.lit(0), F.col("longer")), None
    while True:
        rows = written(rows, "variants-lists")
        crowded = rows.where("width > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST)
        crowded = broadcast_if_few(written(crowded.select("key"), "variants-crowded"))
        calm = rows.join(crowded, "key", "left_anti")
        lists = calm.repartition("key").sortWithinPartitions("key", "word")
        mine = lists.select("key", "word", "n", "longer", "start", "width").mapInArrow(walked, NEAR)
        found = mine if found is None else found.unionByName(mine)
        rows = rows.join(crowded, "key", "left_semi")
        if rows.isEmpty():
            break
        rows = halves(rows.drop("key"), F.col("start"), F.col("width"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n, longer, start, width) by key and word to near words of each row."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def run(table: pa.Table) -> pa.RecordBatch:
        lists = lists_of(table)
        a, b = near_pairs(lists)
        n, word = table["n"].to_numpy(), table["word"].combine_chunks()
        # Best first: the largest count, then the first word in code-point order.
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        top = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
        counts = np.diff(np.append(top, len(a)))
        return pa.RecordBatch.from_arrays(
            [word.take(pa.array(a[top])), pa.array(counts), pa.array(n[b[top]]), word.take(pa.array(b[top]))],
            names=["word", "n_near", "best_n", "best"],
        )

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            # The last list may go on in the next batch.
            whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if whole:
                yield run(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
    if rows:
        yield run(pa.Table.from_batches(held))


def lists_of(table: pa.Table) -> Lists:
    key, word = table["key"].to_numpy(), table["word"].combine_chunks()
    start = table["start"].to_numpy().astype(np.int64)
    length = pc.utf8_length(word).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), np.uint32)
    at, size = np.cumsum(length) - length + start, length - start
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    ends = np.append(np.flatnonzero(new)[1:], len(key))
    shared = np.where(new, -1, 0)
    same, depth = np.flatnonzero(~new), 0
    while len(same):
        same = same[(size[same] > depth) & (size[same - 1] > depth)]
        same = same[codes[at[same] + depth] == codes[at[same - 1] + depth]]
        depth += 1
        shared[same] = depth
    return Lists(
        codes, at, size, shared, first, ends[np.cumsum(new) - 1], table["longer"].to_numpy() - start,
        table["width"].to_numpy().astype(np.int64),
    )


def near_pairs(lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a list that are one edit apart and belong to its window, both ways."""
    codes, at, size = np.append(lists.codes, 0), lists.at, lists.size
    out_a, out_b = [], []

    def letter(row: np.ndarray, place: int) -> np.ndarray:
        """The letter at a place of each row; 0 outside of it."""
        inside = size[row] > place
        return np.where(inside, codes[np.where(inside, at[row] + place, 0)], 0) if place >= 0 else np.zeros(len(row), np.uint32)

    several = np.flatnonzero(lists.end - lists.first > 1)
    deepest = int(size.max(initial=0))
    starts = [np.flatnonzero((lists.shared <= d) & (size > d)) for d in range(deepest + 1)] if deepest < 64 else None
    for a in range(0, len(several), WALKERS):
        # Each walker stands at a beginning (the rows from `low` up to `high`) with three cells of
        # its row: one letter of its own less than the beginning has, as many, one more.
        me = several[a : a + WALKERS]
        low, high = lists.first[me], lists.end[me]
        less, even, more = np.full(len(me), FAR, np.int8), np.zeros(len(me), np.int8), np.ones(len(me), np.int8)
        parted = np.full(len(me), -1)
        depth = 0
        while len(me):
            ends = np.flatnonzero(size[low] == depth)
            if len(ends):
                x, gap = me[ends], size[me[ends]] - depth
                cost = np.where(gap == 0, even[ends], np.where(gap == 1, more[ends], np.where(gap == -1, less[ends], FAR)))
                split = np.where(parted[ends] < 0, np.minimum(size[x], depth), parted[ends])
                ok = (cost == 1) & (np.maximum(size[x], depth) == lists.longer[x]) & (split < lists.window[x])
                out_a.append(x[ok])
                out_b.append(low[ends[ok]])
            begin = starts[depth] if starts is not None else np.flatnonzero((lists.shared <= depth) & (size > depth))
            from_, upto = np.searchsorted(begin, low), np.searchsorted(begin, high)
            count = upto - from_
            who = np.repeat(np.arange(len(me)), count)
            child = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + from_[who]
            low = begin[child]
            after = np.append(begin, len(size))[child + 1]
            high = np.where(child + 1 < upto[who], after, high[who])
            me, less, even, more, parted = me[who], less[who], even[who], more[who], parted[who]
            here = codes[at[low] + depth]
            left = size[me] - depth  # own letters from this place on
            new_less = np.minimum(even + 1, less + (letter(me, depth - 1) != here))
            differs = letter(me, depth) != here
            new_even = np.minimum(np.minimum(more, new_less) + 1, even + differs)
            new_even = np.where(left < 1, FAR, new_even)
            new_more = np.where(left < 2, FAR, np.minimum(new_even + 1, more + (letter(me, depth + 1) != here)))
            new_less = np.where(left < 0, FAR, new_less)
            parted = np.where((parted < 0) & differs, depth, parted)
            # Beyond its window, a pair without a difference so far belongs to another list.
            keep = np.minimum(np.minimum(new_less, new_even), new_more) < FAR
            keep &= np.where(parted < 0, depth + 1, parted) < lists.window[me]
            me, low, high, parted = me[keep], low[keep], high[keep], parted[keep]
            less, even, more = (x[keep].astype(np.int8) for x in (new_less, new_even, new_more))
            depth += 1
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def with_roots(words: DataFrame, most: int) -> DataFrame:
    """Add the root of each word (word, form, ...), the last form that its forms lead to.

    A form is TIMES as frequent as its word, so forms lead on for at most log(most / LEAST_COUNT)
    steps; each round doubles the steps taken."""
    steps, n = 0, LEAST_COUNT
    while n * TIMES <= most:
        steps, n = steps + 1, n * TIMES
    links = words.where("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        links = written(links, "variants-roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        done *= 2
    return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `text`, documents with a `doc_id`.

    Words come from the maximal runs of letters (A-Z folded), of which one in SLIP loses a code
    point as its checksum with the doc_id says; they have LEAST_CHARS code points and LEAST_COUNT
    occurrences at least. n_near counts the words one insertion, deletion or replacement away;
    form is the most frequent of them (the first in code-point order of equals) if TIMES as
    frequent as the word; root is where the forms lead in the end. Repeated rows count each time; a
    null text has no words and a null doc_id counts as an empty one. Other columns are not read.
    An empty table, or one without such words, gives an empty result.
    """
    vocab = written(vocabulary(docs.select("doc_id", "text")), "variants-words")
    most = vocab.agg(F.max("n")).first()[0] or 0
    near = near_words(vocab)
    frequent = F.col("best_n") >= TIMES * F.col("n")
    words = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"),
    )
    return with_roots(written(words, "variants-forms"), most).select("word", "form", "root", "n", "n_near", "form_n")
