"""Benchmark decontamination: SimHash windows of the size of an item, looked up by Hamming
blocks and verified by weighted shingles.

Words are lower-cased letters and digits; shingles are five words (items with fewer words are
one shingle of their size). A window has as many words as the item, a text with fewer words is one
window, and both weigh a shingle by how often they hold it. Similarity is the sum of smaller weights over the sum of larger ones.

Only windows that hold enough shingles of an item in place are fingerprinted: a window of V and an
item of W shingles with similarity t share t / (1 + t) * (V + W) of them, so the others cannot
pass. Fingerprints meet through BLOCKS blocks of bits, one of which is equal for any two at most
BLOCKS - 1 bits apart; similar windows (0.8) differ by about 10 of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import words

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints up to BLOCKS - 1 bits apart are compared, for certain.
BLOCKS = 24
RADIUS = BLOCKS - 1
#: Words of the items that one pass over the documents looks for; bounds what tasks are sent.
PASS_WORDS = 2_000_000
FILTER = 1 << 20

CUT = np.linspace(0, 64, BLOCKS + 1).astype(int)
MASKS = [np.uint64(sum(1 << b for b in range(a, z))) for a, z in zip(CUT, CUT[1:])]
HITS = "doc_id long, item_id long, start_word long, n_words long, similarity double"


class Items(NamedTuple):
    """The items whose shingles have one size: ids, words, shingles, fingerprints, postings by
    shingle, and by (words, block, value) the items with that value in that block."""

    size: int
    ids: list[int]
    n_words: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    known: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    blocks: dict
    filter: np.ndarray


def fingerprint(shingles: np.ndarray) -> np.uint64:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).view(np.uint64)[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle sequences."""
    both = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    x = np.bincount(both[: len(a)], minlength=both.max() + 1)
    y = np.bincount(both[len(a) :], minlength=both.max() + 1)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def index(ids: list[int], texts: list[str]) -> list[Items]:
    found = words.hasher(words.NOT_ALNUM)(pa.array(texts, pa.string()))
    count = np.diff(found.first)
    out = []
    for size in sorted({min(SHINGLE, int(n)) for n in count if n}):
        rows = [r for r in range(len(ids)) if count[r] and min(SHINGLE, count[r]) == size]
        shingles = [words.windows(found.hash[found.of(r)], size) for r in rows]
        flat = np.concatenate(shingles)
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in shingles])
        pairs = np.unique(np.column_stack([flat, owner.astype(np.uint64)]), axis=0)
        known, first = np.unique(pairs[:, 0], return_index=True)
        prints = np.array([fingerprint(s) for s in shingles], np.uint64)
        blocks: dict = {}
        for k, r in enumerate(rows):
            for b, mask in enumerate(MASKS):
                blocks.setdefault((int(count[r]), b, int(prints[k] & mask)), []).append(k)
        seen = np.zeros(FILTER, bool)
        seen[known % np.uint64(FILTER)] = True
        out.append(Items(size, [ids[r] for r in rows], count[rows], shingles, prints, known,
                         np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), blocks, seen))
    return out


def passes(benchmark: DataFrame) -> Iterator[list[Items]]:
    """The benchmark in blocks of bounded size, one for each pass over the documents."""
    ids, texts, total = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    for item, text in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(item)
        texts.append(text)
        total += len(text) // 4 + 1
        if total >= PASS_WORDS:
            yield index(ids, texts)
            ids, texts, total = [], [], 0
    if ids:
        yield index(ids, texts)


def starts(places: np.ndarray, width: int, need: int, last: int) -> np.ndarray:
    """First shingles of the windows of `width` shingles, up to `last`, with `need` places."""
    at = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < width)
    low, high = np.maximum(places[at + need - 1] - width + 1, 0), np.minimum(places[at], last)
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])) if len(at) else at


def search(column: pa.Array, indexes: list[Items], hashed) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity): for each text the best window of each item
    that it holds, the first of equal ones."""
    found = hashed(column)
    for items in indexes:
        grams = words.windows(found.hash, items.size)
        hit = np.flatnonzero(items.filter[grams % np.uint64(FILTER)] & words.whole(found.first, items.size))
        slot = np.minimum(np.searchsorted(items.known, grams[hit]), len(items.known) - 1)
        true = items.known[slot] == grams[hit]
        hit, slot = hit[true], slot[true]
        count = items.first[slot + 1] - items.first[slot]
        place = np.repeat(hit, count)
        offset = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        item = items.holders[np.repeat(items.first[slot], count) + offset]
        row = np.searchsorted(found.first, place, "right") - 1
        order = np.lexsort((place, item, row))
        row, item, place = row[order], item[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else []
        best: dict = {}
        for a, b in zip(new, np.append(new, len(row))[1:]):
            r, words_in = int(row[a]), int(items.n_words[item[a]])
            begin, stop = int(found.first[r]), int(found.first[r + 1])
            # A text with fewer words than the item is one window.
            width = min(words_in, stop - begin) - items.size + 1
            share = SIMILARITY / (1 + SIMILARITY) * (width + words_in - items.size + 1)
            need = int(np.ceil(share - 1e-9))
            if b - a < need:
                continue
            last = max(0, stop - begin - words_in)
            for s in starts(place[a:b] - begin, width, need, last).tolist():
                window = grams[begin + s : begin + s + width]
                mark = fingerprint(window)
                met = {k for n, mask in enumerate(MASKS) for k in items.blocks.get((words_in, n, int(mark & mask)), ())}
                for k in met:
                    if np.bitwise_count(items.prints[k] ^ mark) <= RADIUS:
                        score = similarity(window, items.shingles[k])
                        key = (r, items.ids[k])
                        if score >= SIMILARITY and (key not in best or (-score, s) < best[key][:2]):
                            best[key] = (-score, s, width + items.size - 1)
        for (r, item_id), (score, s, n) in sorted(best.items()):
            yield r, item_id, s, n, -score


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity): the benchmark items that a
    document (doc_id, text) holds with a similarity of 0.8 or more, each at its best window.

    Null and empty texts and items hold nothing; items with a null id are left out; repeated
    documents repeat their rows; an item id with several texts can give several rows. Other
    columns are ignored; empty tables give an empty result.
    """
    words.bounded_batches(docs.sparkSession)
    out = None
    for block in passes(benchmark):

        def run(batches, block=block):
            hashed = words.hasher(words.NOT_ALNUM)
            for batch in words.sliced(batches, 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], *rest) for r, *rest in search(batch.column(1), block, hashed)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, null ids included."""
    words.bounded_batches(docs.sparkSession)
    for block in passes(benchmark):

        def clean(text, block=block):
            hashed = words.hasher(words.NOT_ALNUM)
            keep = np.ones(len(text), bool)
            column = pa.array(text, pa.string(), from_pandas=True)
            for a, b in words.slices(column):
                for r, *_ in search(column.slice(a, b - a), block, hashed):
                    keep[a + r] = False
            return pd.Series(keep)

        docs = docs.where(F.pandas_udf(clean, T.BooleanType())("text"))
    return docs
