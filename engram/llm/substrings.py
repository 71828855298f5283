"""Substring dedup: words covered by a window that an earlier document holds as well.

A difference cover of a period is a set of residues such that any two places have a shift,
smaller than the period, that brings both onto the cover. So two equal stretches of
WINDOW words hold an equal anchor of WINDOW - PERIOD + 1 words at cover places of both texts,
and it is enough to hash anchors at cover places (3 of 7).

1. A census finds the anchors that several documents hold.
2. Windows around a shared anchor are extended to their full length and hashed; for each hash
   the lowest doc_id is found.
3. Windows whose lowest doc_id is not their own are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import census, words

PERIOD = 7
COVER = (0, 1, 3)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text for one word on a cover place, roughly; sizes the ranges of a census.
BYTES_PER_ANCHOR = 14

#: Text of one bucket of documents, roughly.
BUCKET_BYTES = 8 << 20

BLOCK = "bucket int, ids binary, sizes binary, texts binary"
BLOCK_TYPES = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("ids", "sizes", "texts")])
KEPT = "doc_id long, text string, n_words long, n_removed long"
KEPT_TYPES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
OWNERS = "part int, hash binary, doc binary, ready binary, ready_doc binary"
OWNER_TYPES = pa.schema([("part", pa.int32())] + [(n, pa.binary()) for n in ("hash", "doc", "ready", "ready_doc")])


def anchors(found: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors at cover places: their first words, texts and hashes."""
    hashes = words.windows(found.hash, ANCHOR)
    row = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))[: len(hashes)]
    place = (np.arange(len(hashes)) - found.first[row]) % PERIOD
    at = np.flatnonzero(np.isin(place, COVER) & words.whole(found.first, ANCHOR))
    return at, row[at], hashes[at]


def anchor_cells(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    hashed = words.hasher(lower=False)
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(words.sliced(batches, 1, 16 << 20)):
        _, row, hashes = anchors(hashed(batch.column(1)))
        yield from census.cells(batch.column(0).to_numpy(), row, hashes, parts, task * 1009 + i)


def packed_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to compressed blocks of texts by bucket of the id: texts cross the network
    twice, and pack far better together."""
    for batch in words.sliced(batches, 1, 16 << 20):
        ids = batch.column(0).to_numpy()
        data, at = words.text_bytes(batch.column(1))
        raw, bucket = memoryview(data), census.bucket_of(ids, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        rows = []
        for a, b in zip(cut, cut[1:]):
            own = order[a:b]
            texts = b"".join(raw[at[i] : at[i + 1]] for i in own)
            rows.append((int(bucket[own[0]]), ids[own].tobytes(), (at[own + 1] - at[own]).tobytes(), pa.compress(texts, "zstd", asbytes=True) if texts else b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), BLOCK_TYPES)], schema=BLOCK_TYPES)


def unpacked_rows(blocks: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The ids and texts of blocks, about 16 MB of text at a time."""
    ids, sizes, texts, held = [], [], [], 0
    for block in blocks.to_pylist():
        ids.append(np.frombuffer(block["ids"], np.int64))
        sizes.append(np.frombuffer(block["sizes"], np.int64))
        total = int(sizes[-1].sum())
        texts.append(pa.decompress(block["texts"], total, "zstd", asbytes=True) if total else b"")
        held += total
        if held > 16 << 20:
            yield np.concatenate(ids), joined(sizes, texts)
            ids, sizes, texts, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), joined(sizes, texts)


def joined(sizes: list[np.ndarray], texts: list[bytes]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(b"".join(texts)))


def window_cells(blocks: pa.Table, shared: pa.Table, parts: int) -> pa.Table:
    """Texts and their shared anchors to hashes of the windows around them, with the lowest
    doc_id of the block; windows that a lower doc_id of the block holds are settled here."""
    hashed = words.hasher(lower=False)
    known, out = census.by_key(shared), []
    spread = blocks["bucket"][0].as_py() if blocks.num_rows else 0
    for ids, texts in unpacked_rows(blocks) if known else ():
        found = hashed(texts)
        at, row, hashes = anchors(found)
        hit = np.zeros(len(at), bool)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        for k, doc in enumerate(ids.tolist()):
            if doc in known:
                hit[cut[k] : cut[k + 1]] = np.isin(hashes[cut[k] : cut[k + 1]] & census.KEPT_BITS, known[doc])
        near = np.zeros(len(found.hash) + PERIOD, np.int64)
        near[at[hit]] = 1
        near = np.concatenate([[0], np.cumsum(near)])
        full = words.whole(found.first, WINDOW)
        start = np.arange(len(full))
        start = start[full & (near[start + PERIOD] > near[start])]
        hashes = words.windows(found.hash, WINDOW)[start]
        out += owner_cells(hashes, ids[np.searchsorted(found.first, start, "right") - 1], parts, spread)
    return pa.Table.from_batches(out, OWNER_TYPES)


def owner_cells(hashes: np.ndarray, doc: np.ndarray, parts: int, spread: int) -> Iterator[pa.RecordBatch]:
    if not len(hashes):
        return
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    lowest = np.repeat(doc[start], np.diff(np.append(start, len(doc))))
    later = doc > lowest
    part = census.part_of(hashes[start], parts)
    rows = [
        (p, census.pack(hashes[start][part == p], True), census.pack(doc[start][part == p]), None, None)
        for p in np.unique(part).astype(np.int64).tolist()
    ]
    if later.any():
        rows.append((spread * 7919 % parts, None, None, hashes[later].tobytes(), doc[later].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), OWNER_TYPES)], schema=OWNER_TYPES)


def owned(table: pa.Table, buckets: int) -> pa.Table:
    """Documents of one range with the windows that a lower doc_id holds."""
    hashes, _ = census.unpack(table["hash"], ascending=True)
    doc, _ = census.unpack(table["doc"], np.int64)
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    later = doc > np.repeat(doc[start], np.diff(np.append(start, len(doc))))
    doc = np.concatenate([doc[later], words.unpacked(table["ready_doc"], np.int64)[0]])
    hashes = np.concatenate([hashes[later], words.unpacked(table["ready"])[0]])
    return census.answer_rows(doc, hashes, buckets)


def kept_words(ids: list, texts: pa.Array, gone: dict, hashed) -> pa.RecordBatch:
    """What is left of texts without the windows `gone` of each id."""
    found = hashed(texts)
    grams = words.windows(found.hash, WINDOW)
    raw, kept, removed = memoryview(found.data), [], []
    for k, doc in enumerate(ids):
        parts = bytes(raw[found.row_start[k] : found.row_start[k + 1]]).split()
        covered = 0
        if doc in gone:
            a, n = int(found.first[k]), len(parts)
            hit = np.flatnonzero(np.isin(grams[a : a + max(0, n - WINDOW + 1)], gone[doc]))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            drop = np.cumsum(edge[:n]) > 0
            covered = int(drop.sum())
            parts = [w for w, d in zip(parts, drop.tolist()) if not d]
        kept.append(b" ".join(parts))
        removed.append(covered)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(found.first), pa.int64()), pa.array(removed, pa.int64())],
        schema=KEPT_TYPES,
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents with a `doc_id` and a `text` to doc_id, text, n_words, n_removed.

    Words are kept unchanged and joined by one space; a word goes if a window of 13 consecutive
    words covers it that also starts in a document with a smaller doc_id. All windows are judged
    on the input. A null text has no words. A row without doc_id keeps its words and removes
    none elsewhere; rows with one doc_id never remove each other's words, since neither id is
    smaller. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = docs.where("doc_id is not null")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = census.parts_for(size // BYTES_PER_ANCHOR)
    buckets = max(1, -(-size // BUCKET_BYTES))
    cells = usable.mapInArrow(lambda rows: anchor_cells(rows, parts), census.CELL)
    shared = census.answers(cells, buckets)
    blocks = usable.mapInArrow(lambda rows: packed_rows(rows, buckets), BLOCK)
    cells = blocks.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        lambda rows, known: window_cells(rows, known, parts), OWNERS
    )
    later = cells.groupBy("part").applyInArrow(lambda rows: owned(rows, buckets), census.ANSWER)

    def judged(rows: pa.Table, found: pa.Table) -> pa.Table:
        hashed, gone = words.hasher(lower=False), census.by_key(found)
        out = [kept_words(ids.tolist(), texts, gone, hashed) for ids, texts in unpacked_rows(rows)]
        return pa.Table.from_batches(out, KEPT_TYPES)

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = words.hasher(lower=False)
        for batch in words.sliced(batches, 1):
            yield kept_words(batch.column(0).to_pylist(), batch.column(1), {}, hashed)

    named = blocks.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(judged, KEPT)
    return named.unionByName(docs.where("doc_id is null").mapInArrow(unnamed, KEPT))
