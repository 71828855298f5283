"""Which tokens of a document occur in other documents too, without a row per token.

Each task sorts the tokens of a batch of documents and deals them by hash range as packed
arrays. A token met in two documents of one batch is known to be shared at once and travels
once per batch, without documents; so however many documents hold a token, its range gets one
entry per batch. The range answers to the documents whose tokens another batch holds as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.words import mix, unpacked

#: Tokens that one range holds, on average.
RANGE_TOKENS = 3_000_000

#: Tokens are compared by their first 48 bits, so that sorted ones pack well. A chance match
#: only makes a token look shared: what is asked of a census must bear that.
KEPT_BITS = np.uint64(0xFFFFFFFFFFFF0000)

CELL = "part int, keys binary, docs binary, single binary, multi binary, known binary"
CELL_TYPES = pa.schema(
    [("part", pa.int32())] + [(n, pa.binary()) for n in ("keys", "docs", "single", "multi", "known")]
)
#: Answers travel by bucket of the document, packed: distinct keys, tokens of each, tokens.
ANSWER = "bucket int, keys binary, counts binary, tokens binary"
ANSWER_TYPES = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("keys", "counts", "tokens")])


def parts_for(tokens: int) -> int:
    return max(1, -(-int(tokens or 0) // RANGE_TOKENS))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers by byte planes, ascending ones as differences: equal bytes come together, which
    the shuffle's compression then removes."""
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unpack(cells: pa.Array, kind: type = np.uint64, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Items of all cells written by `pack`, and the number in each."""
    wide = np.dtype(kind).itemsize
    out = [np.ascontiguousarray(np.frombuffer(c or b"", np.uint8).reshape(wide, -1).T).reshape(-1).view(kind) for c in cells.to_pylist()]
    counts = np.array([len(x) for x in out], np.int64)
    if ascending:
        out = [np.cumsum(x, dtype=kind) for x in out]
    return (np.concatenate(out) if out else np.zeros(0, kind)), counts


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The range of each token: equal stretches of the hash space."""
    return ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def cells(keys: np.ndarray, docs: np.ndarray, tokens: np.ndarray, parts: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Packed rows for the ranges. tokens[i] belongs to the document keys[docs[i]]; a document
    may repeat a token. `spread` varies between batches and deals out the ready answers."""
    tokens = tokens & KEPT_BITS
    order = np.argsort(tokens)
    tokens, docs = tokens[order], docs[order]
    head = np.ones(len(tokens), bool)
    head[1:] = tokens[1:] != tokens[:-1]
    start = np.flatnonzero(head)
    if not len(start):
        return
    owner = np.minimum.reduceat(docs, start)
    alone = owner == np.maximum.reduceat(docs, start)
    each = np.repeat(alone, np.diff(np.append(start, len(tokens))))
    distinct = tokens[start]
    single, owner, multi = distinct[alone], owner[alone], distinct[~alone]
    part_s, part_m = part_of(single, parts), part_of(multi, parts)
    rows = []
    for p in np.unique(part_of(distinct, parts)).astype(np.int64).tolist():
        a, b = np.searchsorted(part_s, [p, p + 1])
        c, d = np.searchsorted(part_m, [p, p + 1])
        held, local = np.unique(owner[a:b], return_inverse=True)
        rows.append((p, keys[held].tobytes(), pack(local.astype(np.uint32)), pack(single[a:b], True), pack(multi[c:d], True), None))
    ready, of = tokens[~each], docs[~each]
    if len(ready):
        rows.append(((spread * 7919) % parts, keys[of].tobytes(), None, None, None, ready.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), CELL_TYPES)], schema=CELL_TYPES)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def answer_rows(keys: np.ndarray, tokens: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket for (key, token) pairs."""
    bucket = bucket_of(keys, buckets)
    order = np.lexsort((keys, bucket))
    keys, tokens, bucket = keys[order], tokens[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    rows = []
    for a, b in zip(cut, cut[1:]):
        distinct, counts = np.unique(keys[a:b], return_counts=True)
        rows.append((int(bucket[a]), pack(distinct, True), pack(counts.astype(np.uint32)), pack(tokens[a:b])))
    columns = zip(*rows) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ANSWER_TYPES)], schema=ANSWER_TYPES)


def by_key(rows: pa.Table) -> dict[int, np.ndarray]:
    """The tokens of each document in the answers of a bucket."""
    keys, _ = unpack(rows["keys"], np.int64, True)
    counts, _ = unpack(rows["counts"], np.uint32)
    tokens, _ = unpack(rows["tokens"])
    of = np.repeat(keys, counts)
    order = np.argsort(of, kind="stable")
    of, tokens = of[order], tokens[order]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
    return {int(of[a]): tokens[a:b] for a, b in zip(cut, cut[1:])}


def answered(table: pa.Table, buckets: int) -> pa.Table:
    """What one range knows: documents, each with its tokens that are shared."""
    ready = table.filter(pa.compute.is_valid(table["known"]))
    table = table.filter(pa.compute.is_null(table["known"]))
    held, n_held = unpacked(table["keys"], np.int64)
    local, n_local = unpack(table["docs"], np.uint32)
    single, _ = unpack(table["single"], ascending=True)
    multi, _ = unpack(table["multi"], ascending=True)
    base = np.repeat(np.cumsum(n_held) - n_held, n_local)
    owner = held[base + local] if len(local) else np.zeros(0, np.int64)
    order = np.argsort(single, kind="stable")
    single, owner = single[order], owner[order]
    shared = np.zeros(len(single), bool)
    if len(single):
        same = single[1:] == single[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        if len(multi):
            multi = np.unique(multi)
            at = np.minimum(np.searchsorted(multi, single), len(multi) - 1)
            shared |= multi[at] == single
    keys = np.concatenate([owner[shared], unpacked(ready["keys"], np.int64)[0]])
    tokens = np.concatenate([single[shared], unpacked(ready["known"])[0]])
    return answer_rows(keys, tokens, buckets)


def answers(frame: DataFrame, buckets: int) -> DataFrame:
    """Cells to the shared tokens of documents, a row per range and bucket at most."""
    return frame.groupBy("part").applyInArrow(lambda table: answered(table, buckets), ANSWER)
