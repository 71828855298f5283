"""Many queries at once: exact scores of found candidates, lists told pair by pair, shared vectors."""

from __future__ import annotations

import numpy as np

from engram.operators import ann, knn, lists

DIM = 16


def vectors(n: int, seed: int = 3) -> np.ndarray:
    rows = np.random.default_rng(seed).normal(size=(n, DIM))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_scores_of_many_rows_are_those_of_all_pairs():
    """Over several tiles, with copies, ties, and limits and thresholds of each query."""
    rows = vectors(9000)
    rows[5000:5300] = rows[17]
    rows[6000:6050] = np.round(rows[6000:6050] * 4) / 4 + 1e-9
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    ids = np.random.default_rng(1).permutation(len(rows))
    asked = np.concatenate([rows[:40], vectors(300, 9)])
    limit = np.r_[np.full(100, 7), np.arange(240) % 30 + 1].astype(np.int64)
    least = np.r_[np.full(170, 0.1), np.linspace(-1, 0.99, 170)]
    sims = np.round(asked @ rows.T, 6)
    for most in (limit, np.full(len(asked), 5, np.int64), None):
        q, i, s = knn._score(ids, rows, asked, least, most)
        got = {(a, b): c for a, b, c in zip(q.tolist(), i.tolist(), s.tolist())}
        want = {}
        for a in range(len(asked)):
            passed = np.flatnonzero(sims[a] >= least[a])
            best = passed[np.lexsort((ids[passed], -sims[a, passed]))][: None if most is None else most[a]]
            want |= {(a, int(ids[x])): float(sims[a, x]) for x in best}
        assert got == want and len(q) == len(got)


def told(asks: knn.Asks, rows: np.ndarray, numbers: np.ndarray) -> None:
    """Pair by pair the lists are those of the matrix."""
    matrix = asks(rows, numbers)
    tell = asks.pairs(rows, asks.cuts(rows))
    query, at = np.divmod(np.arange(matrix.size), len(numbers))
    assert (tell(query, numbers[at]).reshape(matrix.shape) == matrix).all()
    n = np.arange(len(numbers)) % 5
    assert (asks.held(rows, numbers, n) == matrix @ n).all()


def test_lists_told_pair_by_pair_are_those_of_the_matrix():
    rows = np.concatenate([vectors(200), np.eye(DIM), -np.eye(DIM)])  # unit vectors: many equal costs
    for probes in (1, 5, 37, 64, 99):
        told(ann.probed_buckets(2, 6, DIM, probes), rows, np.arange(128))
    told(ann.probed_buckets(2, 6, DIM, 9), rows, np.array([3, 17, 64, 127]))
    points = np.concatenate([vectors(30, 4), np.eye(DIM), np.eye(DIM)])  # every second one twice
    known = np.arange(len(points)) * 3
    for probes in (1, 8, 40, 61, 62, 99):
        told(lists.ClosestLists(points, known, probes), rows, known)
    told(lists.ClosestLists(points, known, 9), rows, np.array([0, 1, 3, 92, 500]))


def test_a_search_of_all_buckets_finds_the_exact_hits(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300))]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = stored.withColumnRenamed("id", "query_id")
    want = {(r.query_id, r.id) for r in knn.nearest(stored, asked, DIM, 5, exclude_self=True).collect()}
    hits = ann.search_lsh(stored, asked, DIM, 2, 4, limit=5, exclude_self=True, probes=16)
    assert {(r.query_id, r.id) for r in hits.collect()} == want


def test_queries_that_share_a_vector(spark, monkeypatch):
    """A vector of very many queries, some of few, and ones of their own are all answered."""
    monkeypatch.setattr(knn, "SHARED", 20)
    v = vectors(30)
    stored = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    rows = [(i, v[0 if i < 50 else 1 if i < 53 else i % 30].tolist()) for i in range(70)]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    want = {tuple(r) for r in knn.nearest(stored, asked, DIM, 3).collect()}
    got = {tuple(r) for r in knn.nearest(stored, asked, DIM, 3, max_broadcast_bytes=0, memory_rows=7, query_rows=9).collect()}
    assert got == want and len({r[0] for r in got}) == 70


def test_queries_of_few_numbers_go_in_passes(spark, monkeypatch):
    """Vectors of words, with copies, ties and empty ones: the hits of blocks, and no copies of memories."""
    random, wide = np.random.default_rng(8), 200

    def texts(n: int) -> list[list[float]]:
        rows = np.zeros((n, wide))
        for row in rows:
            row[random.zipf(1.4, 12) % wide] = random.integers(1, 3)
        return rows.tolist()

    said = texts(500)
    said[10:30] = [said[3]] * 20
    said[40] = [0.0] * wide
    stored = spark.createDataFrame([(i, v) for i, v in enumerate(said)], "id long, embedding array<float>")
    rows = [(i, v) for i, v in enumerate(texts(90) + said[:20] + [[0.0] * wide, None, [1.0]])]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    want = sorted(map(tuple, knn.nearest(stored, asked, wide, 4, 0.3).collect()))
    cut = []
    blocks = knn._in_blocks
    monkeypatch.setattr(knn, "_in_blocks", lambda *a, **k: cut.append(1) or blocks(*a, **k))
    for most in (wide * 16 * 20, wide * 16):
        assert sorted(map(tuple, knn.nearest(stored, asked, wide, 4, 0.3, max_broadcast_bytes=most).collect())) == want
    assert not cut and len(want) > 200
    got = knn.nearest(stored, asked, wide, 4, 0.3, max_broadcast_bytes=0).collect()
    assert cut and sorted(map(tuple, got)) == want
