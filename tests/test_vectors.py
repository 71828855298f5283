import collections
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import ann, knn, lists, pivots, ranking

DIM = 8


def table(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def random_rows(n, seed, dim=DIM):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]


def brute(memories, queries, limit, threshold, exclude_self=False):
    out = []
    for qid, q in queries:
        hits = []
        for mid, v in memories:
            if v is None or len(v) != len(q) or (exclude_self and mid == qid):
                continue
            a, b = np.array(v, float), np.array(q, float)
            if not a.any() or not b.any():
                continue
            s = round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 6)
            if s >= threshold:
                hits.append((-s, mid))
        for rank, (s, mid) in enumerate(sorted(hits)[:limit], 1):
            out.append((qid, mid, -s, rank))
    return sorted(out)


def result(frame):
    rows = frame.select("query_id", "id", "similarity", "rank").collect()
    return sorted((r.query_id, r.id, round(r.similarity, 6), r.rank) for r in rows)


def test_cosine_properties(spark):
    rows = table(spark, [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None)])
    other = F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))
    got = {
        r.id: r
        for r in rows.select(
            "id",
            vectors.cosine_similarity(F.col("embedding"), F.col("embedding")).alias("self"),
            vectors.cosine_similarity(F.col("embedding"), other).alias("ab"),
            vectors.cosine_similarity(other, F.col("embedding")).alias("ba"),
            vectors.cosine_distance(F.col("embedding"), other).alias("d"),
            vectors.similarity_to("embedding", [3.0, 2.0, 1.0]).alias("to"),
        ).collect()
    }
    assert got[1].self == pytest.approx(1.0)
    assert got[1].ab == pytest.approx(got[1].ba) == pytest.approx(10 / 14)
    assert got[1].to == pytest.approx(got[1].ab)
    assert got[1].d == pytest.approx(1 - 10 / 14)
    for i in (2, 3):  # a zero or missing vector has no similarity at all
        assert got[i].self is None and got[i].ab is None and got[i].to is None


def test_zero_query_matches_nothing(spark):
    rows = table(spark, random_rows(5, 1))
    assert ranking.most_similar(rows, [0.0] * DIM, threshold=-1.0).count() == 0


def test_wrong_dimension_has_no_similarity(spark):
    rows = table(spark, [(1, [1.0, 0.0]), (2, [1.0])])
    got = {
        r.id: r.s
        for r in rows.select("id", vectors.similarity_to("embedding", [1.0, 0.0]).alias("s"))
        .collect()
    }
    assert got == {1: 1.0, 2: None}


def test_normalize_and_padding(spark):
    rows = table(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])
    got = {
        r.id: r
        for r in rows.select(
            "id",
            vectors.l2_normalize(F.col("embedding")).alias("n"),
            vectors.pad_vector(F.col("embedding"), 4).alias("p"),
            vectors.pad_vector(F.col("embedding"), 1).alias("same"),
            vectors.vector_dim(F.col("embedding")).alias("d"),
        ).collect()
    }
    assert got[1].n == pytest.approx([0.6, 0.8]) and got[2].n == [0.0, 0.0]
    assert got[1].p == [3.0, 4.0, 0.0, 0.0] and got[1].same == [3.0, 4.0] and got[1].d == 2


def test_threshold_before_limit_and_ties_by_id(spark):
    rows = table(spark, [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (4, [-1.0, 0.0])])
    got = ranking.most_similar(rows, [1.0, 0.0], limit=5, threshold=0.1).collect()
    assert [r.id for r in got] == [1, 3, 2]
    got = ranking.most_similar(rows, [1.0, 0.0], limit=1, threshold=0.1).collect()
    assert [r.id for r in got] == [1]


EDGE = [(900, None), (901, [0.0] * DIM), (902, [1.0, 2.0]), (903, [float("nan")] * DIM)]


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize(
    "options",
    [{}, {"max_broadcast_bytes": 0, "memory_rows": 17, "query_rows": 7}],
    ids=["one pass", "blocks"],
)
def test_nearest_equals_brute_force(spark, options, exclude_self):
    rows = random_rows(60, 2)
    copies = [(i, rows[5][1]) for i in range(100, 140)]  # a large group of copies
    memories = rows + copies
    frame = table(spark, memories + EDGE).repartition(3)
    queries = table(spark, memories + EDGE, "query_id").repartition(3)
    got = knn.nearest(frame, queries, DIM, 4, 0.2, exclude_self, **options)
    assert result(got) == brute(memories, memories, 4, 0.2, exclude_self)


def test_both_routes_agree_on_text_ids(spark):
    rows = [(f"m{i:03d}", v) for i, v in random_rows(40, 3)]
    frame = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = frame.withColumnRenamed("id", "query_id")
    one = knn.nearest(frame, queries, DIM, 3, 0.0)
    many = knn.nearest(
        frame, queries, DIM, 3, 0.0, max_broadcast_bytes=0, memory_rows=9, query_rows=9
    )
    assert result(one) == result(many) == brute(rows, rows, 3, 0.0)


@pytest.mark.parametrize(
    "options", [{}, {"max_broadcast_bytes": 0, "memory_rows": 11, "query_rows": 5}]
)
def test_all_above_emits_every_match(spark, options):
    rows = random_rows(50, 4)
    frame, queries = table(spark, rows), table(spark, rows[:9], "query_id")
    got = knn.all_above(frame, queries, DIM, 0.3, **options).collect()
    want = brute(rows, rows[:9], 1000, 0.3)
    assert sorted((r.query_id, r.id, round(r.similarity, 6)) for r in got) == [
        w[:3] for w in want
    ]


@pytest.mark.parametrize(
    "options", [{}, {"max_broadcast_bytes": 0, "memory_rows": 11, "query_rows": 5}]
)
def test_lists_meet_only_in_common_lists(spark, options):
    rows = random_rows(60, 5)
    frame = table(spark, rows).withColumn("list_ids", F.array((F.col("id") % 3).cast("int")))
    queries = table(spark, rows, "query_id").withColumn(
        "list_id", F.explode(F.array(F.lit(0), F.lit(2)))
    )
    got = knn.nearest(frame, queries, DIM, 5, 0.1, lists=True, **options)
    assert result(got) == brute([r for r in rows if r[0] % 3 != 1], rows, 5, 0.1)


def test_single_query_equals_batch(spark):
    rows = random_rows(40, 6)
    frame = table(spark, rows)
    batch = knn.nearest(frame, table(spark, rows[:3], "query_id"), DIM, 5, 0.1).collect()
    for qid, q in rows[:3]:
        one = ranking.most_similar(frame, q, 5, 0.1).collect()
        assert [(r.id, r.similarity) for r in one] == [
            (r.id, r.similarity)
            for r in sorted(batch, key=lambda r: r.rank)
            if r.query_id == qid
        ]


def test_ivf_with_all_lists_is_exact_and_index_is_partitioned(spark, tmp_path):
    rows = random_rows(80, 7)
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    centroids = ann.kmeans_centroids(frame, lists=4)
    path = str(tmp_path / "ivf")
    ann.build_ivf(frame, centroids, DIM, path)
    index = spark.read.parquet(path)
    assert index.count() == 80 and "list_id" in index.columns
    exact = knn.nearest(frame, queries, DIM, 5, 0.1, exclude_self=True)
    full = ann.search_ivf(index, centroids, queries, DIM, 4, 5, 0.1, exclude_self=True)
    assert result(full) == result(exact)
    some = ann.search_ivf(index, centroids, queries, DIM, 1, 5, 0.1, exclude_self=True)
    every = {r[:2]: r[2] for r in brute(rows, rows, 1000, 0.1, True)}
    assert all(every[r[:2]] == r[2] for r in result(some))
    score = ann.recall(exact, some).first()
    assert 0 < score.recall <= 1 and score.exact_hits == len(result(exact))


@pytest.mark.parametrize(
    "options", [{}, {"max_broadcast_bytes": 0, "memory_rows": 11, "query_rows": 5}]
)
@pytest.mark.parametrize("limit", [1000, 3])
def test_lsh_hits_are_exact_hits_of_shared_buckets(spark, options, limit):
    rows = random_rows(80, 8)
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    options = {"limit": limit, "threshold": 0.1, "exclude_self": True, **options}
    got = result(ann.search_lsh(frame, queries, DIM, tables=3, bits=2, **options))
    planes = ann.hyperplanes(3, 2, DIM)
    side = {i: (planes @ np.array(v) >= 0).reshape(3, 2) for i, v in rows}
    want = []
    for qid in side:
        met = [r for r in rows if (side[qid] == side[r[0]]).all(axis=1).any()]
        want += brute(met, [rows[qid]], limit, 0.1, True)
    assert got == sorted(want)


def test_pivots_leave_out_rows_and_lose_no_hit(spark):
    """Clusters far apart: most pairs are never scored, the hits are those of all pairs."""
    rng = np.random.default_rng(3)
    centres = np.eye(DIM)[:6] * 10
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=DIM) * 0.2)]) for i in range(240)]
    usable, rows = rows, rows + [(900, [0.0] * DIM), (901, None), (902, [1.0])]
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    for options in ({}, {"max_broadcast_bytes": 0, "memory_rows": 17, "query_rows": 9}):
        got = pivots.nearest_above(frame, queries, DIM, 4, 0.9, True, count=12, **options)
        assert result(got) == brute(usable, usable, 4, 0.9, True)
    met = pivots.pairs_met(frame, queries, DIM, 0.9, count=12).first()
    assert met.pairs == 243 * 240 and met.pairs_met < met.pairs / 2 and met.rings_met < met.rings / 2
    low = pivots.nearest_above(frame, queries, DIM, 1000, -1.0, count=5)
    assert result(low) == brute(usable, usable, 1000, -1.0)
    assert pivots.nearest_above(frame.limit(0), queries, DIM).count() == 0


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "memory_rows": 11, "query_rows": 5}])
def test_requests_with_their_own_limits(spark, options):
    rows = random_rows(60, 5)
    rows += [(100 + i, rows[3][1]) for i in range(9)]
    wanted = {i: (limit, threshold) for i, (limit, threshold) in enumerate([(3, 0.1), (1000, -1.0), (1, 0.9), (7, 0.2), (0, 0.0), (5, None)])}
    frame = table(spark, rows)
    asked = spark.createDataFrame(
        [(i, rows[3 if i in (0, 3) else i][1], *wanted[i]) for i in wanted], "query_id long, embedding array<float>, limit int, threshold double")
    want = []
    for i, (limit, threshold) in wanted.items():
        if limit and threshold is not None:
            want += brute(rows, [(i, rows[3 if i in (0, 3) else i][1])], limit, threshold)
    assert result(knn.nearest_each(frame, asked, DIM, **options)) == sorted(want)


def test_a_large_limit_sends_no_more_rows_of_the_others(spark):
    """What leaves the scan for a query depends on its own limit only."""
    rows = random_rows(80, 6)
    out = {}
    for large in (3, 1000):
        asked = pa.table({
            "query_id": [0, 1], "embedding": pa.array([rows[0][1], rows[1][1]], pa.list_(pa.float32())),
            "limit": [3, large], "threshold": [-1.0, -1.0]})
        frame = spark.createDataFrame([], "query_id long, id long, similarity double")
        sent = knn._in_one_pass(table(spark, rows).coalesce(1), asked, frame.schema, DIM, None, None, False).collect()
        out[large] = collections.Counter(r.query_id for r in sent)
    assert out[3] == {0: 3, 1: 3} and out[1000] == {0: 3, 1: 80}


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "memory_rows": 11, "query_rows": 5}])
def test_counts_above_a_threshold(spark, options):
    usable = random_rows(50, 8)
    rows = usable + [(99, [0.0] * DIM), (98, None)]
    got = knn.count_above(table(spark, rows), table(spark, rows, "query_id"), DIM, 0.3, **options)
    want = {}
    for q, _, s, _ in brute(usable, usable, 1000, 0.3):
        n, best = want.get(q, (0, -1.0))
        want[q] = (n + 1, max(best, s))
    assert {r.query_id: (r.met, r.closest) for r in got.collect()} == want


def test_lists_follow_the_rows_and_reach_the_recall(spark, tmp_path):
    rows = random_rows(600, 9)
    frame, queries = table(spark, rows + [(9000, None), (9001, [0.0] * DIM)]), table(spark, rows, "query_id")
    built = lists.build(frame, DIM)
    sizes = collections.Counter(r.list_id for r in built.members.collect())
    assert sum(sizes.values()) == 600 and 90 < len(sizes) and max(sizes.values()) < 60
    exact = knn.nearest(frame, queries, DIM, 5, 0.1, exclude_self=True)
    probes = lists.probes_for(built, queries, DIM, 5, 0.1, True)
    found = lists.search(built, queries, DIM, probes, 5, 0.1, exclude_self=True)
    assert ann.recall(exact, found).first().recall >= 0.9
    met = lists.pairs_met(built, queries, DIM, probes).first()
    assert met.pairs == 360_000 and met.pairs_met < met.pairs * 0.4
    every = lists.search(built, queries, DIM, built.centroids.count(), 5, 0.1, exclude_self=True)
    assert result(every) == result(exact)
    lists.write(built, str(tmp_path / "lists"), 8)
    assert spark.read.parquet(str(tmp_path / "lists")).where("folder = 0").agg({"list_id": "max"}).first()[0] < 8


def test_neighbouring_buckets_come_in_order():
    rng = np.random.default_rng(2)
    margins = rng.normal(size=(20, 6))
    found = ann.closest_buckets(margins, 20)
    for row, buckets in zip(margins, found):
        side = [int(m >= 0) for m in row]
        cost = {b: sum(abs(m) for i, m in enumerate(row) if (b >> i & 1) != side[i]) for b in range(64)}
        assert buckets.tolist() == sorted(cost, key=lambda b: (cost[b], b))[:20]


def test_probed_buckets_reach_the_recall(spark):
    rows = random_rows(400, 10)
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    exact = knn.nearest(frame, queries, DIM, 5, 0.1, exclude_self=True)
    bits = ann.bits_for(400)
    probes = ann.lsh_probes_for(frame, queries, DIM, 3, bits, 5, 0.1, True)
    found = ann.search_lsh(frame, queries, DIM, 3, bits, 5, 0.1, True, probes)
    assert bits == 5 and 1 < probes < 32 and ann.recall(exact, found).first().recall >= 0.9
    met = ann.lsh_pairs_met(frame, queries, DIM, 3, bits, probes).first()
    assert met.pairs == 160_000 and met.pairs_met < 3 * met.pairs


def test_lsh_queries_travel_without_their_buckets(spark, monkeypatch):
    rows, bucketed = random_rows(300, 11), ann.lsh_buckets
    frame, queries = table(spark, rows + [(900, None)]), table(spark, rows, "query_id")
    near = bucketed("embedding", 2, 4, DIM, 5)
    asked = queries.select("query_id", "embedding", F.explode(near).alias("list_id"))
    mine = frame.select("id", "embedding", bucketed("embedding", 2, 4, DIM).alias("list_ids"))
    want = result(knn.nearest(mine, asked, DIM, 3, 0.1, True, lists=True))

    def only_own(embedding, tables, bits, dimension, probes=1):
        assert probes == 1
        return bucketed(embedding, tables, bits, dimension)

    monkeypatch.setattr(ann, "lsh_buckets", only_own)
    for options in ({}, {"memory_rows": 70, "query_rows": 40}):
        assert result(ann.search_lsh(frame, queries, DIM, 2, 4, 3, 0.1, True, 5, **options)) == want
    assert ann.lsh_pairs_met(frame, queries, DIM, 2, 4, 5).first().pairs_met > 0


def test_probed_buckets_are_the_closest_ones():
    vectors = np.random.default_rng(3).normal(size=(30, DIM))
    vectors[0] = np.eye(DIM)[0]  # all margins tie
    margins = (vectors @ ann.hyperplanes(2, 5, DIM).T).reshape(30, 2, 5)
    got = ann.probed_buckets(2, 5, DIM, 7)(vectors, np.arange(64))
    for row, asked in enumerate(got):
        want = [b + (t << 5) for t in range(2) for b in ann.closest_buckets(margins[row : row + 1, t], 7)[0]]
        assert np.flatnonzero(asked).tolist() == sorted(want)


def test_queries_travel_without_the_lists_they_ask(spark, monkeypatch):
    rows = random_rows(300, 12)
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    built = lists.build(frame, DIM)
    asked = queries.join(lists.probed(built.centroids, queries, DIM, 9).select("query_id", "list_id"), "query_id")
    mine = built.members.withColumn("list_ids", F.array("list_id"))
    want = result(knn.nearest(mine, asked, DIM, 4, 0.1, True, lists=True))
    sizes = collections.Counter(r.list_id for r in built.members.collect())
    met = sum(sizes[r.list_id] for r in asked.collect())
    monkeypatch.setattr(lists, "probed", None)
    for options in ({}, {"memory_rows": 70, "query_rows": 40}):
        assert result(lists.search(built, queries, DIM, 9, 4, 0.1, True, **options)) == want
    assert lists.pairs_met(built, queries, DIM, 9).first().pairs_met == met


def test_queries_travel_without_the_rings_they_reach(spark, monkeypatch):
    rows = random_rows(200, 13)
    frame, queries = table(spark, rows), table(spark, rows, "query_id")
    monkeypatch.setattr(pivots, "reachable", None)
    got = pivots.nearest_above(frame, queries, DIM, 4, 0.5, True, memory_rows=60, query_rows=50)
    assert result(got) == brute(rows, rows, 4, 0.5, exclude_self=True)


def test_rows_that_come_twice_take_no_place_of_others(spark):
    rows = random_rows(60, 14)
    frame, queries = table(spark, rows + rows), table(spark, rows, "query_id")
    want = brute(rows, rows, 4, -1.0, exclude_self=True)
    assert result(pivots.nearest_above(frame, queries, DIM, 4, -1.0, True)) == want


def test_vectors_of_a_block_are_taken_a_part_at_a_time():
    """A block of any length leaves little more than its unit rows in memory, and the same rows."""
    n, dimension = 5 * knn.ROWS_AT_ONCE + 7, 32
    numbers = np.random.default_rng(3).normal(size=(n, dimension)).astype(np.float32)
    numbers[[5, knn.ROWS_AT_ONCE, n - 1]] = 0
    column = pa.chunked_array([pa.array(list(numbers), pa.list_(pa.float32()))])
    want_at, want = vectors.unit_rows(column.combine_chunks(), dimension)
    tracemalloc.start()
    at, rows = knn._unit_rows_of(column, dimension)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at.tolist() == want_at.tolist() and np.array_equal(rows, want)
    assert peak < 2.6 * rows.nbytes


def test_requests_past_one_slice_of_a_block_keep_their_rows(spark):
    """Blocks of more queries than a task takes at once answer as one pass does."""
    n = knn.ROWS_AT_ONCE + 300
    vector = F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(4)])
    stored = spark.range(60).select("id", vector.alias("embedding"))
    asked = spark.range(n).select(
        F.col("id").alias("query_id"), vector.alias("embedding"), (F.col("id") % 4).alias("limit"),
        F.lit(0.2).alias("threshold"),
    )
    want = knn.nearest_each(stored, asked, 4)
    got = knn.nearest_each(stored, asked, 4, max_broadcast_bytes=0, memory_rows=1000, query_rows=n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
