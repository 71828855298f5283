import datetime as dt

import pytest
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import aggregates, filters, ranking, skew, store
from engram.plans import search
from engram.sources import tables, workspace

UTC = dt.timezone.utc
AS_OF = "2024-02-01"
MEMORY = (
    "id string, heading string, summary string, embedding array<float>, created string, "
    "context string, source string, importance_score double"
)


def rows(spark, data):
    frame = spark.createDataFrame(data, MEMORY)
    return frame.withColumn("created_at", F.to_timestamp("created")).drop("created")


@pytest.fixture()
def memories(spark):
    return store.build_memories(
        rows(
            spark,
            [
                ("a", "Alpha one", "s", [1.0, 0.0], "2024-01-10 00:00:00", "c", "src", 0.2),
                ("b", "Beta", "s", [1.0, 1.0], "2024-01-20 00:00:00", None, None, None),
                ("c", "Gamma", "s", None, "2024-01-31 12:00:00", None, "other", 0.9),
                ("d", "Delta", "s", [0.0, 0.0], None, None, "src", 0.0),
            ],
        ),
        AS_OF,
    )


@pytest.fixture()
def tags(spark):
    return spark.createDataFrame(
        [("a", "z"), ("a", "x"), ("a", "x"), ("b", "x"), ("ghost", "lost"), ("c", None)],
        "memory_id string, tag string",
    )


@pytest.fixture()
def metadata(spark):
    return spark.createDataFrame(
        [("a", "project", '"web"'), ("b", "project", '"api"'), ("a", "props", '{"k": 3}'),
         ("ghost", "project", '"web"')],
        "memory_id string, key string, value string",
    )


def ids(frame, column="id"):
    return sorted(r[column] for r in frame.select(column).collect())


def test_defaults(memories):
    got = {r.id: r for r in memories.collect()}
    assert got["b"].source == "chat" and got["b"].importance_score == 0.5
    assert got["a"].source == "src" and got["a"].importance_score == 0.2
    assert got["d"].created_at == dt.datetime(2024, 2, 1)
    assert got["d"].updated_at == got["d"].created_at
    assert memories.columns == [
        "id", "heading", "summary", "embedding", "created_at", "updated_at", "context",
        "source", "importance_score",
    ]


def test_validation(spark):
    bad = store.build_memories(
        rows(
            spark,
            [
                (None, "h", "s", None, None, None, None, None),
                ("1", "", "s", None, None, None, None, None),
                ("2", "h", None, None, None, None, None, None),
                ("3", "h", "s", None, None, None, None, 1.5),
                ("4", "h", "s", None, None, None, None, -0.1),
                ("5", "h", "s", [1.0], None, None, None, 0.0),
                ("6", "h", "s", None, None, None, None, 1.0),
                ("7", "h", "s", [1.0, 2.0], None, None, None, 0.0),
                ("8", "h", "s", None, None, None, None, float("nan")),
            ],
        ),
        AS_OF,
    )
    checked = store.validate(bad, 2)
    errors = {r.id: r.error for r in checked.collect()}
    assert errors[None] == "id is required" and errors["1"] == "heading is required"
    assert errors["2"] == "summary is required" and "between 0 and 1" in errors["3"]
    assert "between 0 and 1" in errors["4"] and "2 dimensions" in errors["5"]
    assert errors["6"] is None and errors["7"] is None and "between" in errors["8"]
    assert store.accepted(checked).count() + store.rejected(checked).count() == 9
    strict = {r.id: r.error for r in store.validate(bad, 2, embedding_required=True).collect()}
    assert strict["6"] == "embedding is required" and strict["7"] is None


def test_append_is_idempotent_per_batch(spark, memories, tmp_path):
    path = str(tmp_path / "table")
    first = store.append_memories(memories, path, 2, "b1")
    assert ids(first, "memory_id") == ["a", "b", "c", "d"]
    store.append_memories(memories, path, 2, "b1")
    store.append_memories(memories.withColumn("id", F.concat(F.lit("x"), "id")), path, 2, "b2")
    assert tables.scan_memories(spark, path).count() == 8


def test_ids_are_deterministic(spark):
    frame = spark.createDataFrame([("x", None), ("x", ""), ("xy", "")], "a string, b string")
    got = [r.i for r in frame.select(store.memory_id("a", "b").alias("i")).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 64


@pytest.mark.parametrize("bound", [200_000, 0])
def test_upsert(spark, memories, monkeypatch, bound):
    monkeypatch.setattr(skew, "MAX_BROADCAST_IDS", bound)
    changes = store.build_memories(
        rows(
            spark,
            [
                ("a", "old", "s2", None, "2024-01-11 00:00:00", None, None, None),
                ("a", "new", "s3", None, "2024-01-12 00:00:00", None, None, None),
                ("n", "added", "s", None, "2024-01-13 00:00:00", None, None, None),
            ],
        ),
        AS_OF,
    )
    once = store.upsert_memories(memories, changes, "2024-03-01")
    got = {r.id: r for r in once.collect()}
    assert set(got) == {"a", "b", "c", "d", "n"}
    assert got["a"].heading == "new" and got["a"].created_at == dt.datetime(2024, 1, 10)
    assert got["a"].updated_at == dt.datetime(2024, 3, 1)
    assert got["n"].updated_at == dt.datetime(2024, 1, 13)
    assert got["b"].updated_at == dt.datetime(2024, 1, 20)
    twice = store.upsert_memories(once, changes, "2024-03-01")
    keep = ["id", "heading", "created_at"]
    assert sorted(twice.select(*keep).collect()) == sorted(once.select(*keep).collect())


@pytest.mark.parametrize("bound", [200_000, 0])
def test_delete_cascades_and_reports(spark, memories, tags, metadata, monkeypatch, bound):
    monkeypatch.setattr(skew, "MAX_BROADCAST_IDS", bound)
    wanted = spark.createDataFrame([("a",), ("a",), ("nope",)], "id string")
    kept, t, m, gone = store.delete_memories(memories, tags, metadata, wanted)
    assert ids(kept) == ["b", "c", "d"]
    assert "a" not in ids(t, "memory_id") and "a" not in ids(m, "memory_id")
    assert {r.id: r.deleted for r in gone.collect()} == {"a": True, "nope": False}
    assert store.get_by_id(kept, wanted).count() == 0


def test_tags_metadata_and_orphans(spark, memories, tags):
    assert store.dedup_tags(tags).count() == 5
    assert ids(store.orphans(tags, memories), "memory_id") == ["ghost"]
    arrived = spark.createDataFrame(
        [("a", "k", "1", dt.datetime(2024, 1, 1)), ("a", "k", "2", dt.datetime(2024, 1, 2)),
         ("a", "l", "3", dt.datetime(2024, 1, 1))],
        "memory_id string, key string, value string, created_at timestamp",
    )
    got = {(r.memory_id, r.key): r.value for r in store.latest_metadata(arrived).collect()}
    assert got == {("a", "k"): "2", ("a", "l"): "3"}
    entries = F.create_map(F.lit("p"), F.lit('say "hi"'))
    row = store.explode_metadata(memories.where("id = 'a'"), entries).first()
    assert (row.key, row.value) == ("p", '"say \\"hi\\""')


def test_tag_arrays_and_views(memories, tags):
    got = {r.id: r.tags for r in aggregates.memories_with_tags(memories, tags).collect()}
    assert got == {"a": ["x", "z"], "b": ["x"], "c": [], "d": []}


def test_stats_fan_out_and_per_memory(memories, tags):
    tags = store.dedup_tags(tags).where("tag IS NOT NULL")
    fan = aggregates.memory_stats(memories, tags, AS_OF).first()
    assert fan.total_memories == 5  # a twice, b, c, d
    assert fan.avg_importance == pytest.approx((0.2 * 2 + 0.5 + 0.9 + 0.0) / 5)
    assert fan.unique_tags == 2 and fan.unique_sources == 3
    per = aggregates.memory_stats_per_memory(memories, tags, AS_OF).first()
    assert per.total_memories == 4 and per.recent_memories == 2 and per.monthly_memories == 4
    assert per.avg_importance == pytest.approx(1.6 / 4)


def test_activity(memories):
    got = [(str(r.day), r.memories) for r in aggregates.daily_activity(memories, AS_OF).collect()]
    assert got == [("2024-01-31", 1), ("2024-02-01", 1)]
    stats = {(r.metric, r.day): r.value for r in aggregates.store_stats(memories, AS_OF).collect()}
    assert stats == {
        ("total_memories", None): 4,
        ("recent_activity", "2024-01-31"): 1,
        ("recent_activity", "2024-02-01"): 1,
    }


def test_filters(spark, memories, tags, metadata):
    raw = memories.withColumn(
        "importance_score", F.when(F.col("id") != "b", F.col("importance_score"))
    )
    assert ids(filters.by_importance(raw, 0.0)) == ["a", "c", "d"]  # NULL never passes
    assert ids(filters.by_importance(raw, None)) == ["a", "b", "c", "d"]
    assert ids(filters.by_source(memories, "src")) == ["a", "d"]
    assert ids(filters.by_source(memories, None)) == ["a", "b", "c", "d"]
    both = filters.by_dates(memories, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    assert ids(both) == ["a", "b"]  # inclusive at both ends
    assert ids(filters.since(memories, "2024-01-31")) == ["c", "d"]
    assert ids(filters.heading_like(memories, ["lpha", "elta"])) == ["a", "d"]
    assert ids(filters.by_tag(memories, tags, "x")) == ["a", "b"]
    assert ids(filters.by_any_tag(memories, tags, ["z", "lost"])) == ["a"]
    assert ids(filters.by_project(memories, metadata, "web")) == ["a"]
    assert ids(filters.by_metadata(memories, metadata, "props", "3", "$.k")) == ["a"]


def test_filters_reach_the_scan(spark, memories, tmp_path):
    path = str(tmp_path / "m")
    memories.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    kept = filters.by_source(
        filters.by_importance(tables.scan_memories(spark, path), 0.1), "src"
    ).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(importance_score,0.1)" in plan
    assert "EqualTo(source,src)" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_recent_and_preview(memories):
    got = ranking.recent(memories, 2).collect()
    assert [r.id for r in got] == ["d", "c"] and {r.similarity for r in got} == {0.0}
    hits = memories.withColumn("similarity", F.lit(0.5)).withColumn(
        "heading", F.repeat("heading", 50)
    )
    shown = ranking.preview(hits).collect()
    assert [r.id for r in shown] == ["a", "b", "c"] and len(shown[0].heading) == 60


def test_semantic_search(memories, tags):
    got = search.search_semantic(memories, tags, [1.0, 0.0], threshold=0.1).collect()
    by_id = {r.memory_id: r for r in got}
    assert set(by_id) == {"a", "b"}  # neither the zero nor the missing vector
    assert by_id["a"].similarity == 1.0 and by_id["a"].tags == ["x", "z"]
    tagged = search.search_semantic(memories, tags, [1.0, 0.0], tag="z").collect()
    assert [(r.memory_id, r.tags) for r in tagged] == [("a", ["x", "z"])]  # all its tags
    late = search.search_semantic(memories, tags, [1.0, 0.0], date_from="2024-01-15").collect()
    assert [r.memory_id for r in late] == ["b"]


def test_metadata_and_hybrid_search(memories, tags, metadata):
    got = search.search_metadata(memories, tags, metadata, any_tag=["x"]).collect()
    assert sorted(r.id for r in got) == ["a", "b"]
    got = search.search_hybrid(memories, tags, metadata, [0.0, 1.0], project="api").collect()
    assert [(r.id, r.similarity) for r in got] == [("b", pytest.approx(0.707107))]


def test_fetch_context(spark, memories):
    requests = spark.createDataFrame(
        [
            (1, "text", [1.0, 0.0], "semantic", 1, 0.1),
            (2, "", [1.0, 0.0], "semantic", 2, 0.1),
            (3, "text", [1.0, 0.0], "hybrid", 1, 0.1),
            (4, "text", [1.0, 0.0], None, None, 0.9),
            (5, "text", [0.0, 0.0], "semantic", 5, 0.1),
        ],
        "query_id long, query string, embedding array<float>, search_type string, "
        "limit int, threshold double",
    )
    got = {}
    for r in search.fetch_context(memories, requests, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.search_type_used))
    assert sorted(got[1]) == [(1, "a", "semantic")]
    assert sorted(got[2]) == [(1, "d", "recent"), (2, "c", "recent")]
    assert sorted(got[3]) == [(1, "d", "recent")]
    assert sorted(got[4]) == [(1, "a", "semantic")]
    assert 5 not in got
    found = ranking.total_found(
        requests, search.fetch_context(memories, requests, 2).select("query_id")
    )
    assert {r.query_id: r.total_found for r in found.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 0}
    many = requests.withColumn("limit", F.lit(1000))
    everything = search.fetch_context(memories, many, 2).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in everything}[2] == memories.count()
    none = requests.withColumn("limit", F.lit(0))
    assert search.fetch_context(memories, none, 2).count() == 0
    assert search.fetch_context(memories, requests.limit(0), 2).count() == 0


def test_workspace_uses_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = workspace.new_path(spark, "x")
    assert path != workspace.new_path(spark, "x")
    if root:
        assert path.startswith(root.rstrip("/") + "/engram/")


def test_similarity_column_and_udf_agree(memories):
    fixed = F.array(F.lit(0.3), F.lit(0.7))
    got = memories.select(
        vectors.reported(vectors.cosine_similarity("embedding", fixed)).alias("a"),
        vectors.reported(vectors.similarity_to("embedding", [0.3, 0.7])).alias("b"),
    ).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_recency_skips_older_row_groups(spark, tmp_path):
    path = str(tmp_path / "m")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(64 * 1024))
    try:
        spark.range(100_000).select(
            F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("heading"),
            F.lit("s").alias("summary"), F.timestamp_seconds("id").alias("created_at"),
        ).coalesce(1).write.parquet(path)
    finally:
        hadoop.unset("parquet.block.size")
    kept = ranking.recent(spark.read.parquet(path), 5)
    assert [r.id for r in kept.collect()] == [99_999, 99_998, 99_997, 99_996, 99_995]
    assert rows_read(kept._jdf.queryExecution().executedPlan()) < 50_000


def test_bucketed_tables_join_without_a_shuffle(spark, memories, tags, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = tables.save_bucketed(memories, "bm", str(tmp_path / "m"), "id", 4)
        t = tables.save_bucketed(tags, "bt", str(tmp_path / "t"), "memory_id", 4)
        joined = aggregates.memories_with_tags(m, t)
        assert {r.id: r.tags for r in joined.collect()} == {
            "a": ["x", "z"], "b": ["x"], "c": [], "d": []
        }
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bm")
        spark.sql("DROP TABLE IF EXISTS bt")


def rows_read(plan):
    """Rows that the scan of the texts returned."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_read(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return rows_read(plan.plan())
    if plan.nodeName().startswith("Scan"):
        return plan.metrics().apply("numOutputRows").value()
    return sum(rows_read(plan.children().apply(i)) for i in range(plan.children().size()))
