"""Keys stay unique over batches; users' models; summaries and matches in place."""

import datetime as dt
import sys

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from engram.operators import chats, embedder, filters, fulltext, keyed, store, summarizer
from engram.plans import memorize
from engram.sources import tables
from engram.streaming import ingest

ROWS = "id string, value string, n long"
TURNS = "conv_id long, turn long, role string, text string"


def stored(spark, path):
    columns = spark.createDataFrame([], ROWS).schema
    return sorted((r.id, r.value, r.batch_id) for r in keyed.read(spark, path, columns).collect())


def refused(appended):
    return sorted((r.id, r.n, r.error) for r in appended.repeated.collect())


def test_a_key_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("a", "w", 2), (None, "z", 1)], ROWS)
    first = keyed.append(one, path, ["id"], "1", buckets=4)
    assert sorted(r.value for r in first.stored.collect()) == ["w", "y"]
    two = spark.createDataFrame([("b", "later", 1), ("c", "u", 1), ("b", "again", 1)], ROWS)
    second = keyed.append(two, path, ["id"], "2", buckets=9)  # the table keeps its own number
    assert refused(second) == [("b", 2, "key is already stored")]
    want = [("a", "w", "1"), ("b", "y", "1"), ("c", "u", "2")]
    assert stored(spark, path) == want
    # A batch that runs again replaces itself and knows the others' keys.
    keyed.append(one, path, ["id"], "1")
    keyed.append(two, path, ["id"], "2")
    assert stored(spark, path) == want
    assert spark.read.parquet(f"{path}-settings").first().buckets == 4


def test_null_and_repeated_keys_are_reported(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "w", 2), (None, "z", 1), (None, "y", 1)], ROWS)
    done = keyed.append(rows, str(tmp_path / "t"), ["id"], "1", buckets=2)
    assert {(r.id, r.n, r.error) for r in done.repeated.collect()} == {
        ("a", 1, "key repeats in the batch"), (None, 2, "key is null")}
    assert [r.id for r in done.stored.collect()] == ["a"]


def test_empty_batches(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], ROWS)
    assert keyed.append(none, path, ["id"], "1").stored.count() == 0
    rows = spark.createDataFrame([("a", "x", 1)], ROWS)
    assert keyed.append(rows, path, ["id"], "2").stored.count() == 1
    assert keyed.append(none, path, ["id"], "3").repeated.count() == 0
    assert tables_ids(spark, path) == ["a"]


def tables_ids(spark, path):
    return sorted(r.id for r in spark.read.schema(ROWS).parquet(path).collect())


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_many_keys_against_a_plain_set(spark, tmp_path, monkeypatch, bits):
    """Also with filters that are nearly full, which only makes more keys be compared."""
    monkeypatch.setattr(keyed, "BITS", bits)
    path, known = str(tmp_path / "t"), set()
    for batch, (low, high) in enumerate([(0, 300), (200, 500), (100, 700)]):
        rows = spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.lit("v").alias("value"), "id")
        rows = rows.toDF("id", "value", "n")
        done = keyed.append(rows, path, ["id", "value"], str(batch), buckets=3)
        ids = {str(i) for i in range(low, high)}
        assert {r.id for r in done.stored.collect()} == ids - known
        assert {r.id for r in done.repeated.collect()} == ids & known
        known |= ids
    assert spark.read.parquet(path).count() == 700


def test_filters_rule_out_new_keys_without_reading_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.append(spark.createDataFrame([("a", "x", 1)], ROWS), path, ["id"], "1", buckets=2)
    new = spark.createDataFrame([(f"k{i}", 0) for i in range(50)], "id string, bucket int")
    new = new.withColumn("bucket", keyed.bucket_of(["id"], 2))
    known = keyed.known_keys(new, path, ["id"], "2")
    assert known.count() == 0
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert f"{path}/" not in plan and plan.count("LocalRelation") >= 1  # no bucket is left to be read


def test_repeated_memories_of_a_stream_and_a_batch(spark, tmp_path):
    path, bad = str(tmp_path / "m"), str(tmp_path / "bad")
    rows = [("a", "h", "s"), ("a", "h", "s"), ("b", "h2", "s"), ("c", "", "s")]
    frame = spark.createDataFrame(rows, "id string, heading string, summary string")
    frame = store.build_memories(frame.withColumn("embedding", F.lit(None).cast("array<float>")), "2024-02-01")
    for batch in ("one", "two"):
        done = store.store_batch(frame, path, 2, batch, 2)
    assert sorted(r.id for r in tables.scan_memories(spark, path).collect()) == ["a", "b"]
    assert {(r.id, r.n, r.error) for r in done.refused.collect()} == {
        ("a", 2, "key is already stored"), ("b", 1, "key is already stored"), ("c", 1, "heading is required")}
    source = str(tmp_path / "in")
    frame.write.parquet(source)
    arriving = spark.readStream.schema(frame.schema).parquet(source)
    ingest.stream_memories(arriving, path, bad, str(tmp_path / "mark"), 2).awaitTermination()
    assert sorted(r.id for r in tables.scan_memories(spark, path).collect()) == ["a", "b"]
    assert {(r.id, r.error) for r in spark.read.parquet(bad).collect()} == {
        ("a", "key is already stored"), ("b", "key is already stored"), ("c", "heading is required")}


def test_ingest_twice_and_find_by_project_tag_and_date(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "How do bees fly?"), (2, 0, "user", "What is rust?")], TURNS)
    tags = spark.createDataFrame([(1, "bees"), (1, "bees"), (2, None), (2, "metal")], "conv_id long, tag string")
    notes = spark.createDataFrame([(1, "project", "Alpha"), (2, "project", None)], "conv_id long, key string, value string")
    path = str(tmp_path / "tables")
    counts = []
    for day in ("2024-03-01", "2024-03-02"):
        done = memorize.ingest_conversations(turns, day, tags=tags, metadata=notes, dimension=16)
        counts.append(memorize.remember(done, path, day, buckets=2))
    assert counts[0] == (2, 2, 1, 0, 0) and counts[1] == (0, 0, 0, 0, 5)
    memories = tables.scan_memories(spark, f"{path}/memories")
    own_tags, own_notes = tables.scan_tags(spark, f"{path}/tags"), tables.scan_metadata(spark, f"{path}/metadata")
    assert {r.created_at for r in own_tags.collect()} == {dt.datetime(2024, 3, 1)}
    found = filters.by_dates(memories, "2024-03-01", "2024-03-01")
    found = filters.by_any_tag(filters.by_project(found, own_notes, "Alpha"), own_tags, ["bees"])
    assert [r.summary for r in found.collect()] == ["How do bees fly?"]


def lengths_model():
    calls = []

    def model(texts):
        calls.append(len(texts))
        assert len(texts) <= 3 and sum(map(len, texts)) <= 40 or len(texts) == 1
        out = []
        for text in texts:
            if text == "bad":
                raise RuntimeError("no such thing")
            special = {"none": None, "short": [1.0], "zero": [0.0, 0.0], "nan": [float("nan"), 1.0], "words": ["x", "y"]}
            out.append(special.get(text, [float(len(text)), 0.0]))
        return out

    return model


def test_users_model(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    texts = ["ok", "bad", None, "", "none", "short", "zero", "nan", "words", "x" * 100, "fine", "bad", "ok"]
    frame = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "id long, text string, embedding string, kind string")
    got = {r.id: r for r in chats.embed_texts(frame.coalesce(1), embedder.provided(lengths_model, 2, call_rows=3, call_chars=40)).collect()}
    assert len(got) == len(texts) and set(got[0].asDict()) == {"id", "text", "kind", "embedding", "embed_error"}
    assert [i for i, r in got.items() if r.embedding is not None] == [0, 9, 10, 12]
    assert all(got[i].embedding == [1.0, 0.0] for i in (0, 9, 10, 12))
    assert got[1].embed_error == got[11].embed_error == "RuntimeError: no such thing"
    assert got[2].embed_error == got[3].embed_error == embedder.EMPTY_TEXT
    assert got[4].embed_error == "the model gave no vector" and "2 dimensions" in got[5].embed_error
    assert "zeros" in got[6].embed_error and "finite" in got[7].embed_error and got[8].embed_error.startswith("ValueError")
    raw = embedder.provided(lengths_model, 2, normalize=False)
    assert raw(frame.where("id = 0")).first().embedding == [2.0, 0.0]
    assert raw(frame.limit(0)).count() == 0


def test_model_that_gives_too_few_answers(spark):
    def load():
        return lambda texts: [[1.0]] * (len(texts) - (len(texts) > 1))

    got = embedder.provided(load, 1)(spark.createDataFrame([("a",), ("b",)], "text string")).collect()
    assert [r.embedding for r in got] == [[1.0], [1.0]]  # one by one it is right


def test_joined_vectors(spark):
    vectors = spark.createDataFrame(
        [(1, [3.0, 4.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0])],
        "k long, embedding array<double>")
    rows = spark.createDataFrame([(i, "t") for i in range(1, 7)] + [(1, ""), (None, "t")], "k long, text string")
    got = sorted(((r.k or 0, r.text, r.embedding, r.embed_error) for r in embedder.joined(vectors, "k", 2)(rows).collect()), key=str)
    errors = {(k, t): e for k, t, _, e in got}
    assert errors[1, "t"] is None and errors[1, ""] == embedder.EMPTY_TEXT and "no vector" in errors[6, "t"]
    assert "no vector" in errors[2, "t"] and "dimensions" in errors[3, "t"] and "zeros" in errors[4, "t"]
    assert "finite" in errors[5, "t"] and "no vector" in errors[0, "t"]
    assert [v for k, t, v, _ in got if (k, t) == (1, "t")] == [[3.0, 4.0]]


def test_users_summaries(spark):
    def load():
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise ValueError("boom")
            return ["Heading: H\nSummary:\nS" if "long" in p else "  " for p in prompts]

        return model

    turns = spark.createDataFrame(
        [(1, 0, "user", "a long talk"), (2, 0, "user", "boom"), (3, None, None, None), (4, 0, "user", "else"), (4, None, "user", "long")], TURNS)
    contexts = spark.createDataFrame([(1, "ctx")], "conv_id long, context string")
    got = {r.conv_id: r for r in summarizer.provided(load, contexts)(turns).collect()}
    assert (got[1].heading, got[1].summary, got[1].summarize_error) == ("H", "S", None)
    assert got[2].summary == "Chat log with 1 messages. Failed to generate AI summary: ValueError: boom"
    assert got[3].summary is None and got[3].summarize_error == "chat_log is required and cannot be empty"
    assert got[4].summary.endswith("the model gave no answer")
    steps = {r.conv_id: r for r in memorize.memorize_chats(turns, "2024-03-01", 16, summarize=summarizer.provided(load)).collect()}
    assert not steps[3].summarize_done and not steps[3].embed_done and steps[3].embed_error is None and steps[3].id is None
    assert steps[1].store_done and steps[2].store_done


@pytest.mark.parametrize("most", [200_000, 0])
def test_summaries_in_one_pass_and_by_joins(spark, most):
    turns = spark.createDataFrame(
        [(1, t, "user", f"Bees fly far. Rust is red {t}. Pools hold water and ducks." if t % 3 else None) for t in range(30)]
        + [(2, 0, "user", "!!"), (3, None, None, None), (1, 3, "user", "Bees fly far."), (None, 0, "user", "Bees drink.")], TURNS).repartition(3)
    got = {r.conv_id: (r.n_turns, r.heading, r.summary, r.summarize_error) for r in chats.summarize_chats(turns, 2, most).collect()}
    assert got[1][0] == 31 and got[2] == (1, "Developer Chat Summary", "Chat log with 1 messages.", None)
    assert got[3] == (0, None, None, "chat_log is required and cannot be empty")
    assert got[1][2] == "Pools hold water and ducks. Pools hold water and ducks."
    assert got[1][1] == "Pools hold water and ducks." and set(got) == {1, 2, 3}


def test_turns_are_read_once_after_the_weights(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Bees fly far. Rust is red.")], TURNS)
    turns.write.parquet(str(tmp_path / "turns"))
    frame = chats.summarize_chats(spark.read.parquet(str(tmp_path / "turns")))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_texts_are_matched_in_their_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Bees", "bees fly", "c"), (2, "Rust", "red rust flies", None)], "id long, heading string, summary string, context string")
    queries = spark.createDataFrame([(1, "bee fly"), (2, "rust"), (3, "fly")], "query_id long, text string")
    matched = fulltext.match_all(rows, queries)
    assert "Exchange hashpartitioning" not in matched._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.id) for r in matched.collect()) == [(1, 1), (2, 2), (3, 1)]
    terms = fulltext.weighted_terms(rows)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()


def test_a_memory_longer_than_a_batch_is_counted_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(1, "a b", "c d " * 50 + "e", "x"), (2, "a", "c", None), (3, "", "", None)], "id long, heading string, summary string, context string")
        got = {(r.id, r.term): (r.tf_a, r.tf_b, r.tf_c) for r in fulltext.weighted_terms(rows.coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(1, "b"): (1, 0, 0), (1, "c"): (0, 50, 0), (1, "d"): (0, 50, 0), (1, "e"): (0, 1, 0), (1, "x"): (0, 0, 1), (2, "c"): (0, 1, 0)}


def test_activity_has_one_folder_a_day(spark, tmp_path):
    from engram.streaming import activity

    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for n in range(4):
        spark.createDataFrame([(dt.datetime(2024, 1, 1 + n % 2, n),)], "created_at timestamp").coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("created_at timestamp").parquet(source)
        activity.stream_daily_activity(rows, sink, mark, trigger={"availableNow": True}).awaitTermination()
    assert {r.day.day: r.memories for r in activity.current_activity(spark, sink).collect()} == {1: 2, 2: 2}
    files = [p for p in (tmp_path / "out").rglob("*.parquet")]
    assert len(files) == 2 and sum(pq.read_metadata(str(p)).num_rows for p in files) == 2
