import datetime as dt

from pyspark.sql import functions as F

from engram.catalog.fixtures import Fixtures
from engram.catalog.queries import streamed
from engram.operators import store
from engram.streaming import activity, ingest

TAGS = "memory_id long, tag string, created_at timestamp"


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tags_stay_unique_across_batches_and_runs(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        tags = stream(spark, TAGS, source)
        ingest.stream_unique_tags(tags, sink, mark, delay="1 day").awaitTermination()
        rows = spark.read.parquet(sink).select("memory_id", "tag").collect()
        assert len(rows) == len(set(rows))
        return {tuple(r) for r in rows}

    write(spark, [(1, "a", day(1)), (1, "a", day(1)), (2, "b", day(1))], TAGS, source)
    assert run() == {(1, "a"), (2, "b")}
    write(spark, [(1, "a", day(1)), (3, "c", day(20))], TAGS, source)
    assert run() == {(1, "a"), (2, "b"), (3, "c")}
    # The key was forgotten by the watermark, but the store still knows it.
    write(spark, [(1, "a", day(25)), (4, "d", day(25))], TAGS, source)
    assert run() == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_memories_split_and_replayed_batch_replaces_itself(spark, tmp_path):
    source, sink, bad, mark = (str(tmp_path / n) for n in ("in", "out", "bad", "mark"))
    schema = "id string, heading string, summary string, importance_score double"
    write(spark, [("a", "h", "s", 0.5), ("b", "", "s", 0.5), ("c", "h", "s", 2.0)], schema, source)
    rows = stream(spark, schema, source).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    arriving = store.build_memories(rows, "2024-02-01")
    ingest.stream_memories(arriving, sink, bad, mark, 2).awaitTermination()
    # The same input from the start again, as after a lost checkpoint: batch 0 is replaced.
    ingest.stream_memories(arriving, sink, bad, mark + "2", 2).awaitTermination()
    assert [r.id for r in spark.read.parquet(sink).collect()] == ["a"]
    assert {r.id: r.error for r in spark.read.parquet(bad).collect()} == {
        "b": "heading is required", "c": "importance_score must be between 0 and 1"
    }


def test_daily_activity_drops_rows_past_the_watermark(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "created_at timestamp"

    def run():
        rows = stream(spark, schema, source)
        activity.stream_daily_activity(rows, sink, mark, delay="2 days").awaitTermination()
        got = activity.current_activity(spark, sink).collect()
        return {r.day.day: r.memories for r in got}

    write(spark, [(day(1, 3),), (day(1, 5),), (day(10),)], schema, source)
    assert run() == {1: 2, 10: 1}
    write(spark, [(day(9, 1),), (day(10, 2),), (day(1, 9),)], schema, source)
    assert run() == {1: 2, 9: 1, 10: 2}  # 9 January is in time, 1 January is too late


def test_a_table_arrives_as_one_file_and_as_a_folder_of_files(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (part,) = (tmp_path / "part").glob("part-*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    for form in ("file", "folder"):
        arriving = streamed(Fixtures(spark, str(tmp_path / form)), "documents").table("documents")
        sink, mark = str(tmp_path / f"{form}-out"), str(tmp_path / f"{form}-mark")
        writer = arriving.writeStream.format("parquet").option("checkpointLocation", mark)
        writer.trigger(availableNow=True).start(sink).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == list(range(20))
