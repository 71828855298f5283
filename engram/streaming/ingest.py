"""Continuous arrival of memories and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from engram.operators import keyed, store

#: Process what is there and stop; `{"processingTime": "1 minute"}` goes on for ever.
ONCE = {"availableNow": True}


def stream_memories(
    arriving: DataFrame,
    path: str,
    refused_path: str,
    checkpoint: str,
    dimension: int,
    trigger: dict | None = None,
    buckets: int = keyed.BUCKETS,
) -> StreamingQuery:
    """Validate arriving memories and store those whose id is new. What is not stored goes to a
    table (id, n, error) of its own. Each batch owns its folders, so one that runs again replaces
    its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = store.store_batch(batch, path, dimension, str(batch_id), buckets)
        done.refused.write.mode("overwrite").parquet(f"{refused_path.rstrip('/')}/batch_id={batch_id}")

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def stream_unique_tags(
    arriving: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "7 days",
    trigger: dict | None = None,
    buckets: int = keyed.BUCKETS,
) -> StreamingQuery:
    """Keep (memory_id, tag) unique while tags (memory_id, tag, created_at) arrive.

    Repeats within the watermark are dropped from bounded state; older ones by the keyed table,
    which reads only the buckets that may hold a key of the batch.
    """
    fresh = arriving.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(
        ["memory_id", "tag"]
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed.append(batch, path, ["memory_id", "tag"], str(batch_id), buckets)

    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )
