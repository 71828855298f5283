"""Tables that keep a key unique across batches.

A table is a folder of batches, each cut into buckets by the hash of its key. Beside it stands,
for every bucket, a Bloom filter of the keys stored there, as a table of 64-bit words. A new batch
is reduced to one row per key; its keys are looked up in the filters, which rule out nearly
all that are new, and only the buckets of the rest are read to compare the keys themselves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators.skew import broadcast_if_few
from engram.sources.workspace import written

#: Buckets of a table; the number is kept with the table when its first batch is stored.
BUCKETS = 64
#: Bits of a bucket's filter, and how many a key sets: at ten bits a key, one new key in a
#: hundred is compared for nothing.
BITS, PROBES = 1 << 20, 7

FILTER = "bucket int, word int, bits long, batch_id string"


class Appended(NamedTuple):
    """Rows that a batch stored, and rows (keys, n, error) that it did not: keys that earlier
    batches hold, or further rows of its own keys."""

    stored: DataFrame
    repeated: DataFrame


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _positions(keys: list[str]) -> Column:
    """The bits that a key sets in its bucket's filter."""
    return F.array_distinct(
        F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BITS)).cast("int") for i in range(1, PROBES + 1)])
    )


def _bits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, bucket) as one row for each bit that a key sets."""
    spread = rows.select(*keys, "bucket", F.explode(_positions(keys)).alias("at"))
    return spread.select(
        *keys, "bucket", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("bit")
    )


def filter_path(path: str) -> str:
    return f"{path.rstrip('/')}-filter"


def read(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame | None:
    """The rows of all batches with their batch_id and bucket, or None before the first one."""
    try:
        return spark.read.schema(T.StructType([
            *columns.fields, T.StructField("batch_id", T.StringType()), T.StructField("bucket", T.IntegerType()),
        ])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _buckets(spark: SparkSession, path: str, buckets: int) -> int:
    """The table's number of buckets: the one it was begun with, else `buckets`, which is kept."""
    kept = f"{path.rstrip('/')}-settings"
    try:
        return spark.read.schema("buckets int").parquet(kept).first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(kept)
    return buckets


def known_keys(rows: DataFrame, path: str, keys: list[str], batch_id: str) -> DataFrame | None:
    """The keys among rows (keys, bucket) that other batches of the table hold, or None if there
    is no other batch."""
    spark = rows.sparkSession
    columns = T.StructType([rows.schema[k] for k in keys])
    held = read(spark, path, columns)
    if held is None:
        return None
    other = F.col("batch_id") != batch_id
    words = spark.read.schema(FILTER).parquet(filter_path(path)).where(other)
    words = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    asked = _bits(rows, keys)
    met = asked.join(words, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    likely = met.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    likely = written(likely.where(F.col("n") == F.size(_positions(keys))).select(*keys, "bucket"), "keyed-likely")
    touched = [r.bucket for r in likely.select("bucket").distinct().collect()]  # at most one a bucket
    stored = held.where(F.col("bucket").isin(touched) & other).select(*keys, "bucket")
    return stored.join(broadcast_if_few(likely), [*keys, "bucket"], "left_semi").select(*keys).distinct()


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least row of every key by its other columns in their order, and `n`, the number of its
    rows. Aggregated before the shuffle, so a key that repeats very often sends one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min(F.struct(*rest)).alias("row") if rest else F.lit(None).alias("row")
    one = rows.groupBy(*keys).agg(picked, F.count(F.lit(1)).alias("__n"))
    return one.select(*[f"row.{c}" if c in rest else c for c in rows.columns], "__n")


def append(rows: DataFrame, path: str, keys: list[str], batch_id: str, buckets: int = BUCKETS) -> Appended:
    """Store the rows whose key is new as one batch.

    A batch owns one folder: storing it again replaces it, and its own earlier rows do not count
    as known. Of several rows of a key the least is stored, by the other columns in their order,
    which must be comparable; a key with a null is refused. A batch's filter is written before its
    rows, so that no stored key is ever missing from it.
    """
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    count = _buckets(rows.sparkSession, path, buckets)
    one = written(one_per_key(rows, keys).withColumn("bucket", bucket_of(keys, count)), "keyed-batch")
    known = known_keys(one.select(*keys, "bucket"), path, keys, batch_id)
    if known is None:
        marked = one.withColumn("__known", F.lit(None).cast("boolean"))
    else:
        marked = written(one.join(known.withColumn("__known", F.lit(True)), keys, "left"), "keyed-marked")
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    fresh = marked.where(whole & F.col("__known").isNull())
    filters = _bits(fresh, keys).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
    filters.write.mode("overwrite").parquet(f"{filter_path(path)}/batch_id={batch_id}")
    # One file a bucket, more where a bucket holds much.
    stored = fresh.select(*rows.columns, "bucket").hint("rebalance", "bucket")
    stored.write.mode("overwrite").partitionBy("bucket").parquet(target)
    refused = F.col("__known") | ~whole
    again = F.when(refused, F.col("__n")).otherwise(F.col("__n") - 1)
    error = (
        F.when(~whole, "key is null")
        .when(F.col("__known"), "key is already stored")
        .otherwise("key repeats in the batch")
    )
    repeated = marked.select(*keys, again.alias("n"), error.alias("error")).where("n > 0")
    return Appended(fresh.select(*rows.columns), repeated)
