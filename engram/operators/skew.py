"""Joins that stay even when a few keys hold most of the rows, and checked broadcasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000
SALTS = 32
MAX_BROADCAST_IDS = 200_000
#: Characters of text whose words or grams one task sorts or counts.
CHARS_A_PART = 8_000_000
#: Most parts among which the rows of one term or gram are dealt.
SHARES = 16


def broadcast_if_few(frame: DataFrame, most: int | None = None) -> DataFrame:
    """Mark a narrow table for broadcast if it has at most `most` rows; otherwise leave the
    join to a shuffle. The check reads one row past the bound at most, and saves the other
    side, with its vectors or texts, from a shuffle."""
    most = MAX_BROADCAST_IDS if most is None else most
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], row_id: list[str], how: str = "inner"
) -> DataFrame:
    """Join a side with heavy keys to a much smaller one: the rows of a key are spread over
    SALTS tasks by `row_id`, and the small side is repeated for each."""
    salt = F.pmod(F.xxhash64(*row_id), F.lit(SALTS)).cast("int")
    repeated = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", salt).join(repeated, [*keys, "salt"], how).drop("salt")


def hottest(lookup: DataFrame, key: str, weight: str) -> DataFrame:
    """The HOT_KEYS heaviest rows of a lookup with one row per key: a list of fixed length
    to broadcast. Every key left over then holds less than 1/HOT_KEYS of all rows, so that
    the rest can meet by shuffle."""
    return lookup.orderBy(F.desc(weight), key).limit(HOT_KEYS)


def text_parts(rows: DataFrame, texts: list[str], chars: int | None = None) -> int:
    """The number of parts that hold about `chars` characters of some text columns each, so that
    a task's memory stays the same whatever the size of the table; one for each core at least."""
    chars = CHARS_A_PART if chars is None else chars
    lengths = [F.coalesce(F.sum(F.length(name).cast("long")), F.lit(0).cast("long")) for name in texts]
    total = sum(rows.agg(*[n.alias(f"n{i}") for i, n in enumerate(lengths)]).first())
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / chars))
