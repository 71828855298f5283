"""WARC archives with revisit records for repeated payloads.

Headers only are shuffled by payload digest; each group of equal payloads of REVISIT_BYTES or
more keeps one response, and the others are written as revisits that refer to it. Archives are
written by Spark's own writer: a record is a row, and the line separator is the empty lines that
end a record. Reading takes the files whole, one at a time, and follows Content-Length.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import skew
from engram.sources.workspace import written

#: Smaller payloads are always responses.
REVISIT_BYTES = 1000
#: Payload bytes of one archive, roughly, and records at most.
ARCHIVE_BYTES = 16 << 20
ARCHIVE_RECORDS = 20_000
#: Groups of equal payloads that are sent to all tasks at most; more are joined by a shuffle.
MOST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = "record_type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload string"
TYPES = pa.schema([
    ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string()),
])


def headers(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with payload, digest and length; null html is empty."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )


def originals(rows: DataFrame) -> DataFrame:
    """(digest, bytes, response page, its url) of payloads that several records hold."""
    large = rows.where((F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("digest", "bytes", "page_id", "url")
    found = large.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("of"))
    return found.where("n > 1").select(
        F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"), F.col("of.page_id").alias("o_page"), F.col("of.url").alias("o_url")
    )


def record_id(page: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line breaks and percent signs are escaped."""
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(rows: DataFrame) -> DataFrame:
    """One row `value` per page: the text of its record, with fresh headers."""
    # Headers alone decide; the groups with several records are few, and checked before they
    # are sent to all tasks.
    of_group = skew.broadcast_if_few(written(originals(rows), "warc-originals"), MOST_GROUPS)
    found = rows.join(of_group, (F.col("digest") == F.col("o_digest")) & (F.col("bytes") == F.col("o_bytes")), "left")
    revisit = F.coalesce(F.col("page_id").isNull() | (F.col("page_id") < F.col("o_page")), F.lit(False)) & F.col("o_page").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    kind = F.when(revisit, "revisit").otherwise("response")
    of = lambda c: F.when(revisit, c)
    return found.select("page_id", F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", kind), field("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"))),
        field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", F.col("url")), field("X-Page-ID", F.col("page_id")),
        field("WARC-Profile", of(F.lit(PROFILE))), field("WARC-Refers-To", of(record_id(F.col("o_page"), F.col("o_url")))),
        field("WARC-Refers-To-Target-URI", of(F.col("o_url"))), field("WARC-Refers-To-Date", of(F.lit(DATE))),
        field("X-Refers-To-Page-ID", of(F.col("o_page"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block,
    ).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages as archives under `path`.

    Of records with equal payloads of 1000 bytes or more the one with the largest page_id is a
    response and the others revisit it; rows that share that id are all responses; a row without
    a page_id revisits like any other, and stays a response if no row of the group has one.
    Smaller payloads are all responses. A null url leaves its header out. An empty table writes
    an archive without records.
    """
    rows = headers(pages)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    out = records(rows).repartition(max(1, -(-total // ARCHIVE_BYTES)), F.xxhash64("page_id", "value"))
    out.select("value").write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")[1:]
        head = {k.lower(): v.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") for k, _, v in (x.partition(": ") for x in lines)}
        block = data[stop + 4 : stop + 4 + int(head["content-length"])]
        at = stop + 4 + len(block)
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        payload = block[block.index(b"\r\n\r\n") + 4 :].decode() if kind == "response" else None
        number = lambda k: int(head[k]) if k in head else None
        yield kind, number("x-page-id"), number("x-refers-to-page-id"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload


def file_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows = list(parsed(gzip.decompress(data.as_py())))
            for a in range(0, len(rows), 1000):
                kind, page, to, url, digest, payload = zip(*rows[a : a + 1000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip((kind, page, to, url, digest, [None] * len(kind), payload), TYPES)], schema=TYPES
                )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives, revisits resolved: each takes length, digest and payload from the
    response it refers to. Digests are computed from the payloads read, not taken from headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    rows = files.mapInArrow(file_records, RECORD)
    own = F.col("payload").isNotNull()
    rows = rows.withColumns({
        "payload_digest": F.when(own, F.sha1(F.encode("payload", "UTF-8"))).otherwise(F.col("payload_digest")),
        "payload_bytes": F.when(own, F.octet_length("payload")).cast("long"),
    })
    kept = rows.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    responses = rows.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("r_bytes"), F.col("payload").alias("r_payload")
    )
    found = responses.join(kept, ["refers_to", "payload_digest"], "left_semi").dropDuplicates(["refers_to", "payload_digest"])
    joined = rows.where("record_type = 'revisit'").join(found, ["refers_to", "payload_digest"], "left")
    joined = joined.withColumns({"payload_bytes": F.col("r_bytes"), "payload": F.col("r_payload")}).drop("r_bytes", "r_payload")
    return rows.where("record_type = 'response'").unionByName(joined)
