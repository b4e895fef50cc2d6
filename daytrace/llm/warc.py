"""Content-addressed archive of web records: payloads once, headers as they are, records by joins."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CRLF = "\r\n"


@pandas_udf(StringType())
def base32_of_hex(hexes: pd.Series) -> pd.Series:
    return hexes.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())


def records(pages: DataFrame, *, row_key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (binary; null: empty), its length, digest (SHA-1, base32) and address
    (SHA-256) of each row.  Payloads are told apart by both digests and the length."""
    slim = pages.select(
        F.col(row_key).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    return slim.select(
        "page_id",
        "url",
        F.length("payload").cast("long").alias("bytes"),
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("address"),
        "payload",
    )


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    row_key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    smallest: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes ``path``/payloads (address, bytes, payload: each distinct payload once) and
    ``path``/headers (page_id, address, header: the exact header block of the record).

    Of records with equal payloads of at least ``smallest`` bytes, the one with the smallest id is a
    ``response`` and the others are ``revisit`` records that refer to it; smaller ones are all
    ``response``.  Null payloads are empty; null urls leave out the target header; a null id sorts
    last.  A row that repeats an id and its payload is a response again if the first was.  Equal payloads
    are found by digests and partial minima, so a payload on a third of all rows moves once per task.
    """
    slim = records(pages, row_key=row_key, url=url, payload=payload)
    # equal payloads: one row each, combined before the shuffle
    stored = slim.groupBy("address").agg(
        F.min("page_id").alias("first"), F.first("bytes").alias("bytes"), F.first("payload").alias("payload")
    )
    stored.write.parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "first")
    rows = slim.drop("payload").join(firsts, "address")
    revisit = (F.col("bytes") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("first"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    digest = F.concat(F.lit("sha1:"), base32_of_hex("sha1"))
    record_id = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        F.when(revisit, field("WARC-Refers-To", record_id(F.col("first")))).otherwise(""),
        field("WARC-Payload-Digest", digest),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    rows.select("page_id", "address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """The records of an archive: page_id, record_type, refers_to, payload_digest, payload_bytes, verified,
    and with ``payloads`` the header and payload bytes of the original record.

    Each stored payload is checked once against its address; header fields come from the header bytes.
    A revisit gets the payload it refers to.  verified: the payload is there, and its digest and
    address are those that the header and the store name.
    """
    store = spark.read.parquet(f"{path}/payloads")
    store = store.select(
        "address",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("_sha1"),
        (F.sha2("payload", 256) == F.col("address")).alias("_whole"),
        *(["payload"] if payloads else []),
    )
    heads = spark.read.parquet(f"{path}/headers").withColumn("_h", F.decode("header", "UTF-8"))
    field = lambda name, value: F.regexp_extract("_h", rf"(?m)^{name}: {value}$", 1)
    parsed = heads.select(
        "page_id",
        "address",
        "header",
        field("WARC-Type", "(.*)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:record:(.*)>"), F.lit("")).alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(.*)").alias("payload_digest"),
    )
    kind = heads.schema["page_id"].dataType
    return parsed.join(store, "address", "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        F.coalesce(F.col("_whole") & (base32_of_hex(F.col("_sha1")) == F.col("payload_digest")), F.lit(False)).alias("verified"),
        *(["header", "payload"] if payloads else []),
    )


def record_bytes(archive: DataFrame) -> DataFrame:
    """page_id and the bytes of each WARC record of an archive read with payloads: header, body (none for
    a revisit), two line ends."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
