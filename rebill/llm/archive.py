"""Content-addressed WARC archive: payload bytes once by SHA-256, exact headers apart, records by joins.

A null html is an empty payload. Equal payloads of 1000 bytes or more have one response (the largest page_id)
and revisits; smaller ones are all responses that share the stored bytes. Null urls are written as ``urn:none``, line
breaks in urls as %0D and %0A, null page_ids as ``none``; without a page_id every record is a response. Every record,
revisits too, is rebuilt from its header and the payload it names, and ``sound`` says whether both digests hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import read, shared_dir

REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"  # of records; pages have no date of their own


def field(name: str, value: str = r".*"):
    """The value of a header line, null without one; urls can't hold a line break, so none begins a line."""
    found = F.regexp_extract("header", rf"(?m)^{name}: ({value})$", 1)
    return F.when(found != "", found)



def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Write ``path``/payloads (key, payload) and ``path``/headers (page_id, key, header)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload"))
    keyed = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"))
    keyed.groupBy("key").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    meta = keyed.select("page_id", "url", "key", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("n"))
    large = F.col("n") >= revisit_bytes
    heads = meta.where(large).groupBy("key").agg(F.max("page_id").alias("origin"))
    big = meta.where(large).join(heads, "key")
    every = big.unionByName(meta.where(~large).withColumn("origin", F.col("page_id")))
    response = F.col("origin").eqNullSafe(F.col("page_id")) | F.col("page_id").isNull()
    url = F.replace(F.replace(F.coalesce("url", F.lit("urn:none")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(response, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), name("origin"))),
        F.lit("\r\nContent-Length: "), F.when(response, F.col("n")).otherwise(F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    every.select("page_id", "key", header.alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, type, payload (in full, of revisits too), record (its bytes in the archive), sound."""
    headers = spark.read.parquet(f"{path}/headers").withColumn("type", field("WARC-Type"))
    payloads = spark.read.parquet(f"{path}/payloads")
    full = headers.join(payloads, "key", "left")
    body = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    sound = (F.sha2("payload", 256) == F.col("key")) & (F.sha1("payload") == field("WARC-Payload-Digest", "sha1:[0-9a-f]+").substr(6, 40))
    return full.select("page_id", "header", "type", "payload", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), F.coalesce(sound, F.lit(False)).alias("sound"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archive(read(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    checked = lambda c: F.when(F.col("sound"), c).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")))
    return back.select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), checked(F.sha1("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"), field("WARC-Refers-To", r"<urn:page:-?\d+>").substr(F.lit(11), F.lit(20)).alias("r")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.expr("cast(rtrim('>', r) as bigint)").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n < 1000 OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 1000 OR m = page_id THEN NULL ELSE m END AS refers_to FROM g
"""
