"""A content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds every distinct payload once under
its SHA-256, ``headers`` holds each record's exact header bytes with the digest
of its payload. A join of both gives back every original record. Equal payloads
become revisit records that refer to the response with the smallest page id.

Everything is DataFrame functions, so records stay in the JVM. A payload that
very many records share is replicated a bounded number of times on reading, so
its records spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

#: Records that one copy of a shared payload serves on reading.
HOT = 512
#: Copies of the repeated digests when headers are written.
SALTS = 8
#: Fixed values of RFC 4648: the base32 digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from five hex digits to four base32 digits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as an archive below path.

    A null html is an empty payload, a null url leaves out the target line; line
    breaks and other control characters in urls are percent-encoded. Rows of the
    same page_id and payload are both responses when that id is the smallest. A
    null page_id counts as larger than all others. Other columns are ignored; an
    empty table gives an empty archive. Very long payloads are stored whole. The digest is verified here against
    length and SHA-1 (all rows of a digest must agree in both) and again on reading.
    """
    html = F.coalesce(F.encode("html", "utf-8"), F.lit("").cast("binary"))
    base = pages.select("page_id", "url", html.alias("payload"))
    keyed = base.select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("n_bytes"))
    agree = (F.min("sha1") == F.max("sha1")) & (F.min("n_bytes") == F.max("n_bytes"))
    per = keyed.groupBy("digest").agg(
        F.when(agree, F.min("page_id")).otherwise(F.raise_error(F.lit("payloads of one digest differ"))).alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = F.ceil(F.col("n") / HOT).cast("long")
    repeated = per.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        "digest", "salt", "first_id", copies.alias("copies"))
    spread = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    heads = keyed.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(repeated, ["digest", "salt"], "left")
    response = F.col("copies").isNull() | (F.col("n_bytes") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    heads.select(
        _header(response, date).alias("header"), F.unhex("digest").alias("digest"),
        F.pmod(spread, F.coalesce("copies", F.lit(1))).alias("part"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    page_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    stored = base.select(F.sha2("payload", 256).alias("digest"), page_key("page_id").alias("key"), "payload").join(
        per.select("digest", page_key("first_id").alias("key"), copies.alias("copies")), ["digest", "key"]
    ).dropDuplicates(["digest", "key"])
    stored.select(F.unhex("digest").alias("digest"), "payload", "copies").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _header(response: Column, date: str) -> Column:
    """WARC and HTTP header lines, each ended by CR LF, as bytes."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(response, F.col("n_bytes")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), uri("page_id")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), uri("first_id"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http), "utf-8")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: header, payload (in full, for revisits too) and the
    exact record bytes as a WARC file would hold them. A payload whose digest is
    not the one it is stored under, or that is missing, raises an error."""
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part"))
    joined = heads.join(payloads, ["digest", "part"], "left")
    sound = F.col("payload").isNotNull() & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("archive: payload missing or damaged")).cast("binary"))
    text = F.decode("header", "utf-8")
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1)
    page = lambda name: F.expr(f"try_cast(nullif(regexp_extract(decode(header, 'utf-8'), '{name}: <urn:page:([^>]*)>', 1), 'null') as bigint)")
    end = F.lit("\r\n\r\n").cast("binary")
    return joined.select("header", payload.alias("payload")).select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.substring(field("WARC-Payload-Digest"), 6, 99).alias("stated_digest"), "header", "payload",
        F.concat("header", F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary")), end).alias("record"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::blob) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
