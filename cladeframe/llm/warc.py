"""Content-addressed WARC archive."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table, utf8

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The head of the HTTP message that carries a payload.
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


@dataclass(frozen=True)
class WarcArchive:
    """Where an archive lies: ``payloads`` holds each distinct payload once, ``headers`` all of every record but its payload: WARC header, blank line, HTTP head."""

    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("sha256 string, payload binary").parquet(f"{self.path}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("header string, sha256 string").parquet(f"{self.path}/headers")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 1000, date: datetime | None = None) -> WarcArchive:
    """Writes one WARC/1.1 record per page; equal payloads of ``least_revisit`` bytes or more are stored by one response.

    Of equal payloads the page with the largest id is the response and the others are revisit
    records that refer to it; pages that repeat that id, too, are responses. Smaller payloads are
    all responses. A null html is an empty payload, a null url an empty target, a null id an empty
    record name, and pages that repeat an id repeat the record name; a null id is a response only
    where all ids of its payload are null. ``date`` (UTC; now, if not given) is the WARC-Date of all
    records. Columns other than the three are not read.

    Payload bytes are stored once each, under their SHA-256; the digest is verified: two payloads
    with one digest raise an error. Headers carry no payload. Which page is the response is settled
    by a count and a maximum per digest, so a hot payload is aggregated before it moves.
    """
    spark = pages.sparkSession
    body = utf8(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows.select("sha256", "payload").distinct().write.parquet(f"{path}/payloads")
    stored = WarcArchive(path).payloads(spark)
    if not stored.groupBy("sha256").count().filter("count > 1").isEmpty():
        raise ValueError("two payloads share a SHA-256")
    marks = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    last = marks.filter(F.col("n") >= least_revisit).groupBy("sha256").agg(F.max("page_id").alias("last"))
    joined = marks.join(last, "sha256", "left")
    first = (F.col("n") < least_revisit) | F.col("page_id").eqNullSafe(F.col("last"))
    said = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(first, "response").otherwise("revisit")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(said)),
        F.when(~first, F.concat(_field("WARC-Refers-To", _urn(F.col("last"))), _field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.when(first, F.col("n")).otherwise(0) + len(HTTP)).cast("string")),
        F.lit(CRLF + HTTP),
    )
    joined.select(header.alias("header"), "sha256").write.parquet(f"{path}/headers")
    return WarcArchive(path)


def _said(header: str, name: str, value: str = r"([^\r\n]*)") -> Column:
    """What a WARC field says, by the pattern of its value; null where the field is missing, empty or of another form."""
    block = F.substring_index(header, CRLF * 2, 1)
    return F.nullif(F.regexp_extract(block, rf"\r\n{name}: {value}(?:\r\n|$)", 1), F.lit(""))


def read_index(spark: SparkSession, archive: WarcArchive, id_type: str = "long") -> DataFrame:
    """What the stored headers say, with length and SHA-1 of the full payload as read back from the payload store.

    Returns ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, sha256``.
    """
    read = archive.payloads(spark).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    page = lambda name: _said("header", name, r"<urn:page:([^\r\n]*)>").cast(id_type)
    said = archive.headers(spark).select("sha256", page("WARC-Record-ID").alias("page_id"), F.coalesce(_said("header", "WARC-Target-URI"), F.lit("")).alias("url"), _said("header", "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"))
    return said.join(read, "sha256").select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "sha256")


def read_records(spark: SparkSession, archive: WarcArchive) -> DataFrame:
    """The original records, byte for byte: ``header, payload, record``; a revisit's record ends with its HTTP head, its payload is the full one."""
    joined = archive.headers(spark).join(archive.payloads(spark), "sha256")
    body = F.when(_said("header", "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("header", "payload", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_index(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, d AS payload_digest,
       CASE WHEN octet_length(encode(h)) < 1000 OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN octet_length(encode(h)) < 1000 OR page_id = last THEN NULL ELSE last END AS refers_to
FROM (SELECT page_id, h, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) p) t
"""
