"""A content-addressed web archive: payload bytes once by strong digest, exact record headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Fixed values of the format: a revisit's profile, and the digits of base 32 in two alphabets.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FROM, _TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``data``: 8 groups of 20 bits, 4 digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _FROM, _TO)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for each row of ``pages`` to ``path``.

    ``path/payloads`` holds each distinct payload once: ``digest`` (SHA-256), ``payload``. ``path/records`` holds the
    records' headers (WARC and HTTP, byte for byte) with the digest of their payload. Among records with equal
    payloads of at least ``min_bytes`` bytes those with the smallest id are responses and others revisit that id.

    Payloads are shuffled once, after equal ones of a task have become one; everything else moves digests only.
    Null payload: empty bytes. Null id: comes after all others; a group of null ids only is of responses. Null URL:
    empty. Line ends and control characters in a URL are percent-encoded. Rows that repeat give a record each. An
    empty table gives an empty archive. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8") if dict(pages.dtypes)[payload_col] == "string" else F.col(payload_col), F.lit(b"")).alias("payload"),
    )
    addressed = rows.withColumn("digest", F.sha2("payload", 256))
    addressed.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")

    slim = addressed.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    first = slim.groupBy("digest").agg(F.min("id").alias("first"))
    kind = F.when((F.col("bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(kind == "response", F.col("bytes")).otherwise(0)
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(kind == "revisit", F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _record_id(F.col("first"))))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    records = slim.join(first, "digest").select(F.encode(head, "UTF-8").alias("head"), "digest")
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str, *, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """The records of an archive, each with its own or its referred-to payload.

    Columns: ``id, record_type, refers_to, url, head, payload_bytes, payload_digest`` and, if asked for, ``payload``.
    Size and SHA-1 are taken from the stored bytes, whose SHA-256 must be the address they are stored under, and the
    SHA-1 must be the one in the header; otherwise the read fails. Without ``payloads`` no payload is shuffled.
    """
    store = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("stored bytes differ from their digest")).cast("binary"))
    store = store.withColumn("payload", sound).select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), *(["payload"] if payloads else [])
    )
    text = F.decode(F.col("head"), "UTF-8")

    def field(name: str, value: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)

    records = spark.read.parquet(f"{path}/records").select(
        F.expr(f"try_cast(nullif({_sql('WARC-Record-ID', '<urn:x-page:(.*?)>')}, 'null') as {id_type})").alias("id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.expr(f"try_cast(nullif(nullif({_sql('WARC-Refers-To', '<urn:x-page:(.*?)>')}, ''), 'null') as {id_type})").alias("refers_to"),
        field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("said"),
        "head",
        "digest",
    )
    same = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest")))
    return records.join(store, "digest", "left").withColumn("payload_digest", same).drop("said", "digest")


def _sql(name: str, value: str) -> str:
    return rf"regexp_extract(decode(head, 'UTF-8'), r'\r\n{name}: {value}\r\n', 1)"


def original_records(archive: DataFrame) -> DataFrame:
    """``archive`` with ``record``: the bytes of each record as a plain archive file would hold it; revisits hold no payload."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.withColumn("record", F.concat("head", body, F.lit(f"{CRLF}{CRLF}".encode()))).drop("payload")
