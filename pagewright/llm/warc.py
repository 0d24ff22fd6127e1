"""A content-addressed web archive: payloads once by digest, exact record headers apart, records by joins.

``write_archive`` makes two tables under a path: ``payloads`` (sha256, payload), where equal payloads are stored
once, and ``headers`` (header bytes of a WARC/1.1 record, and sha256 as the content address). Of records
with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page_id is the response and
the others are revisits that refer to it; smaller payloads are all responses. ``read_archive`` parses the headers,
recomputes both digests of every stored payload, fails on any that differs, and joins; ``records`` gives
the bytes of the original records.

Which payload is stored is decided on digests alone; page bytes are not shuffled to find copies, and a group of
copies costs one row of digests each. All of it runs as DataFrame expressions.

Defined cases: null or empty html is an empty payload. A null page_id counts as larger than any other
and reads back as null. Repeated rows with equal page_id and payload are responses alike, as no order tells them
apart; their payload is still stored once. A null url is an empty one; line breaks in it are percent-encoded. Extra
columns are not read. Empty tables give empty archives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_dir, written

#: Revisits' page_ids are broadcast up to this number of rows (16 MB), else joined by shuffle.
BROADCAST_ROWS = 500_000
#: The base-32 alphabet of WARC digests, in the order of its digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LAST = 2**63 - 1  # stands for a null page_id


def sha1_base32(payload: Column) -> Column:
    """The bare upper-case base-32 SHA-1 of a binary column: each 5 hex digits are 4 base-32 digits."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(date: str) -> Column:
    """The header block of a record, with its blank line."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.when(F.col(c) == _LAST, "-").otherwise(F.col(c).cast("string")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Content-Address", F.concat(F.lit("sha256:"), "sha256")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows of ``pages`` (page_id, url, html) as an archive under ``path``, which must be new."""
    own = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_LAST)).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    addressed = own.withColumn("sha256", F.sha2("payload", 256))
    seen = written(addressed.select("page_id", "url", "sha256", sha1_base32(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "pages-seen")
    groups = written(seen.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("sha256", "first"), "equal-payloads")
    revisits = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    records = seen.join(groups, "sha256", "left").withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("first")))
    records.select(_header(date).alias("header"), "sha256").write.parquet(f"{path}/headers")
    # only the pages that bring a payload for the first time; where several rows of that page_id bring it, one of them
    copies = seen.join(groups, "sha256").filter("page_id <> first").select("page_id", "sha256")
    copies = written(copies.distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    firsts = seen.join(groups, "sha256").filter("page_id = first").groupBy("sha256").count().filter("count > 1").select("sha256")
    twice = written(firsts, "repeated-pages")
    once = addressed.join(copies, ["page_id", "sha256"], "left_anti").select("sha256", "payload")
    if not twice.isEmpty():
        hint = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        once = once.join(hint, "sha256", "left_anti").unionByName(once.join(hint, "sha256", "left_semi").groupBy("sha256").agg(F.max("payload").alias("payload")))
    once.write.parquet(f"{path}/payloads")


def _field(name: str, pattern: str) -> Column:
    """The first group of ``pattern`` in a header's field; null where there is none."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: {pattern}\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, header and sha256 of each record.

    Sizes and digests are those of the stored payloads; the read fails where they aren't what the address or
    the header says.
    """
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    stored = payloads.select("sha256", F.sha2("payload", 256).alias("own"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    stored = written(stored, "stored-payloads")  # read anew, so that a join splits the records of one payload
    parsed = headers.select(
        "header",
        _field("WARC-Payload-Content-Address", "sha256:([0-9a-f]*)").alias("sha256"),
        _field("WARC-Type", "(\\w+)").alias("record_type"),
        _field("WARC-Record-ID", "<urn:page:(\\d+)>").cast("long").alias("page_id"),
        _field("WARC-Refers-To", "<urn:page:(\\d+)>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:(\\w*)").alias("said"),
    )
    fine = (F.col("own") == F.col("sha256")) & (F.col("payload_digest") == F.col("said"))
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload missing or changed: "), "sha256")))
    return parsed.join(stored, "sha256", "left").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "header", "sha256")


def records(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_archive`` gives, payload, and the bytes of each original record: its header, its block, two line ends.

    A revisit's record has an empty block; its payload is that of the record it refers to. Both sides of the join are
    read from tables, so that Spark splits the records of a payload that many have.
    """
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    seen = written(read_archive(spark, path), "records-seen")
    return seen.join(payloads, "sha256").drop("sha256").withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder (or under ``path``), read it back and rebuild the records.

    Sizes and digests are computed on the payloads in the rebuilt records.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return records(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
     g as (select h, min(page_id) as first from p group by h)
select p.page_id, octet_length(encode(p.h))::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(s, 5 * (i // 4)::int + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest,
       case when p.page_id = g.first then 'response' else 'revisit' end as record_type,
       case when p.page_id <> g.first then g.first end as refers_to
from p join g using (h)
"""
