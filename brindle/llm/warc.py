"""A content-addressed web archive.

``write_archive`` stores every distinct payload once, under its SHA-256, in
``payloads`` and the exact bytes of every record's header block in
``headers``.  ``read_archive`` joins the two back into whole WARC/1.1
records.  Both tables are Parquet folders, so they can be in any store that
Spark reaches and Spark's commit protocol covers lost executors.
``export_warc`` writes the records end to end as plain WARC files, and
``parse_warc`` reads such a file as any WARC reader would, by its lengths.

Headers.  ``WARC-Date`` is the ``date`` given (pages have no time of their
own).  ``WARC-Target-URI`` holds the url with line ends and outer blanks as
per cent codes; a url that this changes is also kept as it was, in base 64,
in ``X-Source-URL``, so that every url comes back exactly.

Defined results: a null html is an empty payload; a null url has no
WARC-Target-URI and comes back null, an empty one has an empty value and comes
back empty; a null page_id is written as an empty id and never becomes
the response of others unless all page_ids of that payload are null; rows
that repeat page_id and payload give one response, the others of that id are
responses too (equal page_ids name the same record); an empty table gives
empty archives; other columns are ignored.  A stored payload that is missing,
or whose bytes do not have the digest and length that its header names, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads below this many bytes are never deduplicated by a revisit record.
MIN_REVISIT_BYTES = 100
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Of pages without a time of their own.
DATE = "1970-01-01T00:00:00Z"


def _shown_url(url: Column) -> Column:
    """A url in one line without outer blanks."""
    out = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.regexp_replace(F.regexp_replace(out, "^[ \t]+", ""), "[ \t]+$", "")


def _header(kind: str, date: str, page: Column, url: Column, digest: Column, size: Column, refers: Column | None) -> Column:
    parts = [
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: {kind}{_CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
        F.lit(f">{_CRLF}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{_CRLF}WARC-Target-URI: "), _shown_url(url)), F.lit("")),
        F.coalesce(F.when(_shown_url(url) != url, F.concat(F.lit(f"{_CRLF}X-Source-URL: "), F.regexp_replace(F.base64(F.encode(url, "UTF-8")), "[\r\n]", ""))), F.lit("")),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha256:"), digest,
    ]
    if refers is not None:
        parts += [
            F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: <urn:page:"),
            F.coalesce(refers.cast("string"), F.lit("")), F.lit(f">{_CRLF}Content-Length: 0{_CRLF}{_CRLF}"),
        ]
    else:
        parts += [F.lit(f"{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size.cast("string"), F.lit(_CRLF * 2)]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as an archive under ``path``.

    The first pass moves only (digest, page_id): map-side minima, so that a
    payload shared by a third of all pages is one row per task.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    heads = common.materialize(rows.select("page_id", "url", "digest", "size"), "warc-heads")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    linked = heads.join(first, "digest")
    response = (F.col("size") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    linked.select(
        "page_id", "digest",
        F.when(response, _header("response", date, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), None))
        .otherwise(_header("revisit", date, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first_id")))
        .alias("header"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    # One row holds a payload: the smallest page_id of its digest; repeated page_ids are made one below.
    nothing = F.lit(-(2**63))
    keep = first.select(F.coalesce("first_id", nothing).alias("key"), "digest")
    once = rows.select(F.coalesce("page_id", nothing).alias("key"), "digest", "payload").join(keep, ["key", "digest"])
    once = once.dropDuplicates(["key", "digest"]).select("digest", "payload")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: header, payload (empty for a revisit), whole record bytes, stored digest,
    and ``verified``: the stored bytes have the digest that the header names."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("stored_digest"), F.col("payload").alias("stored"))
    payloads = payloads.withColumns({"stored_bytes": F.length("stored").cast("long"), "verified": F.sha2("stored", 256) == F.col("stored_digest")})
    joined = headers.join(payloads, F.col("digest") == F.col("stored_digest"), "left")
    revisit = F.col("header").contains(f"{_CRLF}WARC-Type: revisit{_CRLF}")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("stored"))
    return joined.select(
        "header", body.alias("payload"), "stored_bytes", "stored_digest", "verified",
        F.concat(F.encode("header", "UTF-8"), body, F.lit(_CRLF.encode() * 2)).alias("record"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write records of :func:`read_archive` as WARC files, whole records end to end.

    Payloads are UTF-8, so Spark's text files hold their very bytes; the two
    line ends behind each record are what those files put behind each row."""
    whole = F.concat("header", F.decode("payload", "UTF-8"))
    records.select(whole.alias("record")).write.option("lineSep", _CRLF * 2).text(path)


def parse_warc(data: BinaryIO) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of each record of an open WARC file."""
    while line := data.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = []
        while (line := data.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a header block does not end")
            name, value = line[:-2].decode().split(":", 1)
            fields.append((name, value[1:]))
        size = int(dict(fields)["Content-Length"])
        block, end = data.read(size), data.read(4)
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def parse_headers(records: DataFrame) -> DataFrame:
    """The fields of a record's header block, read from its text."""
    field = lambda name, pattern: F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1)
    return records.withColumns({
        "page_id": field("WARC-Record-ID", "<urn:page:(-?[0-9]*)>").try_cast("bigint"),
        "url": F.when(F.col("header").contains(f"{_CRLF}X-Source-URL: "), F.decode(F.unbase64(field("X-Source-URL", "([^\r\n]*)")), "UTF-8")).when(
            F.col("header").contains(f"{_CRLF}WARC-Target-URI: "), field("WARC-Target-URI", "([^\r\n]*)")),
        "date": field("WARC-Date", "([^\r\n]*)"),
        "record_type": field("WARC-Type", "([a-z]+)"),
        "payload_digest": field("WARC-Payload-Digest", "sha256:([0-9a-f]+)"),
        "refers_to": field("WARC-Refers-To", "<urn:page:(-?[0-9]*)>").try_cast("bigint"),
        "content_length": field("Content-Length", "([0-9]+)").try_cast("bigint"),
    })


def archive_report(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages``, read the archive back and report each record (see module)."""
    write_archive(pages, path)
    return report(pages.sparkSession, path)


def report(spark: SparkSession, path: str) -> DataFrame:
    """The contract's columns of each record of an archive."""
    records = parse_headers(read_archive(spark, path))
    size, revisit = F.col("content_length"), F.col("record_type") == "revisit"
    sound = F.coalesce(F.col("verified") & (F.col("payload_digest") == F.col("stored_digest")) & (size == F.when(revisit, 0).otherwise(F.col("stored_bytes"))), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("a stored payload is missing or damaged: "), "payload_digest")).cast("long")
    return records.select(
        "page_id",
        F.when(sound, F.col("stored_bytes")).otherwise(broken).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )
