"""A content-addressed WARC archive: payloads once by a verified digest, exact record headers apart, records by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: Payloads of fewer bytes are always stored with their record.
REVISIT_BYTES = 1000
CRLF = "\r\n"


@dataclass
class Archive:
    """headers: page_id, record_id, header (bytes up to and with the empty line), digest (null for a revisit). payloads: digest, payload; one row per different payload."""

    headers: DataFrame
    payloads: DataFrame


def record_id(page: Column, url: Column, number: Column) -> Column:
    """A urn:uuid made from what the record is about."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(page.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), number.cast("string")))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> Archive:
    """One record per row of pages. Of rows with equal payloads of REVISIT_BYTES or more, that with the largest id is a
    response and the others revisit it; all others are responses.

    Payloads are known by SHA-256 and size; the SHA-1 in the headers is for readers of WARC. A null html is an empty payload,
    a null url leaves its header out; a url with line breaks stands in a header of its own, in base 64, besides. Ids may be
    of any ordered type; null ids are less than all others; of rows with the same largest id, each is a response (they
    can't be told apart, and revisits name the first); repeated rows make repeated records with ids of their own. Texts of
    any length, extra columns and clashing names need no care. An empty table gives an empty archive.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "number": F.monotonically_increasing_id()})
    heads = materialise(rows.drop("payload"), "heads")
    first = heads.groupBy("digest").agg(F.max(F.struct("page_id", (-F.col("number")).alias("order"), "url")).alias("first"))
    first = materialise(first, "first-of-payload")
    both = heads.join(first, "digest")  # a payload may be a third of all rows: Spark splits its side of the join
    revisit = (F.col("bytes") >= REVISIT_BYTES) & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    mine, other = record_id(F.col("page_id"), F.col("url"), F.col("number")), record_id(F.col("first.page_id"), F.col("first.url"), -F.col("first.order"))
    u = F.col("url")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<"), mine, F.lit(">"))), line("WARC-Date", F.lit(date)),
        F.when(u.isNull(), "").otherwise(line("WARC-Target-URI", F.regexp_replace(u, r"[\r\n]", ""))), F.when(u.rlike(r"[\r\n]"), line("X-Target-URI-Base64", F.base64(F.encode(u, "UTF-8")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), other, F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))), F.lit(CRLF),
    )
    headers = materialise(both.select("page_id", mine.alias("record_id"), header.cast("binary").alias("header"), F.when(~revisit, F.col("digest")).alias("digest")), "warc-headers")
    # each payload once; copies in a task already meet there, before anything is shuffled
    payloads = materialise(rows.select("digest", "payload").dropDuplicates(["digest"]), "warc-payloads", heads, first)
    wrong = payloads.filter(F.sha2("payload", 256) != F.col("digest")).limit(1).count()
    if wrong:
        raise RuntimeError("a stored payload doesn't have its digest")
    tidy(pages.sparkSession)
    return Archive(headers, payloads)


def read_records(archive: Archive) -> DataFrame:
    """page_id, record_id, record: the exact bytes of header, block and the closing empty lines. Only responses are joined with payloads; a revisit's block is empty."""
    end = F.lit((CRLF * 2).encode())
    full = archive.headers.filter(F.col("digest").isNotNull()).join(archive.payloads, "digest").select("page_id", "record_id", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(archive.headers.filter(F.col("digest").isNull()).select("page_id", "record_id", F.concat("header", end).alias("record")))


def read_pages(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) and url, all read out of the records.

    A response's payload is its block, Content-Length bytes after the empty line; a revisit's is that of the record that
    WARC-Refers-To names. Digests are checked against the payloads' bytes; a record that disagrees or refers to nothing
    ends the job.
    """
    text = F.decode("record", "ISO-8859-1")
    cut = read_records(archive).withColumn("end", F.locate(CRLF * 2, text)).withColumn("lines", F.split(F.substring(text, F.lit(1), F.col("end") - 1), CRLF))
    # only CR LF ends a header line, whatever else a url may hold; a field is read from the line that begins with its name
    field = lambda k: F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{k}: ")), lambda x: F.substr(x, F.lit(len(k) + 3))), F.lit(0))
    block = F.substring(F.col("record"), F.col("end") + 4, field("Content-Length").cast("int"))
    plain = F.decode(F.encode(field("WARC-Target-URI"), "ISO-8859-1"), "UTF-8")
    parsed = cut.select(
        "page_id", field("WARC-Type").alias("record_type"), F.trim(F.translate(field("WARC-Record-ID"), "<>", "")).alias("its_id"), F.translate(field("WARC-Refers-To"), "<>", "").alias("refers"),
        F.coalesce(F.decode(F.unbase64(field("X-Target-URI-Base64")), "UTF-8"), plain).alias("url"), F.octet_length(block).cast("long").alias("payload_bytes"), F.sha1(block).alias("payload_digest"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("said"),
    )
    parsed = materialise(parsed, "warc-records")
    whole = parsed.filter("refers IS NULL")
    of = whole.filter(F.col("payload_bytes") >= REVISIT_BYTES).select(F.col("its_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    again = parsed.filter("refers IS NOT NULL").join(of, "refers", "left").withColumns({"payload_bytes": F.col("n"), "payload_digest": F.col("d")})
    out = whole.withColumn("refers_to", F.lit(None).cast(of.schema["refers_to"].dataType)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "said")
    out = out.unionByName(again.select(*out.columns))
    checked = F.when(F.col("said").eqNullSafe(F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's digest is not its payload's")))
    return out.withColumn("payload_digest", checked).drop("said")
