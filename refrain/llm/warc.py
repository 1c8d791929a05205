"""A content-addressed WARC archive: payload bytes are stored once by verified strong digest, exact record headers apart from
them, and the original records are put together again by joins.

An archive is a folder with two Parquet tables. `payloads` (digest, payload): one row for each different payload;
digest is its SHA-256. `headers` (header, digest): the headers of every record, byte for byte, and its payload's
address: the WARC header from the version line to the empty line, then the HTTP header, with which the record's block
begins. Whenever an archive is read, each payload's SHA-256 is computed again and compared with its address, and
its SHA-1 and size with those in the headers.
"""

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

CRLF = "\r\n"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Control characters and line ends of any kind: in a header they stand percent-encoded.
_CONTROL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"
_LEAST = -(1 << 63)


def base32_sha1(data: Column) -> Column:
    """Base 32 of the SHA-1: eight groups of five hexadecimal digits become four characters each."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _BASE32HEX, _BASE32)


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(html, 256).alias("digest"), html.alias("payload"))


def _one_line(c: Column) -> Column:
    encoded = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(_CONTROL), F.url_encode(x)).otherwise(x))
    return F.when(c.rlike(_CONTROL), F.array_join(encoded, "")).otherwise(c)


def records(pages: DataFrame, min_payload: int = 0, date: str | None = None) -> DataFrame:
    """(page_id, header, digest, original) of each row of pages(page_id, url, html): a response, or a revisit of the record
    with the largest page_id among those of the same payload. Payloads shorter than min_payload are always responses.

    A null html is an empty payload, a null url an empty target; control characters and line ends in a url are
    percent-encoded. Rows with a null page_id are responses under a random record id. Of rows that repeat page_id
    and payload all are responses if their page_id is the largest, with one record id. date is that of all records
    (default: now). Other columns are ignored; an empty table gives no rows. The payloads themselves are not shuffled here.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    base = _digested(pages).select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    base = stored(base, "digests")
    met = base.join(base.groupBy("digest").agg(F.max("page_id").alias("original")), "digest")
    revisit = F.coalesce((F.col("page_id") != F.col("original")) & (F.col("size") >= min_payload), F.lit(False))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.col("size").cast("string")
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", length), F.lit(CRLF))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(uri(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("original"))), line("WARC-Profile", F.lit(profile)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("X-Payload-Length", length),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    return met.select("page_id", F.encode(header, "UTF-8").alias("header"), "digest", "original")


def write(pages: DataFrame, path: str, min_payload: int = 0, date: str | None = None) -> None:
    """Stores the records of pages under path. Each different payload is written once, from the page with the largest
    page_id. Payloads are shuffled once, by digest and page_id, so the copies of one payload are dealt over all tasks;
    rows that repeat both are reduced where they lie."""
    recs = stored(records(pages, min_payload, date), "records")
    recs.select("header", "digest").write.parquet(f"{path}/headers")
    key = lambda c: F.coalesce(c, F.lit(_LEAST)).alias("page")
    first = recs.groupBy("digest").agg(F.max("original").alias("original")).select("digest", key("original"))
    each = _digested(pages).select("digest", key("page_id"), F.encode("payload", "UTF-8").alias("payload")).dropDuplicates(["digest", "page"])
    each.join(first, ["digest", "page"], "left_semi").select("digest", "payload").write.parquet(f"{path}/payloads")


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of an archive: the fields of each exact WARC header, and each payload's own digests and size,
    computed from its bytes. A payload that doesn't have the address it is stored under raises an error."""
    heads = spark.read.parquet(f"{path}/headers")
    warc = F.concat(F.substring_index(F.decode("header", "UTF-8"), CRLF + CRLF, 1), F.lit(CRLF))
    # a field begins after a line end of the format and ends at the next, whatever else its value holds
    field = lambda name, value: F.nullif(F.regexp_extract(warc, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    page = "<urn:page:(-?[0-9]+)>"
    heads = heads.select("header", "digest", field("WARC-Record-ID", page).cast("long").alias("page_id"), field("WARC-Type", "([a-z]+)").alias("record_type"), field("WARC-Refers-To", page).cast("long").alias("refers_to"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"), field("X-Payload-Length", "([0-9]+)").cast("long").alias("payload_bytes"))
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    return heads, stored.select(checked.alias("digest"), "payload", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))


def reconstruct(spark, path: str) -> DataFrame:
    """(page_id, record, payload): the original bytes of every record, with its headers, and its full payload, that of the
    record it refers to in case of a revisit."""
    heads, payloads = read(spark, path)
    met = heads.join(payloads, "digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return met.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def index(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the stored headers and the stored bytes say;
    a header that contradicts its payload raises an error."""
    heads, payloads = read(spark, path)
    met = heads.join(payloads.select("digest", "sha1", "size"), "digest", "left")
    same = (F.col("sha1") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes"))
    digest = F.when(same, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("digest"))))
    return met.select("page_id", F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def export(spark, path: str, to: str) -> None:
    """Standard .warc text: each record's headers, the rest of its block, and two line ends."""
    heads, payloads = read(spark, path)
    block = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    lines = heads.join(payloads, "digest").select(F.concat(F.decode("header", "UTF-8"), block).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).text(to)
