"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins.

An archive has two Parquet folders. `payloads` holds each distinct payload once, under the SHA-256 of its bytes. `headers`
holds, for each record, the exact bytes before its payload (WARC/1.1 header lines, an empty line), in UTF-8. A record is
header + payload + two line ends; revisit records carry no payload of their own and refer to the record that does. Reading
recomputes every stored payload's digest and length and fails on one that is not what its name says.

Defined results: null html is an empty payload; payloads shorter than MIN_REVISIT bytes are always responses (but are
stored once too); rows repeated with one page_id are records each, all responses if theirs is the smallest id of the
payload; a null page_id ranks after all others, and its revisits refer to the smallest id; line ends of any kind in a url
(also those of Unicode) are stored as blanks, so that no url adds a header line; an empty table gives an empty archive;
columns other than page_id, url and html are not archived.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
END = "\r\n"
#: Everything that some reader takes for the end of a line.
LINE_END = r"[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def header_of(date: str) -> F.Column:
    """The record's header lines, from page_id, url, record_type, payload_digest, payload_bytes and refers_to."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), LINE_END, " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat(F.array_join(F.array(*lines), END), F.lit(END + END))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest of every page, payload included."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))


def write_archive(pages: DataFrame, path: str, date: datetime | None = None) -> None:
    """Write path/headers and path/payloads. date: when the pages were fetched (now), for WARC-Date."""
    stamp = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    page = records(pages)
    light = page.drop("html")
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    typed = light.join(first, "payload_digest").withColumn(
        "record_type", F.when((F.col("payload_bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first_id")), "revisit").otherwise("response")
    )
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
    typed.select("page_id", "payload_digest", header_of(stamp).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # One row for each payload: the first id's, and one if that row is repeated. A hot payload's digest is no join key by
    # itself: its copies have ids of their own, so they are dealt over all tasks.
    holder = first.select("payload_digest", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("holder"))
    own = page.select("payload_digest", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("holder"), F.col("html").cast("binary").alias("payload"))
    own.join(holder, ["payload_digest", "holder"], "left_semi").dropDuplicates(["payload_digest", "holder"]).select("payload_digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers with their fields parsed from the header's text."""
    headers = spark.read.schema("page_id long, payload_digest string, header string").parquet(f"{path}/headers").withColumnRenamed("payload_digest", "stored_under")
    line = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return headers.select(
        "stored_under", "header",
        F.regexp_extract(line("WARC-Record-ID"), "<urn:page:(.*)>", 1).try_cast("long").alias("page_id"),
        line("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_extract(line("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        line("WARC-Type").alias("record_type"),
        F.regexp_extract(line("WARC-Refers-To"), "<urn:page:(.*)>", 1).try_cast("long").alias("refers_to"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads with the length found; a payload whose digest is not its name raises an error."""
    stored = spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads")
    is_it = F.sha2("payload", 256) == F.col("payload_digest")
    checked = F.when(is_it, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_digest"))).cast("long"))
    return stored.select(F.col("payload_digest").alias("stored_under"), "payload", checked.alias("found_bytes"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as read back and checked."""
    both = read_headers(spark, path).join(read_payloads(spark, path).drop("payload"), "stored_under", "left")
    good = F.col("payload_bytes").eqNullSafe(F.col("found_bytes")) & (F.col("payload_digest") == F.col("stored_under"))
    length = F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), F.col("header"))).cast("long"))
    return both.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and record: the exact bytes of every WARC record; payload: what the page holds, for revisits too."""
    both = read_headers(spark, path).join(read_payloads(spark, path), "stored_under")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", F.concat(F.col("header").cast("binary"), body, F.lit((END + END).encode())).alias("record"), "payload")
