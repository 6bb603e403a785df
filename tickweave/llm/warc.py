"""Content-addressed WARC archive (operator 7).

Payload bytes are stored once, under their SHA-256, which is verified when
they are read; exact record headers are stored apart.  The payload table is
bucketed by digest, so that rebuilding records by joining headers to payloads
moves headers only.  The newest capture of a payload is a response record,
older ones are revisit records that refer to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import cut, scratch_path

# Fixed values of the WARC and base32 formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four symbols."""
    digest = F.sha1(data)
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_from_bytes: int = 0, buckets: int | None = None) -> None:
    """Write the tables <path>/payloads (sha256, data; in so many buckets) and <path>/headers (page_id, header, sha256).

    Null payloads are empty.  Of records with equal payloads of at least
    revisit_from_bytes bytes, the one with the largest id is the response, the
    others revisit it; smaller payloads are all responses.  Rows that repeat
    an id and payload are each written, as responses if their id is the
    largest.  Null urls give no target header; CR and LF in a url become
    blanks.  An empty table gives empty archives.
    """
    data = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("data")).withColumn("sha256", F.sha2("data", 256))
    spark, n = pages.sparkSession, buckets or n_buckets(pages.sparkSession)
    name = f"warc_{uuid.uuid4().hex}"
    once = rows.select("sha256", "data").repartition(n, "sha256").dropDuplicates(["sha256"])
    once.write.format("parquet").bucketBy(n, "sha256").sortBy("sha256").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    facts = rows.select("page_id", "url", "sha256", base32_sha1(F.col("data")).alias("digest"), F.octet_length("data").cast("long").alias("size"))
    newest = facts.groupBy("sha256").agg(F.max("page_id").alias("newest"))
    revisit = (F.col("size") >= revisit_from_bytes) & (F.col("page_id") < F.col("newest"))
    head_of_response = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")
    http = F.concat(head_of_response, F.col("size").cast("string"), F.lit(CRLF * 2))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.translate("url", CRLF, "  ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("newest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)
    facts.join(newest, "sha256").select("page_id", header.alias("header"), "sha256").write.parquet(f"{path}/headers")


def n_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_payloads(spark: SparkSession, path: str, buckets: int | None = None) -> DataFrame:
    """sha256, data; an error if bytes don't match their address.  With the number of buckets joins on sha256 need no shuffle of payloads."""
    if buckets is None:
        stored = spark.read.parquet(f"{path}/payloads")
    else:
        # the catalog knows the buckets; what it gave stays usable without the entry, and the files are not its own
        name, place = f"warc_{uuid.uuid4().hex}", f"{path}/payloads".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (sha256 STRING, data BINARY) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{place}'")
        stored = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    good = F.sha2("data", 256) == F.col("sha256")
    return stored.select("sha256", F.when(good, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("sha256"))).cast("binary")).alias("data"))


def _field(name: str, header: str = "header") -> Column:
    return F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)


def _page(reference: Column) -> Column:
    """The id in <urn:page:id>, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(reference, r"^<urn:page:(-?\d+)>$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload_digest, refers_to, url as read from the stored headers, and sha256."""
    return spark.read.parquet(f"{path}/headers").select(
        "page_id",
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        _page(_field("WARC-Refers-To")).alias("refers_to"),
        F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        "sha256",
    )


def read_records(spark: SparkSession, path: str, buckets: int | None = None) -> DataFrame:
    """page_id, sha256, record: every record's exact bytes, rebuilt by joining headers to payloads; revisits hold none."""
    headers = spark.read.parquet(f"{path}/headers")
    revisit, end = _field("WARC-Type") == "revisit", F.lit((CRLF * 2).encode())
    whole = headers.filter(~revisit).join(read_payloads(spark, path, buckets), "sha256").select("page_id", "sha256", F.concat(F.encode("header", "utf-8"), F.col("data"), end).alias("record"))
    return whole.unionByName(headers.filter(revisit).select("page_id", "sha256", F.concat(F.encode("header", "utf-8"), end).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, sha256, record_type, payload_digest, refers_to, n_bytes, own_digest: what a record's bytes alone tell.

    n_bytes and own_digest are those of the payload that the record holds; a
    record whose Content-Length differs from its block is an error.
    """
    text = F.decode("record", "ISO-8859-1")  # a character for each byte
    ends = records.select("page_id", "sha256", "record", F.instr(text, CRLF * 2).alias("head"), text.alias("text"))
    ends = ends.select("page_id", "sha256", "record", "head", F.substr("text", F.lit(1), F.col("head") + 1).alias("header"), F.expr("locate('\\r\\n\\r\\n', text, head + 4)").alias("http"))
    block = F.octet_length("record") - F.col("head") - 3 - 4
    payload = F.expr("substring(record, http + 4, octet_length(record) - http - 7)")
    digest = F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    sound = _field("Content-Length").cast("long") == block
    return ends.select(
        "page_id", "sha256", F.when(sound, _field("WARC-Type")).otherwise(F.raise_error(F.lit("record length differs from its header")).cast("string")).alias("record_type"),
        digest.alias("payload_digest"), _page(_field("WARC-Refers-To")).alias("refers_to"), F.octet_length(payload).cast("long").alias("n_bytes"), base32_sha1(payload).alias("own_digest"),
    )


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archive (to a new folder in the shared one unless given), rebuild every record and describe it.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  A response
    is described by the payload in its own rebuilt record, which must have the
    digest that the header states; a revisit by its header and the payload of
    the record that it refers to.
    """
    spark = pages.sparkSession
    path, buckets = path or scratch_path(spark, "warc"), n_buckets(pages.sparkSession)
    write_archive(pages, path, id_col, url_col, payload_col, revisit_from_bytes=revisit_from_bytes, buckets=buckets)
    # a few columns of each record: written once, so that payloads are read once
    parsed = cut(parse_records(read_records(spark, path, buckets)))
    agreed = F.when(F.col("payload_digest") == F.col("own_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload digests differ")).cast("string"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = parsed.filter("record_type = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), agreed.alias("payload_digest"), "record_type", "refers_to")
    known = parsed.filter("record_type = 'response'").groupBy("sha256").agg(F.max("n_bytes").alias("payload_bytes"), F.max("own_digest").alias("own_digest"))
    revisits = parsed.filter("record_type = 'revisit'").drop("own_digest").join(known, "sha256").withColumn("payload_digest", agreed)
    return responses.select(*out).unionByName(revisits.select(*out))
