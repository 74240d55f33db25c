"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; exact record headers are stored apart, a row per record. Archives are Parquet tables in the shared
folder, so Spark's committer writes them and a lost executor costs a retry:

- `headers`: record id, page id, the header block of the record byte for byte, payload digest and length, record type;
- `payloads`: digest, length, bytes; one row for each distinct payload, in buckets by digest, so that records are put together without moving payloads.

`records` joins the two by digest and gives back the records as they stand in a WARC/1.1 file: header block, empty line, payload (none for a
revisit), two line ends. `read_index` takes everything from these bytes: it parses the header block, computes the digest of the body anew, compares
both, and follows a revisit to its response by record id.

Of records with equal payloads of `least_bytes` or more the one with the smallest id is the response, the others revisit it; of several rows with that id
one is. Shorter payloads are all responses, each record with its own bytes when read, though these are stored once too.

Record ids are random UUIDs, drawn once and written with the rows before anything refers to them. The date is the archive's, one for all records.

Skew: owners come from a minimum that is aggregated before the shuffle; records meet their owner, short payloads theirs, and revisits their response in joins
whose hot keys Spark splits. A longer payload has one response, so there no key is hot.

Defined results: a null payload is empty; null URLs give no target line; rows of equal ids stay; a null id is larger than all others; other columns are left
out; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LEAST_BYTES = 100
CRLF = "\r\n"
HEADERS = "record_id string, page_id long, headers string, payload_digest string, payload_bytes long, record_type string"
PAYLOADS = "payload_digest string, payload_bytes long, payload binary"


def _header(date: str) -> Column:
    """The header block of a row with the columns of HEADERS, url and the id of the record it refers to."""
    revisit = F.col("record_type") == "revisit"

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<"), F.col("owner.record_id"), F.lit(">")))),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(date))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat_ws(CRLF, *lines)  # lines that are null are left out


def _table(path: str) -> str:
    return f"payloads_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, date: datetime | None = None, buckets: int | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive. date: of the capture, now if not given; buckets: of the payloads, as many as the session's shuffles have partitions."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # copies meet before the shuffle, so bytes travel once and a payload that many pages share is no hot key
    once = p.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload").alias("payload"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(n, "payload_digest").option("path", f"{path}/payloads").option("compression", "zstd").saveAsTable(_table(path))

    slim = stored(p.select(F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"), "page_id", "url", "payload_digest", "payload_bytes"), "records")
    first = F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record_id"))).alias("owner")
    owners = slim.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(first).select(F.col("payload_digest").alias("d"), "owner")
    mine = slim.join(owners, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("owner").isNotNull() & (F.col("record_id") != F.col("owner.record_id"))
    mine = mine.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    now = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    mine.withColumn("headers", _header(now)).select(*[x.split()[0] for x in HEADERS.split(", ")]).write.option("compression", "zstd").parquet(f"{path}/headers")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADERS).parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; a session that didn't write them reads the same files without their buckets."""
    name = _table(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records byte for byte: record_id, page_id, record (binary, null if its payload is missing)."""
    p = payloads(spark, path).select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "payload")
    h, same = headers(spark, path), F.col("payload_digest") == F.col("d")
    long = F.col("payload_bytes") >= least_bytes
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")

    def built(rows: DataFrame, body: Column) -> DataFrame:
        return rows.select("record_id", "page_id", F.concat(F.encode("headers", "UTF-8"), end, body, end).alias("record"))

    response = h.filter(F.col("record_type") == "response")
    # headers are dealt out as the payloads lie: a hash table of a bucket's headers, and the payloads stream by
    own = p.filter(F.col("b") >= least_bytes).join(response.filter(long).hint("shuffle_hash"), same, "right")
    short = response.filter(~long).hint("merge").join(p.filter(F.col("b") < least_bytes), same, "left")
    return built(own, F.col("payload")).unionByName(built(short, F.col("payload"))).unionByName(built(h.filter(F.col("record_type") == "revisit"), F.lit(b"")))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def parsed(records: DataFrame) -> DataFrame:
    """(page_id, record_id, record_type, refers_to_record, payload_digest, body_digest, body_bytes, length) of records, from their bytes alone."""
    head = F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1)
    rows = records.withColumn("head", head).withColumn("n", F.octet_length("head"))
    body = F.expr("substring(record, n + 5, octet_length(record) - n - 8)")
    bare = lambda c: F.regexp_replace(c, "[<>]", "")
    return rows.select(
        "page_id", bare(_field("WARC-Record-ID")).alias("record_id"), _field("WARC-Type").alias("record_type"), bare(_field("WARC-Refers-To")).alias("refers_to_record"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), F.sha2(body, 256).alias("body_digest"), F.octet_length(body).cast("long").alias("body_bytes"),
        _field("Content-Length").cast("long").alias("length"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record with what its bytes say; fails on a record whose payload is missing or isn't that of its digest and length."""
    found = stored(parsed(records(spark, path)), "index")
    whole = F.coalesce((F.col("body_digest") == F.col("payload_digest")) & (F.col("body_bytes") == F.col("length")), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("payload is missing or broken: record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    response = found.filter("record_type is null or record_type = 'response'").select("record_id", "page_id", F.when(whole, F.col("body_bytes")).otherwise(broken.cast("long")).alias("payload_bytes"), F.col("body_digest").alias("payload_digest"))
    target = response.select(F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("found_digest"))
    revisit = found.filter("record_type = 'revisit'").select("page_id", "refers_to_record", "payload_digest").join(target, F.col("refers_to_record") == F.col("r"), "left")
    sound = F.when(F.col("found_digest").eqNullSafe(F.col("payload_digest")), F.col("payload_digest")).otherwise(broken.cast("string"))
    revisit = revisit.select("page_id", "payload_bytes", sound.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return response.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisit)
