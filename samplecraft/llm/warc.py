"""WARC archives as a chunked record table.

A payload is rows of (record, chunk number, text); one of more than
``CHUNK_CHARS`` characters is several rows, so the steps after the cut never
need a whole record in one buffer.  Each chunk is one WARC/1.1 record: the
first a ``response``, the others ``continuation`` records with a segment
number, as the standard has it for long payloads.  A payload that is archived
already is a ``revisit`` without a body.

Archives are text files, written and read by Spark's own text source with the
record separator as line separator, so they can lie in any store that Spark
reaches and need no local file.  A payload that has the format's version mark
in it is stored in base64, so the separator is never part of a record.  The
reader's separator is the version line with the one line feed before it: no
part of it before its end repeats its start, so a reader whose buffer ends
inside a run of line ends still finds it, and a header line that ends in the
version mark (a url can) is not taken for it.
Digests of one-chunk payloads are computed per row; longer ones are fed chunk
by chunk, in order, to an incremental SHA-256 that keeps only its state.

Nulls: a null payload is empty; a null url has no target line; a null id is
read back as null, and is never the one that others refer to while another row
has the payload.  Rows that repeat an id are separate records.  An empty table
gives an empty archive.
"""

from __future__ import annotations

import binascii
import hashlib

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

CHUNK_CHARS = 1 << 16
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
DATE = "2026-01-01T00:00:00Z"
#: fixed values of the format
_END = "\r\n\r\n"
_VERSION = "WARC/1.1\r\n"
_MARK = "WARC/1."
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, refers_to): ``refers_to`` is set for revisits."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = (rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)))
    shared = (rows.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest")
              .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return (rows.join(shared, "payload_digest", "left")
            .withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")),
                                            F.col("first"))).drop("first"))


def _urn(name: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), name, F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def chunk_table(records: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The chunked record table: one row per record and chunk number."""
    coded = F.col("payload").contains(_MARK)
    body = F.when(F.col("refers_to").isNotNull(), "").when(coded, F.base64(F.col("payload").cast("binary")))
    rows = (records.withColumn("coded", coded & F.col("refers_to").isNull())
            .withColumn("body", body.otherwise(F.col("payload"))).drop("payload")
            .withColumn("row", F.hex(F.monotonically_increasing_id())))
    # one pass over the text cuts it; from here on a row holds a chunk, never the whole body
    parts = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    whole = F.octet_length("body") <= chunk_chars
    rows = rows.withColumn("parts", F.when(whole, F.array("body")).otherwise(parts)).drop("body")
    rows = rows.withColumn("chunks", F.size("parts"))
    keep = [c for c in rows.columns if c != "parts"]
    return rows.select(*keep, F.posexplode("parts").alias("chunk", "body")).withColumn("chunk", F.col("chunk") + 1)


def write_archive(chunks: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE,
                  compression: str = "gzip") -> None:
    """One WARC record per chunk row, in files of at most ``records_per_file`` records."""
    name = F.concat(F.coalesce(F.url_encode(F.col("id").cast("string")), F.lit("")), F.lit(":"), F.col("row"))
    first, many = F.col("chunk") == 1, F.col("chunks") > 1
    revisit = F.col("refers_to").isNotNull()
    http = F.when(first & ~revisit, _HTTP).otherwise("")
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(http, F.col("body"))
    record = F.concat(
        F.lit(_VERSION), _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(F.when(first, name).otherwise(F.concat(name, F.lit(":"), F.col("chunk"))))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        _line("WARC-Payload-Length", F.when(first, F.col("payload_bytes").cast("string"))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", _urn(F.url_encode(F.col("refers_to").cast("string")))),
        _line("WARC-Segment-Number", F.when(many, F.col("chunk").cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(many & ~first, _urn(name))),
        _line("WARC-Block-Encoding", F.when(F.col("coded"), "base64")),
        _line("Content-Type", F.when(first & ~revisit, "application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    (chunks.select(record.alias("value")).write.option("lineSep", _END)
     .option("maxRecordsPerFile", records_per_file).text(path, compression=compression))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: header fields and the block as bytes."""
    raw = spark.read.option("lineSep", "\n" + _VERSION).text(path)
    at = F.instr("value", _END)
    head = F.concat(F.lit("\r\n"), F.substr("value", F.lit(1), at - 1), F.lit("\r\n"))
    rows = raw.select("value", head.alias("head"))

    def field(name: str, pattern: str = "([^\r]*)") -> Column:
        got = F.regexp_extract("head", f"\r\n{name}: {pattern}\r\n", 1)
        return F.when(got != "", got)

    size = field("Content-Length").cast("int")
    # ``head`` has one line end before it that the value lacks, and half of the blank line
    at_block = F.octet_length("head") - 2 + 3
    block = F.substring(F.col("value").cast("binary"), at_block, size)
    # what is left of the blank lines between records, if the block is as long as stated
    rest = F.decode(F.substr(F.col("value").cast("binary"), at_block + size), "ISO-8859-1")
    rows = rows.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID", "<urn:page:([^\r>]*)>").alias("record"),
        field("WARC-Target-URI").alias("url"), field("WARC-Refers-To", "<urn:page:([^\r>]*)>").alias("refers_to"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]*)").alias("stated_digest"),
        field("WARC-Payload-Length").cast("long").alias("stated_bytes"),
        field("WARC-Segment-Number").cast("int").alias("segment"),
        field("WARC-Segment-Origin-ID", "<urn:page:([^\r>]*)>").alias("origin"),
        field("WARC-Block-Encoding").alias("encoding"), size.alias("size"), block.alias("block"),
        (F.translate(rest, "\r\n", "") == "").alias("ends"))
    wrong = F.raise_error(F.concat(
        F.when(F.col("ends") == False, "WARC record goes on after its block: ").otherwise("WARC record is cut short: "),  # noqa: E712
        F.coalesce("record", F.lit("?"))))
    whole = (F.octet_length("block") == F.col("size")) & F.col("ends")
    rows = rows.withColumn("block", F.when(whole, F.col("block")).otherwise(wrong)).drop("ends")
    http = F.col("type") == "response"
    # the HTTP head ends at its first blank line
    skip = F.instr(F.decode(F.substring("block", 1, 4096), "ISO-8859-1"), _END) + 4
    payload = F.when(http, F.substr("block", skip, F.col("size"))).otherwise(F.col("block"))
    return rows.withColumn("block", payload)


def _digest_chunks(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """(origin, bytes, digest) of payloads in several chunks; rows stream in chunk order."""
    ship_package(spark)
    ordered = chunks.repartition("origin").sortWithinPartitions("origin", "segment")

    def run(batches):
        now, sha, size, spare = None, None, 0, b""

        def done():
            return pa.RecordBatch.from_pydict({"origin": [now], "bytes": [size], "digest": [sha.hexdigest()]})

        for b in batches:
            for origin, coded, block in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if origin != now:
                    if now is not None:
                        yield done()
                    now, sha, size, spare = origin, hashlib.sha256(), 0, b""
                if coded:  # whole groups of four base64 characters
                    block = spare + block.replace(b"\r\n", b"")
                    cut = len(block) // 4 * 4
                    spare, block = block[cut:], binascii.a2b_base64(block[:cut])
                sha.update(block)
                size += len(block)
        if now is not None:
            yield done()

    return (ordered.select("origin", "segment", "encoding", "block")
            .mapInArrow(run, "origin string, bytes long, digest string"))


def read_payloads(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest) per page, digests of what was read.

    A digest that differs from the one in the header is an error.
    """
    rows = read_records(spark, path)
    heads = rows.filter("type <> 'continuation'")
    ident = F.url_decode(F.substring_index("record", ":", 1))
    out = heads.select(
        F.when(ident != "", ident).cast(id_type).alias("id"), "url", F.col("type").alias("record_type"),
        F.url_decode("refers_to").cast(id_type).alias("refers_to"), "record", "segment", "stated_digest", "stated_bytes",
        F.when(F.col("encoding") == "base64", F.unbase64(F.decode("block", "US-ASCII"))).otherwise(F.col("block"))
        .alias("block"))
    long = _digest_chunks(spark, rows.filter("segment is not null").withColumn("origin", F.coalesce("origin", "record")))
    single = out.filter("segment is null").select(
        "id", "url", "record_type", "refers_to", "stated_digest", "stated_bytes",
        F.when(F.col("record_type") == "revisit", F.col("stated_bytes"))
        .otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("stated_digest"))
        .otherwise(F.sha2("block", 256)).alias("payload_digest"))
    many = (out.filter("segment is not null").drop("block").join(long, F.col("origin") == F.col("record"))
            .select("id", "url", "record_type", "refers_to", "stated_digest", "stated_bytes",
                    F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")))
    every = single.unionByName(many)
    wrong = F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("stated_digest")))
    same = (F.col("payload_digest") == F.col("stated_digest")) & (F.col("payload_bytes") == F.col("stated_bytes"))
    return every.select("id", "url", "record_type", "refers_to", "payload_bytes",
                        F.when(same, F.col("payload_digest")).otherwise(wrong).alias("payload_digest"))
