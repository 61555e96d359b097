import hashlib
import random
import time

import pytest

from samplecraft.llm import warc
from samplecraft.session import scratch_path

random.seed(4)
LONG = "".join(random.choice("aé日\r\n<x>𝄞") for _ in range(3000))
PAYLOADS = [None, "", "short", "short", "x" * 200, "x" * 200, "a\r\n\r\nWARC/1.1\r\nb" * 20, "a\r\n\r\n" * 30, LONG, LONG,
            LONG + "\r\n\r\nWARC/1.1\r\n" + LONG, "\r\n\r\n" + "y" * 150 + "\r", "z" * 99, "z" * 99, "\n" * 120,
            "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + LONG]


@pytest.mark.parametrize("chunk,files,gz", [(64, 7, "gzip"), (1 << 16, 20_000, "gzip"), (1000, 1, "none")])
def test_round_trip(spark, chunk, files, gz):
    rows = [(i, None if i == 3 else f"http://h/é{i}\r\nX: y" if i == 4 else f"http://h/{i}", p, "c")
            for i, p in enumerate(PAYLOADS)] + [(None, "u", "x" * 200, "c"), (8, "again", LONG, "c"), (None, "n", "q" * 300, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.chunk_table(warc.plan_records(df), chunk), path, files, gz)
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.read_payloads(spark, path).collect()), key=str)
    want = []
    for i, _, p, _ in rows:
        b = (p or "").encode()
        same = [j for j, _, q, _ in rows if (q or "") == (p or "") and j is not None]
        first = min(same) if same and len(b) >= 100 and sum((q or "") == (p or "") for _, _, q, _ in rows) > 1 else None
        rev = first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first if rev else None))
    assert got == sorted(want, key=str)


def test_bodies_come_back(spark):
    df = spark.createDataFrame([(1, "u", PAYLOADS[10])], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.chunk_table(warc.plan_records(df), 500), path)
    rows = warc.read_records(spark, path).orderBy("segment").collect()
    import base64
    assert len(rows) > 3 and rows[0].type == "response" and {r.type for r in rows[1:]} == {"continuation"}
    assert base64.b64decode(b"".join(bytes(r.block) for r in rows)).decode() == PAYLOADS[10]


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.chunk_table(warc.plan_records(df)), path)
    assert warc.read_payloads(spark, path).count() == 0


@pytest.mark.parametrize("gz", ["none", "gzip"])
@pytest.mark.parametrize("kind", ["revisit", "empty", "line ends"])
def test_no_record_is_lost_at_a_buffer_end(spark, kind, gz):
    """The reader's buffer of 64 KB ends at each byte of the run between two records, one file per place."""
    def text(body, n, size):
        return (f"WARC/1.1\r\nWARC-Type: {'revisit' if kind == 'revisit' else 'response'}\r\nWARC-Record-ID: <urn:page:{n}:0>\r\n"
                f"Content-Length: {size}\r\n\r\n{body}\r\n\r\n")

    body = {"revisit": "", "empty": "", "line ends": "a\r\n\r\n"}[kind]
    second, last = text(body, 2, len(body)), text("b", 3, 1)
    path = scratch_path(spark, "warc-test")
    pad = [65536 - len(text("", 1, 60000)) - len(second) + k for k in range(-4, 32)]
    files = [text("z" * p, 1, p) + second + last for p in pad]
    assert all(len(f) - len(last) - 16 <= 65536 + 32 for f in files)
    spark.createDataFrame([(f[:-4],) for f in files], "value string").repartition(len(files)).write.option(
        "lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path, compression=gz)
    got = sorted(r.record for r in warc.read_records(spark, path).select("record").collect())
    assert got == sorted(["1:0", "2:0", "3:0"] * len(files))


def test_url_that_ends_in_the_version_mark(spark):
    rows = [(1, "http://h/WARC/1.1", "a" * 120), (2, "WARC/1.1\r\n", "a" * 120), (3, "x\nWARC/1.1\r\n", "b"), (4, "u", "c\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.chunk_table(warc.plan_records(df)), path)
    got = {r.id: (r.url, r.record_type, r.payload_bytes) for r in warc.read_payloads(spark, path).collect()}
    assert got == {1: ("http://h/WARC/1.1", "response", 120), 2: ("WARC/1.1%0D%0A", "revisit", 120),
                   3: ("x%0AWARC/1.1%0D%0A", "response", 1), 4: ("u", "response", 3)}


@pytest.mark.parametrize("size,error", [(3, "goes on after its block"), (30, "is cut short")])
def test_wrong_length_is_an_error(spark, size, error):
    path = scratch_path(spark, "warc-test")
    one = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nContent-Length: {size}\r\n\r\nabcde"
    spark.createDataFrame([(one,)], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match=error):
        warc.read_records(spark, path).collect()


@pytest.mark.parametrize("unit", ["<p>aé𝄞 bcdefghij</p>\r\n", "<p>aé WARC/1.1 bcd</p>\r\n"])
def test_payload_of_tens_of_megabytes(spark, tmp_path, unit):
    body = unit * (24_000_000 // len(unit)) + "end"
    spark.createDataFrame([(1, "u", body), (2, "v", body), (3, "w", "x")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "in"))
    path = scratch_path(spark, "warc-test")
    start = time.monotonic()
    records = warc.plan_records(spark.read.parquet(str(tmp_path / "in")))
    chunks = warc.chunk_table(records)
    warc.write_archive(chunks, path)
    got = {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_payloads(spark, path).collect()}
    raw = body.encode()
    digest = hashlib.sha256(raw).hexdigest()
    assert got == {1: (len(raw), digest, "response", None), 2: (len(raw), digest, "revisit", 1),
                   3: (1, hashlib.sha256(b"x").hexdigest(), "response", None)}
    assert time.monotonic() - start < 60
    assert chunks.filter("id = 1").count() > 300
