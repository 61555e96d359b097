"""Every registered training-data query over its whole table: SQL where there is some, else its contract's rows."""

import hashlib
import os

import pytest

import oracle_compare as oc
import __spark_entry__ as entry
from samplecraft.llm import queries as L
from test_decontaminate import brute as brute_hits
from test_html_crf import article
from test_jaccard import brute as brute_links
from test_packing import expected
from test_quality import brute as brute_quality
from test_simhash import brute as brute_simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(L.ORACLES))
def test_sql(spark, name):
    msg, ok = oc.compare(spark, name, L.QUERIES[name], L.ORACLES[name], SF, oc.duck(SF))
    assert ok, msg


def test_op1(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(L.tokenizer_path())
    got = L.op1_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(
        (d, *e) for d, t in docs for e in expected(tok, t, 2048))
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) + 1


def test_op2(spark, docs):
    got = {r.doc_id: r.asDict() for r in L.op2_repetition_coverage(spark, SF).collect()}
    for d, t in docs:
        want = brute_quality(t)
        assert {k: got[d][k] for k in want} == want


def test_op3(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in L.op3_decontamination(spark, SF).collect())
    assert got == sorted(x[:-1] for x in brute_hits(docs, items))


def test_op4(spark, docs):
    text = dict(docs)
    rows = L.op4_chunk_dedup(spark, SF).collect()
    # a run may go on from another source after its first chunk, which can be short
    assert rows and all(text[r.doc_id][r.start] == text[r.first_doc_id][r.first_start] for r in rows)
    assert all((r.first_doc_id, r.first_start) < (r.doc_id, r.start) and r.length >= 40 for r in rows)


def test_op5(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in L.op5_html_crf(spark, SF).collect():
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op7(spark, docs):
    text = dict(docs)
    for r in L.op7_secret_forest(spark, SF).collect():
        found = text[r.doc_id][r.start:r.start + r.length]
        assert hashlib.sha256(found.encode()).hexdigest() == r.secret_sha256
        assert not r.finding or not found.isdigit()


def test_op8(spark, docs):
    assert sorted((tuple(r) for r in L.op8_parity_sketch_join(spark, SF).collect()), key=str) == brute_links(docs)


def test_op11(spark, docs):
    assert sorted((tuple(r) for r in L.op11_simhash_tiles(spark, SF).collect()), key=str) == brute_simhash(docs)
