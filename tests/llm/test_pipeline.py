import os

import pytest

import corpus_pipeline as P
from test_decontaminate import brute as brute_hits
from test_jaccard import brute as brute_links
from test_linespread import brute as brute_lines
from test_packing import expected
from test_quality import brute as brute_quality
from samplecraft.llm import quality as Q
from samplecraft.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def kept(text):
    m = brute_quality(text)
    if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
        return False
    return not (m["dup_line_chars"] > Q.DUP_LINE_CHAR_LIMIT * m["word_chars"] or m["n_symbols"] > Q.SYMBOLS_PER_WORD * m["n_words"]
                or any(m[f"dup_{n}gram_chars"] > x * m["word_chars"] for n, x in Q.NGRAM_LIMITS.items()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [x for x in rows if kept(x[2])]
    steps = [want, brute_lines(want)[0]]
    comp = {d: c for d, _, c in brute_links([(d, t) for d, _, t in steps[1]])}
    steps.append([x for x in steps[1] if comp[x[0]] == x[0]])
    bad = {h[0] for h in brute_hits([(d, t) for d, _, t in steps[2]], items) if h[5]}
    steps.append([x for x in steps[2] if x[0] not in bad])
    assert len(rows) > len(steps[0]) > len(steps[2]) > len(steps[3]) > 0
    for (name, stage), expect in zip(P.STAGES[:4], steps):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id, r.source, r.text) for r in docs.collect()) == sorted(expect), name
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = sorted((d, *e) for d, _, t in steps[3] for e in expected(tok, t, 2048))
    got = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
