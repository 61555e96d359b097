import random

import numpy as np
import pyarrow as pa
import pytest

from samplecraft.llm import cdc
from samplecraft.llm.text import byte_view


def brute_chunks(text):
    """One byte at a time."""
    data = (text or "").encode()
    h, cuts, last = 0, [], None
    for i, b in enumerate(data):
        h = ((h << 1) + int(cdc._GEAR[b])) & 0xFFFFFFFF
        if (h >> (cdc.WINDOW - cdc.CUT_BITS)) % (1 << cdc.CUT_BITS) == 0 and (i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80):
            if last is None or i + 1 - last >= cdc.MIN_BYTES:
                cuts.append(i + 1)
            last = i + 1
    out, at = [], 0
    for e in sorted({*cuts, len(data)} if data else set()):
        while e - at > cdc.MAX_BYTES:
            x = at + cdc.MAX_BYTES
            while data[x] & 0xC0 == 0x80:
                x -= 1
            out.append(data[at:x])
            at = x
        out.append(data[at:e])
        at = e
    return [x.decode() for x in out]


def brute_spans(rows):
    seen, first, out = set(), {}, []
    chunks = []
    for d, t in rows:
        if (d, t) in seen:
            continue
        seen.add((d, t))
        at = 0
        for c in brute_chunks(t):
            chunks.append((d, t, at, c))
            at += len(c)
    for d, _, at, c in chunks:
        first[c] = min(first.get(c, (d, at)), (d, at))
    run = None
    for d, t, at, c in chunks + [(None, None, -1, "")]:
        copy = c in first and first[c] != (d, at)
        if run and copy and run[0] == d and run[1] == t and run[2] + run[3] == at:
            run[3] += len(c)
            continue
        if run and run[3] >= cdc.MIN_SPAN:
            out.append((run[0], run[2], run[3], *run[4]))
        run = [d, t, at, len(c), first[c]] if copy else None
    return sorted(out)


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本", "x."]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [text(60) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "a" * 3000), (3, "b" + "a" * 3000), (4, "日" * 1000)]
    for k in range(5, 120):
        t = text(r.randrange(0, 150))
        if r.random() < 0.6:
            t += " " + r.choice(passages) + " " + text(r.randrange(0, 60))
        rows.append((k, t))
    return rows + [(200, rows[20][1]), (201, rows[20][1]), (30, rows[30][1]), (30, rows[31][1] + " " + passages[0])], passages


def test_chunks_equal_byte_by_byte():
    texts = [t for _, t in corpus()[0]]
    data, off = byte_view(pa.array(texts, pa.large_string()))
    doc, ends = cdc.chunk_ends(data, off)
    begin = np.concatenate([[0], ends[:-1]])
    got = [[] for _ in texts]
    for d, a, b in zip(doc, begin, ends):
        got[d].append(bytes(data[a:b]).decode())
    assert got == [brute_chunks(t) for t in texts]


def test_insertion_changes_few_chunks():
    t = " ".join(f"word{i * 7919 % 1000}" for i in range(600))
    a, b = brute_chunks(t), brute_chunks("inserted " + t[:1500] + " more " + t[1500:])
    assert len(set(a) - set(b)) <= 6 < len(a) // 4


def test_spans_equal_brute_force(spark):
    rows, passages = corpus()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length int").repartition(4)
    got = sorted(tuple(r) for r in cdc.repeated_spans(df).drop("t").collect())
    assert got == brute_spans(rows)
    caught = {g[0] for g in got}
    for p in passages:
        ids = sorted(d for d, t in rows if t and p in t)
        assert set(ids[1:]) <= caught


def test_removal(spark):
    rows, _ = corpus()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, _cd_t int")
    out = cdc.remove_repeated(df)
    assert out.columns == df.columns
    spans = {}
    for d, s, n, *_ in brute_spans(rows):
        spans.setdefault(d, []).append((s, n))
    for r in out.collect():
        src = [t for d, t in rows if d == r.doc_id]
        if len(src) == 1:
            t = src[0]
            for s, n in sorted(spans.get(r.doc_id, []), reverse=True):
                t = t[:s] + t[s + n:]
            assert r.text == t
    assert out.count() == len(rows) and cdc.repeated_spans(df.limit(0)).count() == 0


def test_a_passage_of_fifty_words_is_caught():
    """Its whole chunks, wherever it stands, cover MIN_SPAN characters of it, but for few in a thousand."""
    r = random.Random(12)
    missed = 0
    for _ in range(1000):
        text = lambda n: " ".join("".join(r.choice("aeiounrstlé") for _ in range(r.randint(1, 9))) for _ in range(n))
        passage = text(51)
        a, b = (brute_chunks(f"{text(20)} {passage} {text(20)}") for _ in range(2))
        run = best = 0
        for c in b:
            run = run + len(c) if c in a and c in passage else 0
            best = max(best, run)
        missed += best < cdc.MIN_SPAN
    assert missed <= 30


@pytest.mark.parametrize("n", [1, 15, 16, 17, 31, 32, 33, 100])
def test_gear_hash_starts_anew_in_each_text(n):
    data = np.frombuffer(b"x" * 50 + bytes(range(n)), np.uint8)
    alone = cdc.gear_hash(data[50:], np.array([0, n]))
    assert (cdc.gear_hash(data, np.array([0, 50, 50 + n]))[50:] == alone).all()
