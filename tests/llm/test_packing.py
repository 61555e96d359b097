import zlib

import numpy as np
import pytest

from samplecraft.llm import packing
from samplecraft.llm.queries import tokenizer_path

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


TEXTS = [None, "", "  \n\t ", "Hello world, don't stop.", "a<|endoftext|>b <|startoftext|>", "é ü ΑΣ Σ. x\u0085y 42 1/2",
         "word " * 3000, "z" * 5000, "Same text here.", "Same text here.", "'s 'll we've é́ n̈"]


def expected(tok, text, cap):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
    for p in range(0, len(ids), cap):
        part = np.array(ids[p:p + cap], "<u4")
        yield p // cap, p, len(part), zlib.crc32(part.tobytes())


@pytest.mark.parametrize("cap", [2048, 64])
def test_pieces_and_layout(spark, tok, cap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack_documents(df, tokenizer_path(), capacity=cap, keep_ids=True).collect()
    want = sorted(((d, *e) for d, t, _ in rows for e in expected(tok, t, cap)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for members in seqs.values():
        at = 0
        for off, n in sorted(members):
            assert off == at
            at += n
        assert at <= cap
    total = sum(n for m in seqs.values() for _, n in m)
    assert len(seqs) <= -(-total // cap) + 1


def test_capitals_composed_in_lower_case_only(tok):
    """The normaliser composes before it lower-cases: J, H, T, W, Y and their accents have no composed capital."""
    import pyarrow as pa
    texts = [c + m + "x" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in map(chr, range(0x300, 0x370))]
    texts += ["J\u030cx", "H\u0331x", "T\u0308x", "W\u030ax", "Y\u030ax", "A J\u030c.H\u0331 B", "AJ,\u0331X", None, "", "Plain.Ab É"]
    ids, off = packing.WordTokenizer(tokenizer_path()).encode_column(pa.array(texts), 0)
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0], t


def test_sequences_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    s = packing.sequences(packing.pack_documents(df, tokenizer_path(), keep_ids=True)).collect()
    assert len(s) == 1 and len(s[0].ids) == 7 and sorted(s[0].doc_ids) == [1, 2]
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def brute(lengths, cap):
    """The same rule, one bin at a time, on a plain list."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        members = [left.pop(0)]
        gap = cap - members[0]
        while fit := next((x for x in left if x <= gap), None):
            left.remove(fit)
            members.append(fit)
            gap -= fit
        while gap and len(members) > 1:
            small = min(members)
            members.remove(small)
            pool = sorted([*left, small], reverse=True)
            pairs = [(a + b, a) for i, a in enumerate(pool) for b in pool[i + 1:] if small < a + b <= gap + small]
            if not pairs:
                members.append(small)
                break
            total, a = max(pairs)
            left = pool
            left.remove(a)
            left.remove(total - a)
            members += [a, total - a]
            gap += small - total
        bins.append(sorted(members, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_one_bin_at_a_time(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(20, 60))
    lengths = rng.integers(1, cap + 1, int(rng.integers(1, 120))).tolist()
    hist = {x: lengths.count(x) for x in set(lengths)}
    got = [m for m, times in packing.plan_bins(hist, cap) for _ in range(times)]
    assert sorted(got) == sorted(brute(lengths, cap))


def test_known_words_are_kept_in_arrays(monkeypatch, tok):
    """The cache outlives its stage in the Python worker: it must not hold an object per word, nor trust a hash."""
    import sys
    import pyarrow as pa
    monkeypatch.setattr(packing.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 3)  # nearly all hashes are equal
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    t = packing.WordTokenizer(tokenizer_path())
    for k in range(8):
        texts = [" ".join(f"w{(7 * i + k) % 90}x{i % 4}" for i in range(50)), None, "Same text here.", TEXTS[3]]
        ids, off = t.encode_column(pa.array(texts), 0)
        for j, x in enumerate(texts):
            assert ids[off[j]:off[j + 1]].tolist() == tok.encode(x or "", add_special_tokens=False).ids + [0]
    assert len(t.words) == len(t.lens) == len(t.slots) >= 50
    assert all(sys.getsizeof(v) < 10_000 for v in vars(t).values() if isinstance(v, (dict, list, set)))
    assert not any(isinstance(v, (dict, set)) and len(v) >= 50 for v in vars(t).values())


def test_tokenizing_job_has_small_arrow_batches(spark, monkeypatch):
    """The job that writes the pieces is the one that runs the tokenizer: its batches are bounded in bytes."""
    from samplecraft.llm import components
    monkeypatch.setattr(components, "ARROW_BYTES", 4096)
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(400)], "doc_id long, text string").coalesce(1)

    def batch_rows(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.num_rows] * b.num_rows, pa.int64())], names=["doc_id", "length"])

    got = packing.pack(docs.mapInArrow(batch_rows, "doc_id long, length long"), 2048).select("doc_id", "length").collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert max(r.length for r in got) < 100


def test_arrays_of_a_slice_are_small(tok):
    import tracemalloc
    import pyarrow as pa
    from samplecraft.llm.text import sub_batches
    t = packing.WordTokenizer(tokenizer_path())
    batch = pa.RecordBatch.from_pydict({"text": ["some words, of a text; " * 100] * 2000})
    tracemalloc.start()
    try:
        for b in sub_batches(batch, "text", packing.TEXT_BYTES):
            t.encode_column(b.column(0), 0)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
