import random
import re

import numpy as np
import pytest
import xxhash

from samplecraft.llm import simhash as S


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(rows, radius=3):
    """(doc_id, fingerprint, component_id) per row by comparing all pairs; rows of one id are one node."""
    fps = [brute_fp(t) for _, t in rows]
    name = {d: d for d, _ in rows if d is not None}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x
    for i, (d, _) in enumerate(rows):
        for j in range(i):
            if d is not None and rows[j][0] is not None and (fps[i] ^ fps[j]).bit_count() <= radius:
                x, y = sorted((find(d), find(rows[j][0])))
                name[y] = x
    return sorted(((d, format(f, "016x"), None if d is None else find(d)) for (d, _), f in zip(rows, fps)), key=str)


def corpus():
    r = random.Random(5)

    def text(n):
        return " ".join(f"{r.choice(['Word', 'ÄÖ', 'x'])}{r.randrange(400)}" for _ in range(n))
    rows = []
    for k in range(60):
        t = text(r.randrange(1, 200))
        rows.append((1000 - k, t))
        for c in range(r.randrange(3)):
            w = t.split(" ")
            w[r.randrange(len(w))] = f"other{c}"
            rows.append((2000 + 10 * k + c, "\n  ".join(w)))
    rows += [(5, None), (6, ""), (7, " \t"), (8, "One"), (9, "one\ttwo"), (None, "One"), (None, None), rows[3], rows[3]]
    rows += [(rows[0][0], rows[40][1]), (11, "x" * 200_000), (12, "a b c " * 50_000)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, fp int, id string").repartition(5)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_hash_in_parts_is_the_same(monkeypatch):
    import pyarrow as pa
    texts = [t for _, t in corpus()[:150]]
    monkeypatch.setattr(S, "_CHUNK", 64)
    assert S.fingerprint_column(pa.array(texts)).tolist() == [brute_fp(t) for t in texts]


def parts(links, nodes):
    name = {x: x for x in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        name[y] = x
    return sorted(find(x) for x in nodes)


@pytest.mark.parametrize("blocks", [1, 2, 4])
@pytest.mark.parametrize("tile", [7, 4096])
def test_no_link_is_lost_whatever_the_tiles(spark, blocks, tile):
    r = random.Random(blocks)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            f = base
            for _ in range(r.randrange(1, 6)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
            if r.random() < 0.5:
                base = f
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(x.a, x.b) for x in S.similar_links(df, len(fps), tile=tile, blocks=blocks).collect()]
    m = (1 << 64) - 1
    want = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & m).bit_count() <= 3]
    assert len(want) > 100 and len(links) < len(want)
    assert parts(links, fps) == parts(want, fps)


def test_a_dense_family_gives_a_tree():
    rng = np.random.default_rng(3)
    fam = np.unique(np.bitwise_xor(np.uint64(123), (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
                                   | (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))))
    u, v = S.compare_tiles(fam, None)
    assert len(u) == len(fam) - 1 and np.bincount(np.searchsorted(fam, u)).max() <= S.FANOUT


def test_steps_are_half_the_ball():
    assert [len(S.class_steps(b, 3)) for b in (1, 2, 4)] == [4, 13, 65]
    assert S.blocks_for(10) == 1 and S.blocks_for(200_000) == 2 and S.blocks_for(10**9) == 4


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
