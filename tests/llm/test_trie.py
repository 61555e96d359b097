import hashlib
import random
import zlib

import pytest

from samplecraft.llm import trie as T


def brute(rows):
    """One node per distinct prefix, by walking a dictionary of prefixes."""
    convs = {}
    for c, turn, role, text, *_ in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = convs.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append((c, d == len(rebuilt)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = (sum(x for x, _ in below) if below else 1, saved + sum(y for _, y in below))
    return sorted((min(members[p])[0], len(p), min(members[p[:-1]])[0] if p else None, len(members[p]), len(kids.get(p, [])),
                   *sums[p], hashlib.sha256(",".join(str(c) for c, e in sorted(members[p]) if e).encode()).hexdigest())
                  for p in members)


COLUMNS = "conv_id long, turn long, role string, text string, owner string, depth int"


def conversations(seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 3 * n), n) + [5_000_000_123, 777_777_777]:
        for t in range(r.randrange(1, 9)):
            text = r.choice(["a", "b", "é", "the same opening", "", f"own {c} {t}"]) if r.random() < 0.9 else None
            rows.append((c, t if r.random() < 0.97 or t else None, r.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "nobody's"), (901, 0, "user", "x")]
    rows = [x for x in rows if x[0] is None or x[0] // 100 != 3 or x[0] % 100]  # a base that is absent
    return [(*x, "clash", 1) for x in rows]


def result(df):
    return sorted(tuple(r) for r in T.prefix_trie(df).collect())


def test_equals_brute_force(spark):
    rows = conversations()
    rows = list({(x[0], x[1]): x for x in rows}.values())
    random.Random(2).shuffle(rows)
    got = result(spark.createDataFrame(rows, COLUMNS).repartition(4))
    assert got == brute(rows)
    assert any(r[3] > 5 and r[1] > 2 for r in got) and any(r[6] > 100 for r in got)


def test_giant_conversation_spans_tasks(spark, monkeypatch):
    carried, multiply = [], T._multiply

    def counted(x, y):  # the driver's own products: one pair a task that goes on with a conversation
        carried.append(1)
        return multiply(x, y)
    # the base itself is giant, and a copy of it under another id shares all of its path
    rows = [(c, t, "user", f"turn {t % 50}", "", 1) for c in (100, 200, 107) for t in range(25_000)]
    rows += [(300 + k, 0, "user", "hot", "", 1) for k in range(2000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(T, "_multiply", counted)
    own = T.own_prefixes(T.with_fingerprints(T.turns_of(df), 0))
    assert own.filter("conv_id = 107 and pos = 25000").first().cum == sum(len(f"turn {t % 50}") for t in range(25_000))
    assert len(carried) >= 6
    got = {(r.conv_id, r.depth): r for r in T.prefix_trie(df).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    top = got[100, 0]
    assert top.n_convs == 2003 and top.parent_conv_id is None and got[100, 25_000].n_convs == 3
    assert got[100, 25_000].ends_sha256 == hashlib.sha256(b"100,107,200").hexdigest()
    assert got[100, 1].saved_tokens == 2 * sum(len(f"turn {t % 50}") for t in range(25_000))


def test_copies_and_tied_rows(spark):
    rows = [(c, t, "user", f"t{t}", "", 1) for c in (100, 1100, 2100) for t in (0, 0, 1, 1, 2)]
    got = result(spark.createDataFrame(rows, COLUMNS))
    assert [(r[1], r[3]) for r in got] == [(d, 3) for d in range(6)]


def test_collisions_are_found_and_reseeded(spark, monkeypatch):
    rows = [x for x in conversations(3, 60)]
    rows = list({(x[0], x[1]): x for x in rows}.values())
    whole, seeds = T.with_fingerprints, []

    def weak(turns, seed):
        seeds.append(seed)
        good = whole(turns, seed)
        if seed == 0:  # different texts of one length collide
            return good.withColumn("t1", T._element(T.F.char_length("text").cast("long"))).withColumn("t2", T.F.col("t1"))
        return good
    monkeypatch.setattr(T, "with_fingerprints", weak)
    assert result(spark.createDataFrame(rows, COLUMNS)) == brute(rows) and seeds == [0, 1]


def test_inverse_and_product(spark):
    df = spark.range(50).select(T._element(T.F.xxhash64("id")).alias("x"), T._element(T.F.xxhash64("id", "id")).alias("y"))
    got = df.select(T._compose(T._compose(df.x, df.y), T._inverse(df.y)).alias("z"), "x").collect()
    assert all(r.z == r.x for r in got)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x", "", 1)]])
def test_empty(spark, rows):
    assert result(spark.createDataFrame(rows, COLUMNS)) == []


def test_null_roles_texts_and_turns(spark):
    rows = [(100, None, None, None, "", 1), (100, 3, "user", "", "", 1), (101, None, "", "", "", 1), (200, 1, "", None, "", 1)]
    assert result(spark.createDataFrame(rows, COLUMNS)) == brute(rows)
