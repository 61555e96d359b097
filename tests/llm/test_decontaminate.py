import hashlib
import random
import re

import pytest

from samplecraft.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        wins += [(tuple(w[a:a + m]), i) for a in range(len(w) - m + 1) if m]
    out = []
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for win, i in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    got.add(str(i))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w), sorted(hit)))
    return out


def data():
    r = random.Random(9)
    vocab = ["a", "B", "cé", "É", "9x", "the", "OF"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", ".\n", "\x7f"]) for _ in range(n))
    items = [(10, text(40)), (2, text(13)), (3, "Short one."), (4, "!!"), (5, None), (6, "x"), (7, text(30)), (7, text(12)),
             (11, text(16))]
    items.append((12, items[0][1]))
    docs = [(0, None), (1, ""), (2, "..."), (3, "shOrt ONE"), (4, " x")]
    for k in range(5, 40):
        t = text(r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            w = r.choice(items)[1] or ""
            cut = r.randrange(0, max(1, len(w) // 2))
            t += " " + w[cut:] + " " + text(r.randrange(0, 30))
        docs.append((k, t))
    docs += [(6, docs[6][1]), (6, "other text, same id"), (None, docs[8][1]), (50, "\n".join([items[0][1]] * 30))]
    return docs, items


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST_KEYS, 0])
def test_hits_equal_brute_force(spark, limit):
    docs, items = data()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.report(D.hits(df, bench, max_broadcast_keys=limit)).drop("text_hash").collect()]
    assert sorted(got, key=str) == sorted((x[:-1] for x in brute(docs, items)), key=str)


def test_modes(spark):
    docs, items = data()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, _dc_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        (str(d), str(t)) for (d, t), x in zip(docs, want) if not x[5])
    cut = D.decontaminate(df, bench, "spans").collect()
    assert len(cut) == len(docs)
    left = sorted((str(r.doc_id), tuple(words(r.text))) for r in cut)
    assert left == sorted((str(d), tuple(w for i, w in enumerate(words(t)) if i not in set(x[6])))
                          for (d, t), x in zip(docs, want))


def test_empty(spark):
    docs, items = data()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.hits(df.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in D.report(D.hits(df, bench.limit(0))).collect())


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, 0, 0, 0), (2, "other text", 0, 0, 0)],
                                 "doc_id long, text string, _h int, _dc_text int, text_hash int")
    bench = spark.createDataFrame([("a", words, 0)], "item_id string, text string, _h int")
    spans = D.decontaminate(docs, bench, mode="spans")
    assert spans.columns == docs.columns and {r.doc_id: r.text.strip() for r in spans.collect()} == {1: "", 2: "other text"}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
