import hashlib
import itertools
import random
import re
import zlib

import pytest

from samplecraft.llm import repair as R


def damaged(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    out = {}
    for c, t, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        here = out.setdefault(c, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(t, role, text)] * (2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(rows, bad):
    """(cost, audit, repaired rows) of all cheapest edits of short conversations, by trying everything."""
    found = []
    form = re.compile(r"(s?(ua)+)?")
    parts = []
    for (_, role, text), fault in zip(rows, bad):
        cut = fault == "truncated"
        ops = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            ops += [(cut, "K", [(role, text)]), *[(2 + cut, "R", [(r, text)]) for r in ("user", "assistant")]]
        parts.append(ops)
    slots = [[]] + [[x] for x in ("user", "assistant")] + [[x, y] for x in ("user", "assistant") for y in ("user", "assistant")]
    for choice in itertools.product(*parts):
        base = sum(c for c, _, _ in choice)
        for ins in itertools.product(slots, repeat=len(rows) + 1):
            cost = base + 2 * sum(map(len, ins))
            if found and cost > found[0][0]:
                continue
            audit, out = "", []
            for k, extra in enumerate(ins):
                audit += "I" * len(extra)
                out += [(r, "") for r in extra]
                if k < len(choice):
                    audit += choice[k][1]
                    out += choice[k][2]
            if form.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)):
                if found and (cost, audit) < found[0][:2]:
                    found = []
                if not found or (cost, audit) == found[0][:2]:
                    found.append((cost, audit, out))
    return found


def dynamic(rows, bad):
    """The same by keeping, per automaton state, the least (cost, audit) with its rows."""
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        todo = list(states.items())
        while todo:
            q, (c, a, out) = todo.pop()
            for role in ("user", "assistant"):
                to = nxt.get((q, role[0]))
                new = (c + 2, a + "I", out + [(role, "")])
                if to is not None and (to not in states or new[:2] < states[to][:2]):
                    states[to] = new
                    todo.append((to, new))
        return states
    states = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, bad):
        after = {}

        def offer(q, new):
            if q is not None and (q not in after or new[:2] < after[q][:2]):
                after[q] = new
        cut = fault == "truncated"
        for q, (c, a, out) in states.items():
            offer(q, (c + 3, a + "D", out))
            if fault not in ("blank", "duplicate"):
                offer(nxt.get((q, role[:1])), (c + cut, a + "K", out + [(role, text)]))
                for r in ("user", "assistant"):
                    offer(nxt.get((q, r[0])), (c + 2 + cut, a + "R", out + [(r, text)]))
        states = inserted(after)
    return min(states[q] for q in (0, 3) if q in states)


def expected(conv, rows):
    bad = faults(rows)
    cost, audit, out = dynamic(rows, bad)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[bad.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def brute(rows):
    return sorted((expected(c, x) for c, x in damaged(rows).items()), key=str)


COLUMNS = "conv_id long, turn long, role string, text string, fault string, edits int"


def conversations(seed=4, n=250):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            role = ("system" if not t and r.random() < 0.3 else ["user", "assistant"][t % 2]) if r.random() < 0.85 else \
                r.choice(["user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "no", "É!", "a b\n", "  ", "", None, f"text {r.randrange(9)}? \n"])
            rows.append((c, t * r.choice([1, 1, 1, 2]) if r.random() < 0.95 else None, role, text, "x", 1))
    return rows + [(None, 1, "user", "a.", "x", 1), (None, 2, "assistant", "b.", "x", 1), (n, None, None, None, "x", 1)]


def result(df):
    return sorted((tuple(r) for r in R.repair(R.damage(df)).collect()), key=str)


def test_equals_brute_force(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    got = result(spark.createDataFrame(rows, COLUMNS).repartition(4))
    assert got == brute(rows)
    assert {"D", "I", "K", "R"} <= {x for r in got for x in r[7]} and any(r[1] > 0 for r in got)


def test_the_model_is_the_exhaustive_one():
    r = random.Random(8)
    for _ in range(150):
        rows = [(t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", "c."])) for t in range(r.randrange(0, 4))]
        bad = faults(rows)
        all_best = edits(rows, bad)
        assert len({tuple(x[2]) for x in all_best}) == 1
        assert dynamic(rows, bad) == all_best[0]


def test_conversations_that_lose_all_rows(spark):
    lost = [k for k in range(3000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:5]
    df = spark.createDataFrame([(k, 0, "user", "x", "", 1) for k in lost], COLUMNS)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(df) == sorted([(k, 0, 0, 0, 0, 0, 0, "", empty) for k in lost], key=str)


def test_giant_conversation_across_batches(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "tool"]), r.choice(["a.", f"t{t}", f"t{t}.", "x" * 50]), "", 1) for t in range(35_000)]
    rows += [(8, t, "user", "same.", "", 1) for t in range(12_000)]
    got = result(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert [g[1:7] for g in got] == [b[1:7] for b in brute_streamed(rows)]
    assert [g[7:] for g in got] == [b[7:] for b in brute_streamed(rows)]


def brute_streamed(rows):
    """As ``brute``, with the rows of long conversations linked instead of copied."""
    out = []
    for conv, here in damaged(rows).items():
        bad = faults(here)
        nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        put = {0: 2, 1: 2, 2: 3, 3: 2}
        n = len(here)
        cost = [[0] * 4 for _ in range(n + 1)]
        cost[n] = [0, 4, 2, 0]

        def options(i, q):
            _, role, _ = here[i]
            cut = bad[i] == "truncated"
            for pre, q1, c1 in (("", q, 0), ("I", put[q], 2)):
                yield c1 + 3 + cost[i + 1][q1], pre + "D", q1
                if bad[i] not in ("blank", "duplicate"):
                    to = nxt.get((q1, role[:1]))
                    if to is not None:
                        yield c1 + cut + cost[i + 1][to], pre + "K", to
                    yield c1 + 2 + cut + cost[i + 1][put[q1]], pre + "R", put[q1]
        for i in range(n - 1, -1, -1):
            cost[i] = [min(options(i, q))[0] for q in range(4)]
        q, audit, text = 0, [], []
        names = {2: "user", 3: "assistant"}
        for i in range(n):
            _, seg, to = min(options(i, q))
            audit.append(seg)
            if seg[0] == "I":
                text.append(names[put[q]] + ":")
            if seg[-1] != "D":
                text.append((here[i][1] if seg[-1] == "K" else names[to]) + ":" + here[i][2])
            q = to
        while q in (1, 2):
            q = put[q]
            audit.append("I")
            text.append(names[q] + ":")
        short = expected(conv, here[:1])
        turns = {t for t, _, _ in here}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(here, here[1:])]
        out.append((short[0], max(turns) - min(turns) + 1 - len(turns), *[bad.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost[0][0], "".join(audit),
                    hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_long_text_and_undamaged_input(spark):
    rows = [(1, 0, "user", "x" * 300_000 + ".\n", "", 1), (1, 1, "assistant", "yes", "", 1)]
    got = R.repair(spark.createDataFrame(rows, COLUMNS)).first()
    assert (got.audit, got.cost, got.truncated) == ("KK", 1, 1)
    want = "user:" + "x" * 300_000 + ".\n" + "\nassistant:yes"
    assert got.repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    assert result(spark.createDataFrame(rows, COLUMNS)) == []
