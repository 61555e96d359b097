import random
import re

import pytest
from pyspark.sql import functions as F

from samplecraft.llm import linespread as L


def brute(rows, min_sites=10, share=0.5):
    occ = {}
    for _, site, t in rows:
        if t is None:
            continue
        a = t.split("\n")
        for i, x in enumerate(a):
            if re.search(r"[^\x20\x09-\x0D]", x):
                occ.setdefault(x, []).append((site, (a[i - 1] if i else "", a[i + 1] if i + 1 < len(a) else ""), (t, i)))
    bad = {x for x, o in occ.items()
           if len({s for s, _, _ in o if s is not None}) >= min_sites and len({c for _, c, _ in o}) >= min_sites
           and len({c for _, c, _ in o}) >= share * len({p for _, _, p in o})}
    return [(d, s, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)) for d, s, t in rows], bad


def data():
    r = random.Random(2)
    boiler = [f"notice {k} é" for k in range(25)]
    rows = []
    for k in range(600):
        body = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 6))]
        for j, b in enumerate(boiler):
            if r.random() < 0.02 * (j % 13):
                body.insert(r.randrange(len(body) + 1), b)
        if r.random() < 0.1:
            body = ["copied one", "copied two", "copied three"]
        rows.append((k, f"s{r.randrange(14)}" if r.random() < 0.97 else None, "\n".join(body)))
    return rows + [(700, "s1", None), (701, None, ""), (702, "s2", "\n \n\n"), (None, "s3", boiler[12]), rows[5], rows[5]]


@pytest.mark.parametrize("max_in_row", [L.MAX_IN_ROW, 0])
def test_equals_exact_counts(spark, max_in_row):
    rows = data()
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, source string, text string, h1 int").repartition(3)
    out = L.remove_boilerplate(df, max_in_row=max_in_row)
    assert out.columns == df.columns
    want, bad = brute(rows)
    assert 3 < len(bad) < 25 and "copied one" not in bad
    assert sorted((str(r.doc_id), str(r.source), str(r.text)) for r in out.collect()) == sorted(
        tuple(map(str, x)) for x in want)


def test_near_threshold_lines_are_counted(spark):
    rows = [(k, f"s{k % 10}", f"nine\nb{k}") for k in range(90) if k % 10] + [(k, f"s{k % 10}", f"ten\nc{k}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.text.split("\n")[0] for r in L.remove_boilerplate(df).filter(F.col("text").contains("\n")).collect()}
    assert got == {"nine"}


def test_long_lines_and_empty(spark):
    df = spark.createDataFrame([(1, "s", "x" * 300_000 + "\n" * 5000)], "doc_id long, source string, text string")
    assert L.remove_boilerplate(df).first().text == "x" * 300_000 + "\n" * 5000
    assert L.remove_boilerplate(df.limit(0)).count() == 0


def test_query_with_a_column_named_removed(spark, tmp_path):
    from samplecraft.llm import queries as Q
    spark.createDataFrame([(1, "s", "a\nb", 5)], "doc_id long, source string, text string, removed int").write.parquet(
        str(tmp_path / "documents.parquet"))
    r = Q.op9_distinct_site_spread(spark, str(tmp_path)).first()
    assert (r.doc_id, r.n_lines, r.n_removed) == (1, 2, 0)


@pytest.mark.parametrize("max_in_row", [L.MAX_IN_ROW, 0])
def test_copies_do_not_dilute(spark, max_in_row):
    """A line in 1,000 texts goes from all of them, though one has 2,000 copies; a text with many near copies stays whole."""
    own = [(k, f"s{k % 20}", f"a{k} b\nshared line\nc{k} d") for k in range(1000)]
    copies = [(1000 + k, f"s{k % 20}", own[7][2]) for k in range(2000)]
    near = [(3000 + k, f"s{k % 20}", "\n".join(f"story {j}" if j != k % 40 else f"edit {k}" for j in range(40))) for k in range(400)]
    docs = spark.createDataFrame(own + copies + near, "doc_id long, source string, text string").repartition(4)
    got = {r.doc_id: r.text for r in L.remove_boilerplate(docs, max_in_row=max_in_row).collect()}
    assert len(got) == 3400 and all(got[d] == t.replace("\nshared line", "") for d, _, t in own + copies)
    assert all(got[d] == t for d, _, t in near)
