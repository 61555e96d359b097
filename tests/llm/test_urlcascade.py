import pytest
from pyspark.sql import functions as F

from samplecraft.llm import urlcascade as U


@pytest.mark.parametrize("listed_mod,n", [(3, 3000), (50, 3000), (1, 40), (10**9, 40)])
def test_cascade_is_exact_over_its_universe(spark, listed_mod, n):
    u = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % listed_mod == 1 % listed_mod).alias("listed"))
    levels = U.build_cascade(u)
    wrong = u.withColumn("got", U.in_cascade(F.col("key"), levels)).filter("got != listed").count()
    assert wrong == 0
    if listed_mod == 50:
        assert len(levels) > 1  # false positives happened and were encoded


CASES = [  # url, host, path, rule, verdict without a list
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.net/en/", "", "", None, "allow"),
    ("http://a.NET", "a.net", "", None, "allow"),
    ("http://a.NET/", "a.net", "/", "net/", "block"),
    ("http://net/x", "net", "/x", "net/", "block"),
    ("http://xnet/x", "xnet", "/x", None, "allow"),
    ("https://m.Example.net/en/1?q=/a#b", "m.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("https://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
    ("https://b.example.com/de/#x", "b.example.com", "/de/", "example.com/de/", "block"),
    ("x://É.org/fr/a://b", "É.org", "/fr/a://b", "org/fr/", "allow"),
    ("://org?x", "org", "", None, "allow"),
    ("http://org/fr/" + "y" * 50000, "org", "/fr/" + "y" * 50000, "org/fr/", "allow"),
]


@pytest.mark.parametrize("max_bytes", [U.MAX_LEVEL_BYTES, 0])
def test_judge(spark, max_bytes):
    rows = [(i, c[0], "clash", c[0] is not None and "bad" in c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[3], (None, "q://h/p", "clash", None)], "page_id long, url string, rule string, _uc boolean")
    out = U.judge(df, F.col("_uc"), max_level_bytes=max_bytes).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        if r.page_id is not None:
            u, h, p, rule, verdict = CASES[r.page_id]
            assert (r.host, r.path, r.rule) == (h, p, rule)
            assert r.verdict == ("block" if u and "bad" in u else verdict)
    assert U.judge(df.limit(0), F.col("_uc")).count() == 0


@pytest.mark.parametrize("listed,unlisted", [(93_000_000, 10**10), (90_000_000, 10**12), (1000, 0), (0, 5), (10**6, 10**6), (5000, 100)])
def test_size_guard_holds_for_every_level(listed, unlisted):
    largest = U.largest_level(listed, unlisted)
    sides, fp, side = {True: listed, False: unlisted}, U.first_rate(listed, unlisted), True
    for _ in range(20):
        assert U._size(sides[side], fp)[0] // 8 <= largest
        sides[not side] = round(sides[not side] * fp)
        side, fp = not side, U.LATER_FP
