import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from samplecraft.functions.draws import order_hash
from samplecraft.operators import sampling as S
from samplecraft.util import row_hash


def frame(spark, n=1000, parts=4):
    return spark.range(n).repartition(parts).select(F.col("id"), (F.col("id") % 7).alias("v"))


def test_random_sample_independent_of_partitioning(spark):
    results = [[r.id for r in S.random_sample(frame(spark, parts=p), 10, 7, "id").collect()] for p in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 10
    assert S.random_sample(frame(spark, 5), 10, 7, "id").count() == 5  # fewer rows than asked


def test_shuffle_batches_is_a_seeded_permutation(spark):
    outs = []
    for p in (1, 3, 8):
        b = S.shuffle_batches(frame(spark, 1000, p), 64, seed=1, epoch=2, key="id")
        outs.append(sorted((r.id, r.row_idx, r.batch_id) for r in b.collect()))
    assert outs[0] == outs[1] == outs[2]
    rows = outs[0]
    assert sorted(r[1] for r in rows) == list(range(1000))
    assert all(b == i // 64 for _, i, b in rows)
    sizes = {}
    for _, _, b in rows:
        sizes[b] = sizes.get(b, 0) + 1
    assert sizes[max(sizes)] == 1000 - 64 * 15  # last partial batch kept
    other = S.shuffle_batches(frame(spark), 64, seed=1, epoch=3, key="id")
    assert sorted((r.id, r.row_idx) for r in other.collect()) != [(a, b) for a, b, _ in rows]


def test_sequential_batches_and_fetch(spark):
    b = S.sequential_batches(frame(spark, 300, 5), 100, key="id")
    assert all(r.row_idx == r.id and r.batch_id == r.id // 100 for r in b.collect())
    got = sorted(r.id for r in S.fetch_rows(b, [5, 299, 1000]).collect())
    assert got == [5, 299]


def test_dense_index_generic_order(spark):
    df = spark.range(500).repartition(7).select(F.format_string("k%05d", F.col("id") * 7 % 500).alias("s"),
                                                (F.col("id") * 3).alias("n"))
    by_str = S.dense_index(df, [F.col("s")])
    got = sorted((r.row_idx, r.s) for r in by_str.collect())
    assert [s for _, s in got] == sorted(r.s for r in df.collect())
    assert [i for i, _ in got] == list(range(500))
    outlier = df.union(spark.createDataFrame([("zz", 10 ** 15)], "s string, n long"))
    got = sorted((r.row_idx, r.n) for r in S.key_order_index(outlier, "n").collect())
    assert got == [(i, 3 * i) for i in range(500)] + [(500, 10 ** 15)]
    assert S.key_order_index(df, "s").count() == 500


def _ranked(df, order):
    """The reference ranking: one global window."""
    w = Window.orderBy(*order, row_hash(df))
    return sorted((str(tuple(r[:-1])), r[-1]) for r in df.select("*", F.row_number().over(w) - 1).collect())


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("kind", ["nulls", "all_null", "repeated", "nan", "strings"])
def test_index_with_null_and_repeated_keys(spark, kind, parts):
    k = {"nulls": F.when(F.col("id") % 5 > 0, 100 - F.col("id")), "all_null": F.lit(None).cast("long"),
         "repeated": F.col("id") % 4, "strings": F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 9)),
         "nan": F.when(F.col("id") % 6 == 0, F.lit(float("nan"))).when(F.col("id") % 6 > 1, F.col("id") / 3)}[kind]
    df = spark.range(40).select(k.alias("k"), (F.col("id") % 11).alias("__src"), F.lit("x").alias("_tie"),
                                F.lit(1).alias("__p0__x"), F.col("id").alias("_bucket"))
    df = df.union(df.limit(6)).repartition(parts)
    got = S.key_order_index(df, "k")
    assert got.columns == df.columns + ["row_idx"]
    rows = sorted((str(tuple(r[:-1])), r[-1]) for r in got.collect())
    assert [i for _, i in sorted(rows, key=lambda x: x[1])] == list(range(46))
    assert sorted(i for _, i in rows) == sorted(i for _, i in _ranked(df, [F.col("k")]))
    assert rows == _ranked(df, [F.col("k")])
    h = order_hash(9, F.lit(0), "k")
    want = _ranked(df, [h, F.col("k")])
    for hot in (S.HOT_BUCKET_ROWS, 0):
        b = S.shuffle_batches(df, 7, seed=9, key="k", hot_rows=hot)
        assert b.columns == df.columns + ["row_idx", "batch_id"]
        assert sorted((str(tuple(r[:-2])), r[-2]) for r in b.collect()) == want


def test_large_sample_is_cut_from_the_index(spark, monkeypatch):
    df = frame(spark, 200)
    small = {r.id for r in S.random_sample(df, 50, 3, "id").collect()}
    monkeypatch.setattr(S, "TOP_N_ROWS", 10)
    big = S.random_sample(df, 50, 3, "id")
    assert big.columns == df.columns and {r.id for r in big.collect()} == small


def test_shuffle_fallback_equals_bucket_path_and_handles_hot_keys(spark):
    df = frame(spark, 1000, 4)
    fast = sorted((r.id, r.row_idx) for r in S.shuffle_batches(df, 64, seed=3, epoch=1, key="id").collect())
    forced = sorted((r.id, r.row_idx) for r in
                    S.shuffle_batches(df, 64, seed=3, epoch=1, key="id", hot_rows=0).collect())
    assert fast == forced
    # a third of the rows share one key (a group of copies)
    hot = spark.range(900).repartition(5).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
                                                 .alias("k"), (F.col("id") % 2).alias("v"))
    outs = []
    for parts in (1, 6):
        b = S.shuffle_batches(hot.repartition(parts), 50, seed=3, key="k", hot_rows=100)
        rows = b.collect()
        assert sorted(r.row_idx for r in rows) == list(range(900))
        outs.append(sorted((r.k, r.row_idx) for r in rows))
    assert outs[0] == outs[1]
    ks = [k for k, _ in outs[0] if k == -1]
    idx = sorted(i for k, i in outs[0] if k == -1)
    assert len(ks) == 300 and idx == list(range(idx[0], idx[0] + 300))  # copies are contiguous


def test_empty_inputs(spark):
    from samplecraft.operators import classes as C
    from samplecraft.operators import evaluate as E
    df = spark.range(10).where("id < 0").select(F.col("id"), F.lit("x").alias("label"))
    assert S.shuffle_batches(df, 4, key="id").count() == 0
    assert S.sequential_batches(df, 4, key="id").count() == 0
    assert S.key_order_index(df, "id").count() == 0
    d = C.class_dictionary(df)
    assert d.count() == 0
    empty_counts = spark.createDataFrame([], "true_idx int, pred_idx int, n long")
    assert E.confusion_matrix(empty_counts, d).count() == 0


def test_index_shuffles_rows_once_and_checkpoints_keys_only(spark, monkeypatch):
    kept = []
    whole = spark.range(0, 5000, 1, 6).select(F.col("id"), F.repeat(F.lit("wide"), 50).alias("body"))
    cls = type(whole)
    plain = cls.checkpoint

    def noted(self, *a, **k):
        kept.append(self.columns)
        return plain(self, *a, **k)
    monkeypatch.setattr(cls, "checkpoint", noted)
    out = S.key_order_index(whole, "id")
    assert all(r.id == r.row_idx for r in out.collect())
    assert len(kept) == 1 and "body" not in kept[0]
    moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert 1 <= len(moved)
    assert whole._jdf.queryExecution().toString()  # the input itself is untouched


@pytest.mark.parametrize("hot", [100_000, 3])
def test_groups_of_equal_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_EQUAL_ROWS", hot)
    monkeypatch.setattr(S, "_COPIES", 64)
    df = spark.range(900).repartition(5).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("row"),
        F.struct(F.lit(1).alias("a")).alias("n"))
    got = S.key_order_index(df, "k")
    assert got.columns == df.columns + ["row_idx"]
    rows = sorted((r.row_idx, r.k, r.row) for r in got.collect())
    assert [i for i, _, _ in rows] == list(range(900))
    assert all(k is None and x == "same" for _, k, x in rows[:300])
    assert [k for _, k, _ in rows[300:]] == sorted(i % 50 for i in range(900) if i % 3)
    assert len({x for _, _, x in rows[300:]}) == 600


def test_indexed_table_opens_only_the_files_asked_for(spark):
    from samplecraft.session import scratch_path
    idx = S.key_order_index(frame(spark, 1000, 4), "id")
    path = scratch_path(spark, "indexed-test")
    S.write_indexed(idx, path, rows_per_file=100)
    assert spark.read.parquet(S.ranges_path(path)).count() == 10
    got = S.fetch_indexed(spark, path, [5, 7, 950, 5000, -1])
    assert sorted((r.row_idx, r.id) for r in got.collect()) == [(5, 5), (7, 7), (950, 950)]
    assert len(got.inputFiles()) == 2
    few = spark.createDataFrame([(3,), (3,), (412,), (9999,)], "row_idx long")
    got = S.fetch_indexed(spark, path, few)
    assert sorted(r.row_idx for r in got.collect()) == [3, 412] and len(got.inputFiles()) == 2
    assert S.fetch_indexed(spark, path, []).count() == 0 and S.fetch_indexed(spark, path, [4000]).columns == got.columns
    S.write_indexed(idx.limit(0), path)
    assert S.fetch_indexed(spark, path, [1]).count() == 0 and S.fetch_indexed(spark, path, few).count() == 0
