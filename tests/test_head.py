import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samplecraft.operators import head as HD


def _sums(w, b, x, y):
    fn = HD._sums_kernel(w, b)
    rb = pa.RecordBatch.from_arrays([pa.array([list(r) for r in x], pa.list_(pa.float64())), pa.array(y, pa.int32()),
                                     pa.array([False] * len(y))], names=["x", "y", "val"])
    vals = next(fn(iter([rb]))).column(1).flatten().to_numpy()
    return vals[:-6], vals[-6]


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 2))
    y = np.array([0, 1, 2, 1, 0])
    w, b = rng.normal(size=(3, 2)), rng.normal(size=3)
    grad, loss = _sums(w, b, x, y)
    eps = 1e-6
    params = np.concatenate([w.reshape(-1), b])
    for i in range(params.size):
        p = params.copy()
        p[i] += eps
        _, lp = _sums(p[:6].reshape(3, 2), p[6:], x, y)
        p[i] -= 2 * eps
        _, lm = _sums(p[:6].reshape(3, 2), p[6:], x, y)
        assert abs((lp - lm) / (2 * eps) - grad[i]) < 1e-5


def test_fit_head_separable(spark):
    df = spark.range(2000).select(
        F.col("id"), (F.col("id") % 5).cast("int").alias("label_idx"),
        F.array(*[(F.lit(2.0) * (F.col("id") % 5 == j).cast("double")
                   + F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0) for j in range(16)]).alias("features"))
    train, val = df.where(F.col("id") % 4 != 0), df.where(F.col("id") % 4 == 0)
    res = HD.fit_head(train, val, 5, opts=HD.HeadOptions(lr=0.05, epochs=30, steps_per_epoch=2, patience=None))
    hist = res.history.orderBy("epoch").collect()
    assert len(hist) == 30
    assert hist[-1].val_acc > 0.95
    assert hist[-1].val_loss < hist[0].val_loss
    kinds = {r.kind for r in res.head.collect()}
    assert kinds == {"best", "final"}


def test_sums_add_partitions(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(r.tolist(), int(c), False) for r, c in zip(x, y)], "x array<double>, y int, val boolean")
    w, b = rng.normal(size=(2, 3)), rng.normal(size=2)
    grad, loss = _sums(w, b, x, y)
    for parts in (1, 5):
        got = {r.i: r.v for r in HD.sums(df.repartition(parts), w, b).collect()}
        assert np.allclose([got[i] for i in range(8)], grad) and abs(got[8] - loss) < 1e-9 and got[10] == 60


def test_unusable_rows_are_left_out_and_counted(spark):
    rows = [(i, [float(i % 2), 1.0, float(i % 3)], i % 2) for i in range(40)]
    bad = [(100, [1.0], 0), (101, [1.0, 2.0, 3.0, 4.0], 1), (102, None, 1), (103, [1.0, None, 2.0], 0), (104, [1.0, 1.0, 1.0], -1),
           (105, [1.0, 1.0, 1.0], 2), (106, [1.0, 1.0, 1.0], None)]
    schema = "id long, features array<double>, label_idx int"
    good, every = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + bad, schema)
    opts = HD.HeadOptions(epochs=3, lr=0.1, patience=None)
    a = HD.fit_head(good, good, 2, opts=opts)
    b = HD.fit_head(every, every, 2, opts=opts)
    assert (a.skipped_train, a.skipped_val, b.skipped_train, b.skipped_val) == (0, 0, 7, 7)
    assert np.allclose(a.weights, b.weights)
    assert [round(r.val_loss, 9) for r in a.history.orderBy("epoch").collect()] == [
        round(r.val_loss, 9) for r in b.history.orderBy("epoch").collect()]


def test_batch_size_and_initial_weights(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label_idx"),
                                 F.array(F.col("id") % 2 * 1.0, F.lit(1.0)).alias("features"))
    start = (np.ones((2, 2)), np.zeros(2))
    res = HD.fit_head(df, df, 2, opts=HD.HeadOptions(epochs=1, batch_size=100, patience=None), initial=start)
    assert res.run.first().batch_size == 100 and np.array_equal(start[0], np.ones((2, 2)))
    assert not np.allclose(res.weights, start[0]) and np.allclose(res.weights, start[0], atol=3.5e-3)  # three Adam steps
    with pytest.raises(ValueError):
        HD.fit_head(df, df, 3, initial=start)


def test_small_run_variant_keeps_lr_and_runs_all_epochs(spark):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("label_idx"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0 for j in range(4)]).alias("features"))
    opts = HD.HeadOptions(weight_decay=0.0, plateau_factor=None, patience=None, epochs=6, run_id="small")
    res = HD.fit_head(df.where("id % 4 != 0"), df.where("id % 4 = 0"), 3, opts=opts)
    hist = res.history.orderBy("epoch").collect()
    assert [r.epoch for r in hist] == list(range(1, 7))
    assert {r.lr for r in hist} == {1e-3}
    assert res.run.first().run_id == "small"


def test_progress_is_persisted(spark):
    from samplecraft.session import scratch_path
    from samplecraft.sources import metadata as SRC
    df = spark.range(300).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("label_idx"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0 for j in range(4)]).alias("features"))
    hp, wp = scratch_path(spark, "hist"), scratch_path(spark, "heads")
    for run in ("a", "b", "a"):  # a rerun replaces its own rows
        HD.fit_head(df.where("id % 4 != 0"), df.where("id % 4 = 0"), 3,
                    opts=HD.HeadOptions(epochs=4, patience=None, run_id=run), history_path=hp, head_path=wp)
    hist = SRC.read_history(spark, hp)
    assert sorted((r.run_id, r.epoch) for r in hist.collect()) == [(r, e) for r in "ab" for e in range(1, 5)]
    heads = SRC.read_head(spark, wp)
    assert heads.groupBy("run_id", "kind").count().count() == 4
    assert heads.count() == 12


def test_live_epoch_rules_agree_with_history_operators(spark):
    """fit_head decides LR cuts, early stop and best epochs on the driver as it
    trains; the Spark operators must reach the same decisions on its history."""
    from samplecraft.operators import history as H
    df = spark.range(3000).select(
        F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(4))).cast("int").alias("label_idx"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0 for j in range(8)]).alias("features"))
    res = HD.fit_head(df.where("id % 4 != 0"), df.where("id % 4 = 0"), 4,
                      opts=HD.HeadOptions(lr=0.3, epochs=40, patience=5, plateau_patience=2))
    hist = res.history.orderBy("epoch").collect()
    h = res.history.drop("lr", "improved")
    flags = [r.improved for r in H.running_best(h).orderBy("epoch").collect()]
    assert flags == [r.improved for r in hist]
    stop = H.early_stop(h, 5).agg(F.max("epoch")).first()[0]
    assert stop == len(hist) and (len(hist) == 40 or not any(r.improved for r in hist[-5:]))
    lr_after = {r.epoch: r.lr for r in H.plateau_lr(h, lr=0.3, patience=2).collect()}
    for prev, cur in zip(hist, hist[1:]):
        assert cur.lr == lr_after[prev.epoch]   # the rate used in epoch e+1 is the rate after epoch e
    best = H.best_checkpoint(h, 5).first()
    assert best.best_epoch == max(r.epoch for r in hist if r.improved)


def _wide(spark, parts, n=3000, dim=16):
    return spark.range(0, n, 1, parts).select(
        F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(5))).cast("int").alias("label_idx"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 999.0 for j in range(dim)]).alias("features"))


def test_rows_shuffled_a_step_do_not_grow_with_the_partitions(spark):
    w, b = np.zeros((5, 16)), np.zeros(5)
    counted, totals = {}, {}
    for parts in (8, 100, 400):
        rows = HD.training_rows(_wide(spark, parts), 5, 16, "features", "label_idx")
        counted[parts] = HD.group_sums(rows, w, b, limit=8).count()
        totals[parts] = np.concatenate([np.array(r.vals) for r in HD.block_sums(rows, w, b, limit=8).orderBy("block").collect()])
    assert set(counted.values()) == {8}
    assert np.allclose(totals[8], totals[400], atol=1e-9) and totals[100][-4] == 3000


def test_sums_do_not_depend_on_the_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    w, b = rng.normal(size=(5, 16)), rng.normal(size=5)
    monkeypatch.setattr(HD, "BLOCK", 7)  # many blocks
    rows = HD.training_rows(_wide(spark, 60), 5, 16, "features", "label_idx").cache()

    def flat(limit):
        got = sorted((r.block, r.vals) for r in HD.block_sums(rows, w, b, limit).collect())
        return [v for _, vals in got for v in vals]
    one = flat(60)
    assert len(one) == 5 * 17 + 6
    assert flat(1) == one and flat(7) == one  # bit for bit
    rows.unpersist()


def test_whole_number_sums():
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-18, 18, 200), [0.0, -0.0, 1e-300, 2.0 ** 79]])
    whole, odd = HD._to_whole(vals)
    assert odd is None and np.allclose(HD._from_whole(whole), vals, rtol=1e-15, atol=2.0 ** -79)
    whole, odd = HD._to_whole(np.array([np.inf, np.nan, 1.5]))
    assert HD._from_whole(whole).tolist() == [0, 0, 1.5] and np.isinf(odd[0]) and np.isnan(odd[1])


def test_exact_batches_against_numpy(spark):
    """Adam on batches cut every 100 rows from the md5 order, the last one with the 50 that are left."""
    import hashlib
    df = _wide(spark, 7, 250)
    rows = {r.id: (np.array(r.features), r.label_idx) for r in df.collect()}
    w, b = np.zeros((5, 16)), np.zeros(5)
    m = v = np.zeros(85)
    t = 0
    for epoch in (1, 2):
        order = sorted(rows, key=lambda i: (hashlib.md5(f"42:{epoch}:{i}".encode()).hexdigest(), i))
        for lo in range(0, 250, 100):
            part = order[lo:lo + 100]
            grad, _ = _sums(w, b, np.array([rows[i][0] for i in part]), np.array([rows[i][1] for i in part]))
            p = np.concatenate([w.reshape(-1), b])
            t += 1
            p, m, v = HD.adam_step(p, grad / len(part) + 1e-4 * p, m, v, t, 0.01)
            w, b = p[:80].reshape(5, 16), p[80:]
    start = (np.zeros((5, 16)), np.zeros(5))
    res = HD.fit_head(df, df, 5, opts=HD.HeadOptions(lr=0.01, epochs=2, batch_size=100, patience=None), initial=start)
    assert np.allclose(res.weights, w, atol=1e-12) and np.allclose(res.bias, b, atol=1e-12)
    again = HD.fit_head(df, df, 5, opts=HD.HeadOptions(lr=0.01, epochs=2, batch_size=100, patience=None), initial=start)
    assert np.array_equal(again.weights, res.weights) and res.run.first().batch_size == 100


@pytest.mark.parametrize("numbers", [1 << 20, 16 * 10 * 7, 16 * 10])  # all batches in one run, seven a run, a job a step
def test_small_batches_share_jobs(spark, monkeypatch, numbers):
    """605 rows in batches of 10 are 61 steps an epoch: the jobs follow the runs, the weights do not depend on them."""
    import hashlib
    df = _wide(spark, 3, 605)
    rows = {r.id: (np.array(r.features), r.label_idx) for r in df.collect()}
    w, b, m, v, t = np.zeros((5, 16)), np.zeros(5), np.zeros(85), np.zeros(85), 0
    losses = []
    for epoch in (1, 2):
        order = sorted(rows, key=lambda i: (hashlib.md5(f"42:{epoch}:{i}".encode()).hexdigest(), i))
        losses.append(0.0)
        for lo in range(0, 605, 10):
            part = order[lo:lo + 10]
            grad, loss = _sums(w, b, np.array([rows[i][0] for i in part]), np.array([rows[i][1] for i in part]))
            p = np.concatenate([w.reshape(-1), b])
            t += 1
            p, m, v = HD.adam_step(p, grad / len(part) + 1e-4 * p, m, v, t, 0.01)
            w, b = p[:80].reshape(5, 16), p[80:]
            losses[-1] += loss / 605
    monkeypatch.setattr(HD, "RUN_NUMBERS", numbers)
    group = f"steps-{numbers}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        res = HD.fit_head(df, df, 5, opts=HD.HeadOptions(lr=0.01, epochs=2, batch_size=10, patience=None),
                          initial=(np.zeros((5, 16)), np.zeros(5)))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert np.allclose(res.weights, w, atol=1e-12) and np.allclose(res.bias, b, atol=1e-12)
    hist = res.history.orderBy("epoch").collect()
    assert np.allclose([r.train_loss for r in hist], losses, atol=1e-12)
    assert jobs >= 122 if numbers == 160 else jobs <= 60
