import math

import numpy as np
from pyspark.sql import functions as F

from samplecraft.functions import scoring
from samplecraft.operators import classes as C
from samplecraft.operators import evaluate as E
from samplecraft.operators import sampling as S


def scored_frame(spark):
    rows = [(i, i % 3, [float((i * 7 + c * 5) % 11) for c in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label_idx int, logits array<double>")
    return E.score(df)


def dictionary(spark, n=3):
    return C.class_dictionary(spark.createDataFrame([(f"c{i}",) for i in range(n)], "label string"))


def test_argmax_ties_lowest_and_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 0), ([0.5, -1.0, 0.2], 2)], "z array<double>, y int")
    got = df.select(scoring.argmax("z").alias("p"), scoring.cross_entropy("z", "y").alias("l")).collect()
    assert [r.p for r in got] == [1, 0]
    for r, (z, y) in zip(got, [([1.0, 3.0, 3.0], 0), ([0.5, -1.0, 0.2], 2)]):
        ref = math.log(sum(math.exp(v) for v in z)) - z[y]
        assert abs(r.l - ref) < 1e-12


def test_confusion_sums_and_dense_grid(spark):
    s = scored_frame(spark)
    counts = E.confusion_counts(s)
    assert counts.agg(F.sum("n")).first()[0] == 300
    cm = E.confusion_matrix(counts, dictionary(spark))
    assert cm.count() == 9
    assert cm.agg(F.sum("n")).first()[0] == 300


def test_batches_recombine_to_epoch(spark):
    s = S.sequential_batches(scored_frame(spark), 64, key="id")
    b = E.batch_metrics(s).agg((F.sum("loss_sum") / F.sum("n")).alias("l"), F.sum("n_correct").alias("c")).first()
    e = E.epoch_metrics(s).first()
    assert abs(b.l - e.loss) < 1e-9 and b.c == e.n_correct


def test_hardest_classes_tie_rule_and_submatrix(spark):
    # errors: class0 = 2, class1 = 2, class2 = 5, class3 = 0
    counts = spark.createDataFrame(
        [(0, 1, 2), (1, 0, 2), (2, 3, 5), (3, 3, 9), (0, 0, 4)], "true_idx int, pred_idx int, n long")
    d = dictionary(spark, 4)
    errs = E.class_errors(counts, d)
    top2 = [(r.rank, r.class_idx) for r in E.hardest_classes(errs, 2).orderBy("rank").collect()]
    assert top2 == [(0, 1), (1, 2)]   # ascending errors; tie 0/1 keeps the higher index
    every = [(r.rank, r.class_idx) for r in E.hardest_classes(errs, 20).orderBy("rank").collect()]
    assert every == [(0, 0), (1, 1), (2, 2), (3, 3)]  # n >= C: dictionary order
    sub = E.submatrix(E.confusion_matrix(counts, d), E.hardest_classes(errs, 2))
    assert sub.count() == 4


def test_many_classes_stay_sparse(spark):
    n = 5001
    counts = spark.createDataFrame([(0, 1, 2), (7, 7, 9), (5000, 3, 1)], "true_idx int, pred_idx int, n long")
    d = C.class_dictionary(spark.range(n).select(F.format_string("c%05d", "id").alias("label")))
    assert E.confusion_matrix(counts, d).count() == 3
    hard = E.hardest_classes(E.class_errors(counts, d), 2)
    assert [(r.class_idx, r.errors) for r in hard.orderBy("rank").collect()] == [(5000, 1), (0, 2)]
    assert E.submatrix(counts, hard).count() == 0
    assert E.confusion_matrix(counts, d, max_classes=n, n_classes=3).count() == 3 * n


def test_top_confusions_order(spark):
    counts = spark.createDataFrame([(0, 1, 3), (1, 0, 3), (2, 0, 3), (0, 0, 9), (1, 2, 1)],
                                   "true_idx int, pred_idx int, n long")
    got = [(r.true_label, r.pred_label) for r in E.top_confusions(counts, dictionary(spark), 3).collect()]
    assert got == [("c2", "c0"), ("c1", "c0"), ("c0", "c1")]


def test_heatmap_flag(spark):
    cm = spark.createDataFrame([(0, 0, 10), (0, 1, 5), (1, 1, 6), (1, 0, 0)], "true_idx int, pred_idx int, n long")
    got = {(r.true_idx, r.pred_idx): r.dark_cell for r in E.heatmap_cells(cm).collect()}
    assert got == {(0, 0): True, (0, 1): False, (1, 1): True}


def test_examples_are_right_or_wrong(spark):
    s = scored_frame(spark)
    d = dictionary(spark)
    good = E.example_predictions(s, d, 5, True, 1, "id").collect()
    bad = E.example_predictions(s, d, 5, False, 1, "id").collect()
    assert len(good) == 5 and all(r.true_idx == r.pred_idx for r in good)
    assert len(bad) == 5 and all(r.true_idx != r.pred_idx for r in bad)


def test_linear_logits_matches_numpy(spark):
    w = [[0.1, -0.2], [0.3, 0.4], [-0.5, 0.6]]
    b = [0.01, 0.02, 0.03]
    df = spark.createDataFrame([([1.0, 2.0],), ([-3.0, 0.5],)], "x array<double>")
    got = np.array([r.z for r in df.select(scoring.linear_logits("x", w, b).alias("z")).collect()])
    ref = np.array([[1.0, 2.0], [-3.0, 0.5]]) @ np.array(w).T + np.array(b)
    assert np.allclose(got, ref, atol=1e-12)


def test_out_of_range_label_gives_null_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0], 5), ([1.0, 2.0], -1), ([1.0, 2.0], None)], "z array<double>, y int")
    assert [r.l for r in df.select(scoring.cross_entropy("z", "y").alias("l")).collect()] == [None, None, None]


def test_arrow_scoring_matches_catalyst(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(7, 9)).tolist()
    b = rng.normal(size=7).tolist()
    rows = [(i, (i % 9) - 1 if i % 5 else None, [float(v) for v in rng.normal(size=9)]) for i in range(200)]
    rows += [(999, 2, None), (1000, 1, [1.0]), (1001, 1, [1.0] * 17), (1002, 3, [1.0, None] + [0.0] * 7), (1003, 1, [])]
    df = spark.createDataFrame(rows, "id long, label_idx int, features array<double>").repartition(3)
    a = {r.id: r for r in E.score(df, features_col="features", weights=w, bias=b, method="catalyst").collect()}
    c = {r.id: r for r in E.score(df, features_col="features", weights=w, bias=b, method="arrow").collect()}
    assert a.keys() == c.keys()
    assert all(c[k].logits is None and c[k].pred_idx is None and c[k].loss is None for k in range(999, 1004))
    for k in a:
        x, y = a[k], c[k]
        assert (x.logits is None) == (y.logits is None)
        assert x.pred_idx == y.pred_idx and x.correct == y.correct and x.label_idx == y.label_idx
        assert (x.loss is None) == (y.loss is None)
        if x.loss is not None:
            assert abs(x.loss - y.loss) < 1e-9
        if x.logits is not None:
            assert np.allclose(x.logits, y.logits, atol=1e-12)


def test_both_forms_and_the_outside_cells_add_up(spark, monkeypatch):
    monkeypatch.setattr(E, "GRID_BLOCK", 3)
    counts = spark.createDataFrame([(0, 1, 2), (3, 3, 9), (7, 0, 4), (1, 8, 1), (9, 9, 5), (4, 2, 6)],
                                   "true_idx int, pred_idx int, n long")
    d = dictionary(spark, 7)
    dense = E.confusion_matrix(counts, d, form="dense")
    sparse = E.confusion_matrix(counts, d, form="sparse")
    outside = E.outside_cells(counts, d)
    assert dense.count() == 49 and sparse.count() == 3
    assert sorted(tuple(r) for r in dense.where("n > 0").collect()) == sorted(tuple(r) for r in sparse.collect())
    assert sorted(tuple(r) for r in outside.collect()) == [(1, 8, 1), (7, 0, 4), (9, 9, 5)]
    for cm in (dense, sparse, E.confusion_matrix(counts, d, max_classes=3)):
        assert cm.agg(F.sum("n")).first()[0] + outside.agg(F.sum("n")).first()[0] == 27


def test_score_by_blocks_equals_score(spark):
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(7, 9)), rng.normal(size=7)
    w[4], b[4] = w[2], b[2]  # a tie across blocks
    rows = [(i, (i % 9) - 1 if i % 5 else None, [float(v) for v in rng.normal(size=9)], "kept") for i in range(200)]
    rows += [(999, 2, None, "a"), (1000, 1, [1.0], "b"), (1002, 3, [1.0, None] + [0.0] * 7, "c"), (1003, 1, [], None)]
    df = spark.createDataFrame(rows, "id long, label_idx int, features array<double>, loss string").repartition(3)
    head = spark.createDataFrame([(c, float(b[c]), w[c].tolist()) for c in (3, 0, 6, 1, 5, 2, 4)],
                                 "class_idx int, bias double, weights array<double>")
    want = {r.id: r for r in E.score(df, features_col="features", weights=w.tolist(), bias=b.tolist()).collect()}
    for numbers in (1, 25, 10_000):
        got = E.score_by_blocks(df, head, logits_col="logits", block_numbers=numbers)
        assert got.columns == ["id", "label_idx", "features", "logits", "pred_idx", "loss", "correct"]
        for r in got.collect():
            x = want[r.id]
            assert (r.pred_idx, r.correct, r.label_idx) == (x.pred_idx, x.correct, x.label_idx)
            assert (r.loss is None) == (x.loss is None) and (x.loss is None or abs(r.loss - x.loss) < 1e-9)
            assert (r.logits is None) == (x.logits is None) and (x.logits is None or np.allclose(r.logits, x.logits))
    assert "logits" not in E.score_by_blocks(df, head).columns
    for bad in (head.limit(0), head.where("class_idx <> 3"), head.unionByName(head.limit(1))):
        try:
            E.score_by_blocks(df, bad)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_a_head_beyond_the_literal_cap_scores(spark):
    n, dim = 50_001, 50  # 2.5 million numbers: too many for a plan
    head = spark.range(n).select(F.col("id").cast("int").alias("class_idx"), F.lit(0.0).alias("bias"), F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.pmod(F.col("id") * 7 + j, F.lit(1009)) / 1009.0).alias("weights"))
    df = spark.createDataFrame([(1, 5, [1.0] + [0.0] * (dim - 1))], "id int, label_idx int, features array<double>")
    r = E.score_by_blocks(df, head, block_numbers=500_000).first()
    z = np.array([(c * 7 % 1009) / 1009.0 for c in range(n)])
    assert r.pred_idx == int(z.argmax()) and abs(r.loss - (np.log(np.exp(z).sum()) - z[5])) < 1e-9
