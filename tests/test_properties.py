"""Property tests: manifest parsing against a plain-Python model of the rules."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from samplecraft.operators import manifest as M
from samplecraft.functions.text import strip

ROOT = "/img"


def model(line: str):
    """The parse rules in plain Python: strip, drop blank, label before the first
    '/', path = root joined with line + '.jpg', backslashes made slashes."""
    s = line.strip()
    if not s:
        return None
    label = s.split("/")[0]
    path = os.path.join(ROOT, s + ".jpg").replace("\\", "/")
    return (path, label)


alphabet = st.sampled_from(list("ab/\\ .-_é") + ["\t", " ", " ", "\x1c", "\x1f", "　"])


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet, max_size=12), min_size=300, max_size=300))
def test_parse_matches_model(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    stripped = df.select(strip("value").alias("value")).where("value <> ''")
    got = sorted(tuple(r) for r in M.parse_manifest(stripped, ROOT).collect())
    want = sorted(m for m in (model(x) for x in lines) if m is not None and m[1] != "")
    assert got == want


# ---- epoch rules against a plain-Python model of the training loop -----------

import math  # noqa: E402

from samplecraft.operators import history as H  # noqa: E402


def loop_model(losses, patience=5, lr=1e-3, factor=0.1, lr_patience=3, threshold=1e-4):
    """The loop as the training script runs it: append, schedule step, then the
    strict-improvement / patience check; stop after appending the stop epoch."""
    best, bad, kept, improved, lrs, cuts = math.inf, 0, 0, [], [], []
    p_best, p_bad = math.inf, 0
    best_epoch = None
    for e, v in enumerate(losses, start=1):
        kept = e
        if v < p_best * (1 - threshold):
            p_best, p_bad = v, 0
        else:
            p_bad += 1
        cut = False
        if p_bad > lr_patience:
            new = max(lr * factor, 0.0)
            if lr - new > 1e-8:
                lr, cut = new, True
            p_bad = 0
        lrs.append(lr)
        cuts.append(cut)
        if v < best:
            best, bad = v, 0
            best_epoch = e
            improved.append(True)
        else:
            bad += 1
            improved.append(False)
            if bad >= patience:
                break
    return kept, best_epoch, improved, lrs, cuts


values = st.one_of(st.sampled_from([1.0, 0.9, 0.8, 0.85, 0.95, 0.5]), st.floats(0.1, 2.0),
                   st.just(float("nan")))


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(values, min_size=1, max_size=25), min_size=40, max_size=40))
def test_epoch_rules_match_loop_model(spark, runs):
    rows = [(f"r{i}", e + 1, v) for i, losses in enumerate(runs) for e, v in enumerate(losses)]
    h = spark.createDataFrame(rows, "run_id string, epoch int, val_loss double")
    stopped = {}
    for r in H.early_stop(h, 5).collect():
        stopped.setdefault(r.run_id, []).append((r.epoch, r.improved))
    best = {r.run_id: r.best_epoch for r in H.best_checkpoint(h, 5).collect()}
    lrs = {}
    for r in H.plateau_lr(h).collect():
        lrs.setdefault(r.run_id, {})[r.epoch] = (r.lr, r.cut)
    for i, losses in enumerate(runs):
        rid = f"r{i}"
        kept, best_epoch, improved, lr_seq, cut_seq = loop_model(losses)
        got = sorted(stopped[rid])
        assert [e for e, _ in got] == list(range(1, kept + 1))
        assert [imp for _, imp in got] == improved
        assert best.get(rid) == best_epoch
        for e in range(1, kept + 1):
            assert lrs[rid][e][1] == cut_seq[e - 1]
            assert abs(lrs[rid][e][0] - lr_seq[e - 1]) < 1e-18


# ---- error analysis against a NumPy model of the analysis script ---------------

import numpy as np  # noqa: E402

from samplecraft.operators import classes as C  # noqa: E402
from samplecraft.operators import evaluate as E  # noqa: E402


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.integers(2, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=400),
       st.integers(1, 15), st.integers(1, 12))
def test_analysis_matches_numpy_model(spark, n_cls, pairs, top_err, top_cls):
    pairs = [(t % n_cls, p % n_cls) for t, p in pairs]
    names = [f"k{c:02d}" for c in range(n_cls)]
    cm = np.zeros((n_cls, n_cls), dtype=np.int64)
    for t, p in pairs:
        cm[t, p] += 1
    # top errors: (count, true name, pred name), sorted descending as whole tuples
    errs = sorted(((int(cm[i, j]), names[i], names[j]) for i in range(n_cls) for j in range(n_cls)
                   if i != j and cm[i, j] > 0), reverse=True)[:top_err]
    # hardest classes: errors ascending, then index ascending; keep the last n (all, in order, if n >= C)
    row_err = (cm - np.diag(np.diag(cm))).sum(axis=1)
    if top_cls < n_cls:
        hard = list(np.lexsort((np.arange(n_cls), row_err))[-top_cls:])
    else:
        hard = list(range(n_cls))

    d = C.class_dictionary(spark.createDataFrame([(x,) for x in names], "label string"))
    pred = spark.createDataFrame(pairs, "label_idx int, pred_idx int")
    counts = E.confusion_counts(pred)
    dense = {(r.true_idx, r.pred_idx): r.n for r in E.confusion_matrix(counts, d).collect()}
    assert dense == {(i, j): int(cm[i, j]) for i in range(n_cls) for j in range(n_cls)}
    got_errs = [(r.n, r.true_label, r.pred_label) for r in E.top_confusions(counts, d, top_err).collect()]
    assert got_errs == errs
    got_hard = [r.class_idx for r in E.hardest_classes(E.class_errors(counts, d), top_cls).orderBy("rank").collect()]
    assert got_hard == [int(x) for x in hard]
    sub = {(r.true_rank, r.pred_rank): r.n for r in
           E.submatrix(E.confusion_matrix(counts, d), E.hardest_classes(E.class_errors(counts, d), top_cls)).collect()}
    assert sub == {(a, b): int(cm[hard[a], hard[b]]) for a in range(len(hard)) for b in range(len(hard))}
