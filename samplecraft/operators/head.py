"""Train a linear softmax head on a frozen feature column.

Each optimisation step is one Spark job over the cached features.  A
``mapInArrow`` stage computes, per partition, the summed gradient of the
softmax cross-entropy, the loss sum, the correct count and the row count.  These
vectors are added up before anything is shuffled: neighbouring partitions are
coalesced into at most ``partial_limit`` groups, each of which gives one row
per block of ``BLOCK`` numbers, and one more stage adds the groups up per block.  So
a step shuffles (groups x blocks) rows, whatever the number of partitions is.
Sums are kept as whole multiples of fixed powers of two, whose addition does not
depend on the order; which partitions a group holds therefore changes no bit.
Only C x (D + 1) + 6 sums reach the driver, which holds the parameters,
applies Adam (Kingma & Ba, 2014) with L2 added to the gradient, and runs the
epoch rules of ``operators.history`` (plateau learning rate, early stop, best
checkpoint) live on the per-epoch metrics.

Rows without a usable label (0..C-1) or a vector of the head's length, without
NULL elements, take no part; they are counted in the result.

Mini-batches: ``batch_size`` (or ``steps_per_epoch = k``, which sets it to the
rows divided by k) cuts each epoch's seeded order into batches of exactly that
many rows with ``operators.sampling.shuffle_batches``; the last one may be
smaller and is kept.  A step needs the weights of the step before, so steps
cannot run side by side, and a small batch is far less work than a Spark job.
So an epoch's order is written once to the scratch folder in runs of whole
batches, at most ``RUN_NUMBERS`` numbers each; one job trains on one run, step
after step, and hands its Adam state to the next run.  What a task reads does not
grow with the table, and there are as many jobs as runs.  Where fewer than
two batches, or not a head's state, fit a run, a step is a job over all
partitions: an epoch's order is cached sorted by batch inside its partitions,
so the in-memory column statistics let a step read little more than its batch.
One step an epoch is full-batch (train metrics measured with the weights
before the update).
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import usable_vector
from ..schemas import HEAD, HISTORY, RUNS
from ..session import clear_scratch, scratch_count, scratch_path, ship_package
from ..sources.metadata import write_head, write_history
from .sampling import shuffle_batches

MAX_HEAD_PARAMS = 16_000_000  # C x (D + 1) doubles kept on the driver and broadcast (128 MB)


@dataclass
class HeadOptions:
    lr: float = 1e-3
    weight_decay: float = 1e-4
    epochs: int = 20
    patience: int | None = 5            # early stop; None disables
    plateau_factor: float | None = 0.1  # None disables the schedule
    plateau_patience: int = 3
    plateau_threshold: float = 1e-4
    steps_per_epoch: int = 1
    batch_size: int | None = None     # rows per step; sets the steps of an epoch
    seed: int = 42
    betas: tuple[float, float] = (0.9, 0.999)
    adam_eps: float = 1e-8
    run_id: str = "run"
    deterministic: bool = True        # sort rows inside partitions: bit-identical reruns and retries


@dataclass
class FitResult:
    history: DataFrame   # M10 rows, plus lr and improved
    head: DataFrame      # M12 rows, kind 'best' and 'final'
    weights: np.ndarray  # final (C, D)
    bias: np.ndarray     # final (C,)
    run: DataFrame       # one ``runs`` row: model, classes, epochs asked, seconds
    skipped_train: int   # rows left out for their label or vector
    skipped_val: int


BROADCAST_HEAD_MIN = 65_536  # weights above this are shipped as a broadcast variable
RUN_NUMBERS = 1 << 20        # feature numbers of consecutive batches that one job trains on (8 MB)


def _columns(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, labels) of a batch of training rows."""
    x = rb.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rb.num_rows, -1)
    return x, rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _scored(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray):
    """(probabilities, loss and hit of every row)"""
    z = x @ w.T + b
    m = z.max(axis=1, keepdims=True)
    e = np.exp(z - m)
    s = e.sum(axis=1, keepdims=True)
    loss = np.log(s[:, 0]) + m[:, 0] - z[np.arange(len(y)), y]
    return e / s, loss, np.argmax(z, axis=1) == y


def _gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summed loss's gradient by weights and biases; ``p`` is used up."""
    p[np.arange(len(y)), y] -= 1.0
    return p.T @ x, p.sum(axis=0)


def _sums_kernel(weights, bias):
    """Per-partition sums of the columns ``x`` (vector), ``y`` (label) and ``val``: one (src, vals) row.

    Flat layout: gradient of the summed training loss (C x D weights, then C
    biases), then loss sum, correct count and rows of training rows, then the
    same three for validation rows, which add no gradient.  ``weights`` is a
    (C, D) array or a broadcast variable holding ``(W, b)``.
    """
    shared = not isinstance(weights, np.ndarray)

    def run(batches):
        w_arr, b_arr = weights.value if shared else (weights, bias)
        n_classes, dim = w_arr.shape
        g_w = np.zeros((n_classes, dim))
        g_b = np.zeros(n_classes)
        tot = np.zeros(6)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x, y = _columns(rb)
            is_val = np.asarray(rb.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            p, loss, hit = _scored(x, y, w_arr, b_arr)
            for j, mask in enumerate((~is_val, is_val)):
                tot[3 * j] += float(loss[mask].sum())
                tot[3 * j + 1] += float(hit[mask].sum())
                tot[3 * j + 2] += float(mask.sum())
            if (~is_val).any():
                more_w, more_b = _gradient(p[~is_val], x[~is_val], y[~is_val])
                g_w += more_w
                g_b += more_b
        ctx = TaskContext.get()
        vals = np.concatenate([g_w.reshape(-1), g_b, tot])
        yield pa.RecordBatch.from_arrays(
            [pa.array([ctx.partitionId() if ctx is not None else 0], pa.int32()),
             pa.ListArray.from_arrays(pa.array([0, len(vals)], pa.int32()), pa.array(vals))], names=["src", "vals"])

    return run


def training_rows(df: DataFrame, n_classes: int, dim: int, features_col: str, label_col: str,
                  val: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(x, y, val) of the rows that can train or test a (``n_classes``, ``dim``) head."""
    y = F.col(label_col).cast("int")
    return df.where(usable_vector(features_col, dim) & (y >= 0) & (y < n_classes)).select(
        *keep, F.col(features_col).cast("array<double>").alias("x"), y.alias("y"), F.lit(val).alias("val"))


BLOCK = 8192             # numbers of a vector in one shuffled row
_POWERS = (40, 0, -40, -80)  # a number is a sum of whole multiples of these powers of two


def partial_limit(spark) -> int:
    """Groups of partitions whose vectors are added up before the shuffle: a few per core."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


def _to_whole(vals: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(4 x K whole numbers, what they cannot hold or None); what lies below 2 ** -80 is cut off."""
    good = np.abs(vals) < 2.0 ** 80
    rest = np.where(good, vals, 0.0)
    out = np.empty((len(_POWERS), len(vals)), np.int64)
    for k, e in enumerate(_POWERS):
        out[k] = whole = np.trunc(np.ldexp(rest, -e))
        rest = rest - np.ldexp(whole, e)
    return out, None if good.all() else np.where(good, 0.0, vals)


def _from_whole(whole: np.ndarray) -> np.ndarray:
    total = np.zeros(whole.shape[1])
    for k in reversed(range(len(_POWERS))):
        total += np.ldexp(whole[k].astype(np.float64), _POWERS[k])
    return total


def _group_sums(batches):
    """One group's vectors (src, vals) -> its sum, a row per block."""
    total = odd = None
    for rb in batches:
        for vals in rb.column(1):
            whole, more = _to_whole(vals.values.to_numpy())
            total = whole if total is None else total + whole
            if more is not None:
                odd = more if odd is None else odd + more
    if total is None:
        return
    for k, lo in enumerate(range(0, total.shape[1], BLOCK)):
        part = total[:, lo:lo + BLOCK]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([part.reshape(-1)], pa.list_(pa.int64())),
             pa.array([None if odd is None else odd[lo:lo + BLOCK]], pa.list_(pa.float64()))], names=["block", "whole", "odd"])


def _block_sums(batches):
    """Rows of a block side by side -> (block, vals)."""
    now = total = odd = None

    def done():
        vals = _from_whole(total.reshape(len(_POWERS), -1))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array(
            [vals if odd is None else vals + odd], pa.list_(pa.float64()))], names=["block", "vals"])
    for rb in batches:
        for block, whole, more in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2)):
            whole = whole.values.to_numpy()
            if block != now:
                if now is not None:
                    yield done()
                now, total, odd = block, whole, None
            else:
                total = total + whole
            if more.is_valid:
                odd = more.values.to_numpy() if odd is None else odd + more.values.to_numpy()
    if now is not None:
        yield done()


def group_sums(rows: DataFrame, weights, bias=None, limit: int | None = None) -> DataFrame:
    """(block, whole, odd): what a step shuffles, at most ``limit`` rows per block of the sums."""
    ship_package(rows.sparkSession)
    parts = rows.select("x", "y", "val").mapInArrow(_sums_kernel(weights, bias), "src int, vals array<double>")
    return (parts.coalesce(limit or partial_limit(rows.sparkSession))
            .mapInArrow(_group_sums, "block int, whole array<long>, odd array<double>"))


def block_sums(rows: DataFrame, weights, bias=None, limit: int | None = None) -> DataFrame:
    """(block, vals): the gradient and totals of ``_sums_kernel`` over all of ``training_rows``, ``BLOCK`` numbers a row."""
    return (group_sums(rows, weights, bias, limit).repartition("block").sortWithinPartitions("block")
            .mapInArrow(_block_sums, "block int, vals array<double>"))


def sums(rows: DataFrame, weights, bias=None) -> DataFrame:
    """(i, v): the same, a row per number."""
    return block_sums(rows, weights, bias).select("block", F.posexplode("vals").alias("at", "v")).select(
        (F.col("block") * BLOCK + F.col("at")).alias("i"), "v")


@dataclass
class _Sums:
    grad: np.ndarray
    loss: float
    correct: int
    n: int
    val_loss: float
    val_correct: int
    val_n: int


def _sums(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> _Sums:
    """One Spark job; the C x (D + 1) + 6 sums reach the driver as columns."""
    # Large heads travel once per executor as a broadcast; small ones ride in the task closure.
    head = rows.sparkSession.sparkContext.broadcast((weights, bias)) if weights.size > BROADCAST_HEAD_MIN else None
    got = block_sums(rows, head if head is not None else weights, bias).toArrow()
    if head is not None:
        head.destroy()
    k = weights.size + len(bias)
    flat = np.zeros(k + 6)
    for block, vals in zip(got.column("block").to_pylist(), got.column("vals")):
        flat[block * BLOCK:block * BLOCK + len(vals)] = vals.values.to_numpy()
    tot = flat[k:]
    return _Sums(flat[:k], float(tot[0]), int(round(tot[1])), int(round(tot[2])),
                 float(tot[3]), int(round(tot[4])), int(round(tot[5])))


def adam_step(params, grad, m, v, t: int, lr: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
    """One Adam update (Kingma & Ba, 2014) of arrays or of columns; ``grad`` already includes any L2 term.

    Returns ``(params, m, v)``.
    """
    b1, b2 = betas
    m = b1 * m + (1 - b1) * grad
    v = b2 * v + (1 - b2) * grad * grad
    m_hat = m / (1 - b1 ** t)
    v_hat = v / (1 - b2 ** t)
    return params - lr * m_hat / (v_hat ** 0.5 + eps), m, v


def _steps_kernel(state, shape: tuple[int, int], size: int, t: int, lr: float, opts: HeadOptions):
    """Adam steps over the rows of a run (x, y), a step every ``size`` rows, after ``t`` steps: one row (vals).

    ``state`` is the parameters and both moments, 3 x C x (D + 1) numbers or a
    broadcast variable holding them; ``vals`` is the new state, then the
    loss sum, correct count and rows, each step's with the weights before it.
    """
    n_classes, dim = shape
    decay, betas, eps = opts.weight_decay, opts.betas, opts.adam_eps

    def run(batches):
        params, m, v = np.split(np.array(state if isinstance(state, np.ndarray) else state.value), 3)
        tot, now = np.zeros(3), t
        x, y = np.zeros((0, dim)), np.zeros(0, np.int64)

        def step(x, y):
            nonlocal params, m, v, now
            p, loss, hit = _scored(x, y, params[:n_classes * dim].reshape(n_classes, dim), params[n_classes * dim:])
            tot[:] += float(loss.sum()), float(hit.sum()), len(y)
            g_w, g_b = _gradient(p, x, y)
            g = np.concatenate([g_w.reshape(-1), g_b]) / len(y) + decay * params
            now += 1
            params, m, v = adam_step(params, g, m, v, now, lr, betas, eps)

        for rb in batches:
            if rb.num_rows == 0:
                continue
            more_x, more_y = _columns(rb)
            x, y = np.concatenate([x, more_x]), np.concatenate([y, more_y])
            full = len(y) // size * size
            for lo in range(0, full, size):
                step(x[lo:lo + size], y[lo:lo + size])
            x, y = x[full:], y[full:]
        if len(y):
            step(x, y)
        vals = np.concatenate([params, m, v, tot])
        yield pa.RecordBatch.from_arrays([pa.array([vals], pa.list_(pa.float64()))], names=["vals"])

    return run


def _write_runs(dealt: DataFrame, path: str, rows: int, n: int) -> int:
    """Write ``n`` rows with a dense ``row_idx`` in folders of ``rows`` consecutive ones; their number."""
    runs = -(-n // rows)
    part = dealt.select("x", "y", "row_idx", F.floor(F.col("row_idx") / rows).cast("long").alias("run"))
    part.repartition(runs, "run").sortWithinPartitions("run", "row_idx").write.partitionBy("run").parquet(path)
    return runs


def _train_run(spark, path: str, run: int, state: np.ndarray, shape: tuple[int, int], size: int, t: int, lr: float,
               opts: HeadOptions) -> tuple[np.ndarray, np.ndarray]:
    """One Spark job: (state after the run's steps, [loss sum, correct count, rows])."""
    ship_package(spark)
    head = spark.sparkContext.broadcast(state) if state.size > BROADCAST_HEAD_MIN else None
    rows = spark.read.schema("x array<double>, y int, row_idx long").parquet(f"{path}/run={run}")
    kernel = _steps_kernel(state if head is None else head, shape, size, t, lr, opts)
    got = rows.coalesce(1).sortWithinPartitions("row_idx").mapInArrow(kernel, "vals array<double>").toArrow()
    if head is not None:
        head.destroy()
    vals = got.column("vals")[0].values.to_numpy()
    return vals[:-3], vals[-3:]


def _vector_length(df: DataFrame, features_col: str) -> int:
    """The most frequent vector length (the longer of two equally frequent ones)."""
    n = F.size(features_col).alias("d")
    top = (df.where(F.col(features_col).isNotNull()).groupBy(n).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.col("c").desc(), F.col("d").desc()).limit(1).collect())
    if not top:
        raise ValueError(f"no row has a {features_col} vector")
    return int(top[0]["d"])


def fit_head(train: DataFrame, val: DataFrame, n_classes: int, features_col: str = "features",
             label_col: str = "label_idx", key: str = "id", opts: HeadOptions | None = None,
             model: str = "linear-head", history_path: str | None = None,
             head_path: str | None = None, initial: tuple[np.ndarray, np.ndarray] | None = None) -> FitResult:
    """Train the head; returns per-epoch history, the best / final heads and a run row.

    ``initial`` gives the first (C x D weights, C biases); else they are drawn
    from ``opts.seed`` and D is the most frequent vector length of ``train``.

    Validation of epoch e and the first step of epoch e + 1 use the same
    weights, so where a step is a job they share one; if epoch e stops the run, that
    step's gradient is simply not applied.

    With ``history_path`` this run's rows are rewritten as each epoch closes;
    with ``head_path`` the best head is rewritten on every improvement (only
    this run's ``best`` partition) and the final head is written at the end,
    so an interrupted run keeps its progress and a rerun replaces it.
    """
    opts = opts or HeadOptions()
    spark = train.sparkSession
    started = time.time()
    cols = [features_col, label_col]
    sides = [df.select(*([F.col(key).alias("k")] if key in df.columns else []), *cols) for df in (train, val)]
    w, b = (np.array(x, dtype=np.float64) for x in initial) if initial is not None else (None, None)
    if w is not None and (w.ndim != 2 or w.shape[0] != n_classes or b.shape != (n_classes,)):
        raise ValueError("initial must be (C x D weights, C biases)")
    dim = w.shape[1] if w is not None else _vector_length(sides[0], features_col)
    if n_classes * (dim + 1) > MAX_HEAD_PARAMS:
        raise ValueError("head too large for driver-side updates")

    def usable(df, is_val):
        """(usable rows, cached once; their number; the number of others)"""
        rows = training_rows(df, n_classes, dim, features_col, label_col, is_val, ["k"] if "k" in df.columns else [])
        # Row order inside a partition decides the floating-point summation order; after a
        # lost task an upstream shuffle may deliver rows in another order, so fix it.
        rows = rows.sortWithinPartitions("k") if opts.deterministic and "k" in df.columns else rows
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        n = rows.count()
        return rows, n, df.count() - n

    (tr, n_train, skipped_train), (va, _, skipped_val) = usable(sides[0], False), usable(sides[1], True)
    size = opts.batch_size or -(-n_train // max(1, int(opts.steps_per_epoch)))
    k = max(1, -(-n_train // size)) if size else 1
    if k > 1 and "k" not in tr.columns:
        raise ValueError(f"mini-batches need the key column {key}")

    if w is None:
        rng = np.random.default_rng(opts.seed)
        bound = 1.0 / math.sqrt(dim)
        w = rng.uniform(-bound, bound, size=(n_classes, dim))
        b = rng.uniform(-bound, bound, size=n_classes)
    m = np.zeros(n_classes * dim + n_classes)
    v = np.zeros_like(m)
    t = 0
    lr = opts.lr
    best, bad, plateau_best, plateau_bad = math.inf, 0, math.inf, 0
    best_w, best_b = None, None
    history = []
    totals = [0.0, 0, 0]

    def persist_epochs():
        if history_path:
            write_history(spark.createDataFrame([tuple(r[c] for c in HISTORY.fieldNames()) for r in history], HISTORY),
                          history_path)

    def persist_head(kind, hw, hb):
        if head_path:
            rows = [(opts.run_id, kind, c, float(hb[c]), [float(x) for x in hw[c]]) for c in range(n_classes)]
            write_head(spark.createDataFrame(rows, HEAD), head_path)

    # batches of one run, which is trained on in one job; below two, a step is a job
    in_run = RUN_NUMBERS // (size * dim) if k > 1 and 3 * m.size <= RUN_NUMBERS else 0

    def train_runs(epoch):
        """All steps of ``epoch``, run after run."""
        nonlocal w, b, m, v, t
        keep = scratch_count()
        path = scratch_path(spark, "epoch")
        dealt = shuffle_batches(tr, size, opts.seed, epoch, key="k")
        state = np.concatenate([w.reshape(-1), b, m, v])
        try:
            for run in range(_write_runs(dealt, path, in_run * size, n_train)):
                state, got = _train_run(spark, path, run, state, w.shape, size, t, lr, opts)
                t += -(-int(got[2]) // size)
                totals[:] = [x + y for x, y in zip(totals, got.tolist())]
        finally:
            clear_scratch(spark, keep)
        params, m, v = np.split(state, 3)
        w, b = params[:n_classes * dim].reshape(n_classes, dim), params[n_classes * dim:]

    epoch_cache = {}

    def batch(epoch, step):
        """Rows of step ``step`` in ``epoch``: one shuffle an epoch puts them in its seeded order."""
        if k == 1:
            return tr
        if epoch not in epoch_cache:
            for old in epoch_cache.values():
                old.unpersist()
            epoch_cache.clear()
            dealt = shuffle_batches(tr, size, opts.seed, epoch, key="k").sortWithinPartitions("batch_id", "row_idx")
            epoch_cache[epoch] = dealt.persist(StorageLevel.MEMORY_AND_DISK)
        return epoch_cache[epoch].where(F.col("batch_id") == step)

    def close_epoch(epoch, got) -> bool:
        """Record epoch ``epoch`` from its validation sums; True = stop training."""
        nonlocal lr, best, bad, plateau_best, plateau_bad, best_w, best_b
        vn = got.val_n
        val_loss = got.val_loss / vn if vn else float("nan")
        ltot, ctot, ntot = totals
        row = dict(run_id=opts.run_id, epoch=epoch, train_loss=ltot / ntot if ntot else None,
                   train_acc=ctot / ntot if ntot else None, val_loss=val_loss if vn else None,
                   val_acc=got.val_correct / vn if vn else None, lr=lr)
        if opts.plateau_factor is not None:  # same rule as operators.history.plateau_lr
            if val_loss < plateau_best * (1.0 - opts.plateau_threshold):
                plateau_best, plateau_bad = val_loss, 0
            else:
                plateau_bad += 1
            if plateau_bad > opts.plateau_patience:
                new_lr = lr * opts.plateau_factor
                if lr - new_lr > 1e-8:
                    lr = new_lr
                plateau_bad = 0
        improved = val_loss < best
        row["improved"] = bool(improved)
        history.append(row)
        persist_epochs()
        if improved:
            best, bad = val_loss, 0
            best_w, best_b = w.copy(), b.copy()
            persist_head("best", best_w, best_b)
            return False
        bad += 1
        return opts.patience is not None and bad >= opts.patience

    try:
        stopped = False
        for epoch in range(1, opts.epochs + 1):
            if in_run > 1:
                if epoch > 1:
                    stopped = close_epoch(epoch - 1, _sums(va, w, b))
                    if stopped:
                        break
                totals[:] = [0.0, 0, 0]
                train_runs(epoch)
                continue
            for step in range(k):
                part = batch(epoch, step)
                if step == 0 and epoch > 1:
                    got = _sums(part.select("x", "y", "val").unionByName(va.select("x", "y", "val")), w, b)
                    stopped = close_epoch(epoch - 1, got)
                    if stopped:
                        break
                else:
                    got = _sums(part, w, b)
                if step == 0:
                    totals[:] = [0.0, 0, 0]
                if got.n == 0:
                    continue
                totals[0] += got.loss
                totals[1] += got.correct
                totals[2] += got.n
                params = np.concatenate([w.reshape(-1), b])
                g = got.grad / got.n + opts.weight_decay * params
                t += 1
                params, m, v = adam_step(params, g, m, v, t, lr, opts.betas, opts.adam_eps)
                w = params[: n_classes * dim].reshape(n_classes, dim)
                b = params[n_classes * dim:]
            if stopped:
                break
        if not stopped and opts.epochs >= 1:
            close_epoch(len(history) + 1, _sums(va, w, b))
    finally:  # release the caches even if training stops with an error
        for ep in epoch_cache.values():
            ep.unpersist()
        tr.unpersist()
        va.unpersist()
    persist_head("final", w, b)
    seconds = round(time.time() - started, 2)  # F8: elapsed wall-clock, 2 decimals

    hist_schema = T.StructType(HISTORY.fields + [T.StructField("lr", T.DoubleType()),
                                                 T.StructField("improved", T.BooleanType())])
    hist_df = spark.createDataFrame(
        [(r["run_id"], r["epoch"], r["train_loss"], r["train_acc"], r["val_loss"], r["val_acc"], r["lr"],
          r["improved"]) for r in history], hist_schema)
    head_rows = []
    for kind, (hw, hb) in (("final", (w, b)), ("best", (best_w, best_b))):
        if hw is None:
            continue
        head_rows += [(opts.run_id, kind, c, float(hb[c]), [float(x) for x in hw[c]]) for c in range(n_classes)]
    head_df = spark.createDataFrame(head_rows, HEAD)
    per_step = size or None  # rows per step
    run_df = spark.createDataFrame([(opts.run_id, model, n_classes, opts.epochs, per_step, seconds)], RUNS)
    return FitResult(hist_df, head_df, w, b, run_df, skipped_train, skipped_val)


def head_arrays(head: DataFrame, run_id: str, kind: str):
    """Read one stored head back into (weights C x D, bias C) on the driver (model-sized)."""
    rows = head.where((F.col("run_id") == run_id) & (F.col("kind") == kind)).orderBy("class_idx").collect()
    if not rows:
        raise ValueError(f"no head {run_id}/{kind}")
    return np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows])
