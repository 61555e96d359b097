"""Rules over epoch histories.

Every rule runs per run (``partitionBy('run_id').orderBy('epoch')``); a run
holds one row per epoch, so each window partition is small and runs are
spread over tasks by the run key.

Improvement is strict (``val_loss < best``, best starts at +inf).  NaN never
improves: Spark orders NaN above every number, as Python's ``<`` refuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORY_COLUMNS, HISTORY_METRICS

INF = float("inf")


def _w(run_col: str = "run_id", epoch_col: str = "epoch"):
    return Window.partitionBy(run_col).orderBy(epoch_col)


def running_best(h: DataFrame, metric: str = "val_loss") -> DataFrame:
    """``best_before`` (best value in earlier epochs), ``improved``, ``best_so_far``."""
    w = _w()
    finite = F.when(~F.isnan(F.col(metric)), F.col(metric))
    before = F.coalesce(F.min(finite).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(INF))
    upto = F.coalesce(F.min(finite).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(INF))
    return (h.withColumn("best_before", before)
             .withColumn("improved", F.coalesce(F.col(metric) < F.col("best_before"), F.lit(False)))
             .withColumn("best_so_far", upto))


def patience_counter(h: DataFrame, patience: int = 5, metric: str = "val_loss") -> DataFrame:
    """Epochs since the last improvement (0 on an improving epoch) and the limit flag.

    Counted in rows, so gaps in epoch numbers do not change the count.
    """
    if "improved" not in h.columns:
        h = running_best(h, metric)
    w = _w()
    rn = F.row_number().over(w)
    last = F.max(F.when(F.col("improved"), F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (h.withColumn("__rn", rn)
             .withColumn("bad_epochs", (F.col("__rn") - F.coalesce(last, F.lit(0))).cast("int"))
             .withColumn("patience_hit", F.col("bad_epochs") >= F.lit(patience))
             .drop("__rn"))


def early_stop(h: DataFrame, patience: int = 5, metric: str = "val_loss") -> DataFrame:
    """Keep epochs up to and including the first epoch that hits the patience limit."""
    if "patience_hit" not in h.columns:
        h = patience_counter(h, patience, metric)
    stop = F.min(F.when(F.col("patience_hit"), F.col("epoch"))).over(Window.partitionBy("run_id"))
    return (h.withColumn("stop_epoch", stop)
             .where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))))


_LR_STEP = T.ArrayType(T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("cut", T.BooleanType()),
]))


def plateau_lr(h: DataFrame, lr: float = 1e-3, factor: float = 0.1, patience: int = 3,
               threshold: float = 1e-4, cooldown: int = 0, min_lr: float = 0.0, eps: float = 1e-8,
               metric: str = "val_loss") -> DataFrame:
    """Learning rate after each epoch under reduce-on-plateau (mode min, relative threshold).

    A bad epoch is one that does not beat ``best * (1 - threshold)``; when the
    bad-epoch count exceeds ``patience`` the rate is multiplied by ``factor``
    (floored at ``min_lr``, ignored when the change is below ``eps``), then the
    count resets and ``cooldown`` epochs are skipped.  This is a sequential
    fold with resets, so it runs as an ``aggregate`` over the run's epochs in
    order (one run = one small array), not as a window.
    Output: ``run_id, epoch, lr, cut``.
    """
    per_run = h.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"),
                                             F.col(metric).cast("double").alias("v")))).alias("__e"))
    init = F.struct(F.lit(INF).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("cool"),
                    F.lit(float(lr)).alias("lr"), F.array().cast(_LR_STEP).alias("out"))
    keep = F.lit(1.0 - threshold)

    def step(s, x):
        v = x["v"]
        better = F.coalesce(v < s["best"] * keep, F.lit(False))
        bad1 = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        in_cool = s["cool"] > 0
        cool1 = F.when(in_cool, s["cool"] - 1).otherwise(s["cool"])
        bad2 = F.when(in_cool, F.lit(0)).otherwise(bad1)
        cut = bad2 > F.lit(patience)
        new_lr = F.greatest(s["lr"] * F.lit(float(factor)), F.lit(float(min_lr)))
        applied = cut & ((s["lr"] - new_lr) > F.lit(float(eps)))
        lr_after = F.when(applied, new_lr).otherwise(s["lr"])
        return F.struct(
            F.when(better, v).otherwise(s["best"]).alias("best"),
            F.when(cut, F.lit(0)).otherwise(bad2).alias("bad"),
            F.when(cut, F.lit(cooldown)).otherwise(cool1).alias("cool"),
            lr_after.alias("lr"),
            F.concat(s["out"], F.array(F.struct(x["epoch"].alias("epoch"), lr_after.alias("lr"),
                                                applied.alias("cut")))).alias("out"))

    folded = per_run.select("run_id", F.aggregate("__e", init, step, lambda s: s["out"]).alias("__o"))
    return folded.select("run_id", F.inline("__o"))


def best_checkpoint(h: DataFrame, patience: int | None = 5, metric: str = "val_loss") -> DataFrame:
    """Per run, the epoch of the last strict improvement (= first minimum).

    With ``patience`` set, only epochs kept by early stopping count.  A run with
    no improving epoch (e.g. all NaN) has no row.
    """
    x = running_best(h, metric)
    if patience is not None:
        x = early_stop(patience_counter(x, patience, metric), patience, metric)
    return (x.groupBy("run_id")
             .agg(F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
                  F.min(F.when(F.col("improved"), F.col(metric))).alias("best_val_loss"),
                  F.count(F.lit(1)).alias("epochs_run"))
             .where(F.col("best_epoch").isNotNull()))


def history_table(metrics: DataFrame) -> DataFrame:
    """One M10 row per (run, epoch) from combinable per-split sums.

    Input columns: ``run_id, epoch, split ('train'|'val'), loss_sum, n_correct, n``
    (as produced by G4-style partial sums).  Loss = loss_sum / n, accuracy =
    n_correct / n; a split with no rows gives NULLs.
    """
    def part(split, col):
        return F.sum(F.when(F.col("split") == split, F.col(col)))
    def ratio(split, col):
        return F.try_divide(part(split, col).cast("double"), part(split, "n").cast("double"))
    return (metrics.groupBy("run_id", F.col("epoch").cast("int").alias("epoch"))
                   .agg(ratio("train", "loss_sum").alias("train_loss"),
                        ratio("train", "n_correct").alias("train_acc"),
                        ratio("val", "loss_sum").alias("val_loss"),
                        ratio("val", "n_correct").alias("val_acc"))
                   .select(*HISTORY_COLUMNS))


def history_arrays(h: DataFrame) -> DataFrame:
    """Back to four epoch-ordered lists per run (plus the epoch list)."""
    per_run = h.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("epoch"), *[F.col(m) for m in HISTORY_METRICS]))).alias("__e"))
    def field(name):
        return F.transform("__e", lambda e: e[name])
    return per_run.select(
        "run_id", field("epoch").alias("epochs"),
        *[field(m).alias(m + "es" if m.endswith("loss") else m + "s") for m in HISTORY_METRICS])


def history_series(h: DataFrame) -> DataFrame:
    """Long form ``(run_id, epoch, metric, split, value)`` for the two-panel curves."""
    long = h.select("run_id", "epoch", *HISTORY_METRICS).unpivot(
        ["run_id", "epoch"], HISTORY_METRICS, "name", "value")
    return long.where(F.col("value").isNotNull()).select(
        "run_id", "epoch",
        F.substring_index("name", "_", -1).alias("metric"),
        F.substring_index("name", "_", 1).alias("split"),
        "value")


def run_summary(runs: DataFrame, h: DataFrame) -> DataFrame:
    """Per run, epochs run vs asked, best val loss and its (first) epoch, best val
    accuracy and its first epoch, last train / val accuracy, their gap, seconds and
    seconds per epoch."""
    agg = h.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("epochs_run"),
        F.min(F.when(F.col("val_loss").isNotNull(),
                     F.struct(F.col("val_loss"), F.col("epoch")))).alias("__bl"),
        F.max(F.when(F.col("val_acc").isNotNull(),
                     F.struct(F.col("val_acc"), (-F.col("epoch")).alias("neg_epoch")))).alias("__ba"),
        F.max(F.struct(F.col("epoch"), F.col("train_acc"), F.col("val_acc"))).alias("__last"))
    j = runs.join(agg, "run_id", "inner")
    return j.select(
        "run_id", "model", "n_classes", "epochs_asked", "epochs_run",
        F.col("__bl.val_loss").alias("best_val_loss"), F.col("__bl.epoch").alias("best_loss_epoch"),
        F.col("__ba.val_acc").alias("best_val_acc"), (-F.col("__ba.neg_epoch")).alias("best_acc_epoch"),
        F.col("__last.train_acc").alias("last_train_acc"), F.col("__last.val_acc").alias("last_val_acc"),
        (F.col("__last.train_acc") - F.col("__last.val_acc")).alias("acc_gap"),
        "seconds",
        (F.col("seconds") / F.col("epochs_run")).alias("seconds_per_epoch"))
