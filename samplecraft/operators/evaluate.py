"""Scoring and error analysis.

Predictions are scored once (D3) and every analysis reuses them.  Confusion
counts use partial aggregation, so skewed classes cost nothing extra, and all
other tables derive from these counts (at most C^2 rows).  The dense matrix is
built from the dictionary in blocks, without a cross join; cells of unknown
classes have a table of their own.

A head that is a table (``score_by_blocks``) is multiplied block by block of
classes, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import argmax, cross_entropy, is_correct, linear_logits
from ..functions.tensor import IMAGENET_MEAN, IMAGENET_STD
from .classes import decode_labels
from .sampling import random_sample
from .tensors import apply_step, denormalize

MAX_DENSE_CLASSES = 5_000  # 25 million cells; above it the matrix stays sparse
GRID_BLOCK = 4_096         # cells of a class in one row of the dense matrix's plan
MAX_EXAMPLES = 100_000     # example keys that are broadcast
MAX_ARROW_HEAD = 16_000_000  # doubles in a broadcast head (128 MB)


def score(df: DataFrame, label_col: str = "label_idx", logits_col: str = "logits",
          features_col: str | None = None, weights: Sequence[Sequence[float]] | None = None,
          bias: Sequence[float] | None = None, method: str = "auto") -> DataFrame:
    """D3: logits (from a linear head when given), predicted class, loss and correct flag.

    One narrow stage, no shuffle.  ``loss`` and ``correct`` are NULL when the
    label is NULL (unknown class).  A vector that is NULL, of another length
    than the head's or has NULL elements gets NULL scores.  With a head, rows are scored by one
    ``mapInArrow`` that multiplies each Arrow batch by the head in NumPy (the
    head travels once per executor as a broadcast variable): Catalyst array
    lambdas are interpreted, C x D steps per row, and were 12x slower even
    for a 10 x 64 head.  ``method='catalyst'`` keeps the pure-expression form
    (``functions.scoring.linear_logits``).
    """
    if weights is not None:
        if features_col is None:
            raise ValueError("features_col is required with a head")
        if method not in ("arrow", "auto", "catalyst"):
            raise ValueError("method must be 'auto', 'arrow' or 'catalyst'")
        if method != "catalyst":
            return _score_arrow(df, label_col, logits_col, features_col, weights, bias)
        df = df.withColumn(logits_col, linear_logits(features_col, weights, bias))
    z = F.col(logits_col)
    return (df.withColumn("pred_idx", argmax(z))
              .withColumn("loss", cross_entropy(z, F.col(label_col)))
              .withColumn("correct", is_correct(F.col(label_col), F.col("pred_idx"))))


def _score_arrow(df: DataFrame, label_col: str, logits_col: str, features_col: str,
                 weights, bias) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    w = np.asarray(weights, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)
    if w.size > MAX_ARROW_HEAD:
        raise ValueError(f"a head of more than {MAX_ARROW_HEAD} numbers: use score_by_blocks with the head's table")
    head = spark.sparkContext.broadcast((w, b))
    n_classes, dim = w.shape
    base = df.drop(logits_col, "pred_idx", "loss", "correct")
    out_schema = T.StructType(base.schema.fields + [
        T.StructField(logits_col, T.ArrayType(T.DoubleType())), T.StructField("pred_idx", T.IntegerType()),
        T.StructField("loss", T.DoubleType()), T.StructField("correct", T.BooleanType())])

    def run(batches):
        wv, bv = head.value
        for rb in batches:
            n = rb.num_rows
            x, ok = _vectors(rb.column(rb.schema.get_field_index(features_col)), dim)
            z = x @ wv.T + bv
            m = z.max(axis=1)
            lse = np.log(np.exp(z - m[:, None]).sum(axis=1)) + m
            pred = np.argmax(z, axis=1).astype(np.int32)  # first maximum, as array_position does
            ycol = rb.column(rb.schema.get_field_index(label_col))
            y_ok = np.asarray(ycol.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
            y = np.asarray(ycol.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            in_range = y_ok & (y >= 0) & (y < n_classes) & ok
            loss = np.where(in_range, lse - z[np.arange(n), np.clip(y, 0, n_classes - 1)], 0.0)
            offsets = np.arange(n + 1, dtype=np.int32) * n_classes
            logits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.reshape(-1)),
                                              mask=pa.array(~ok))
            cols = [rb.column(i) for i in range(rb.num_columns)]
            cols += [logits, pa.array(pred, mask=~ok), pa.array(loss, mask=~in_range),
                     pa.array(pred == y, mask=~(y_ok & ok))]
            yield pa.RecordBatch.from_arrays(cols, names=out_schema.fieldNames())

    return base.mapInArrow(run, out_schema)


def head_shape(head: DataFrame) -> tuple[int, int]:
    """(classes, vector length) of a head table; its classes must be 0..C-1, one row each, with equal lengths."""
    r = head.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_idx").alias("d"), F.min("class_idx").alias("lo"),
                 F.max("class_idx").alias("hi"), F.min(F.size("weights")).alias("s"), F.max(F.size("weights")).alias("t")).first()
    if not r["n"]:
        raise ValueError("the head has no classes")
    if (r["n"], r["lo"], r["hi"], r["s"]) != (r["d"], 0, r["n"] - 1, r["t"]) or r["s"] < 1:
        raise ValueError("a head needs one row per class 0..C-1 and weights of one length")
    return r["n"], r["s"]


def score_by_blocks(df: DataFrame, head: DataFrame, features_col: str = "features", label_col: str = "label_idx",
                    logits_col: str | None = None, block_numbers: int = 4_000_000) -> DataFrame:
    """D3 / F4 with a head table (class_idx, bias, weights) of any size.

    The head is cut into blocks of classes of at most ``block_numbers`` numbers.
    One block at a time passes through the driver and is shipped to the
    executors, which keep the blocks on disk; a Python worker holds one block and
    a running maximum, its class, and the sum of exponentials of a few rows.
    The rows are read once, nothing is shuffled.  ``logits_col`` also gives all
    C scores of a row.  Columns and NULLs are those of ``score``.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    n_classes, dim = head_shape(head)
    step = max(1, block_numbers // (dim + 1))
    blocks = []
    for lo in range(0, n_classes, step):
        part = head.where((F.col("class_idx") >= lo) & (F.col("class_idx") < lo + step)).select("class_idx", "bias", "weights")
        rows = part.toArrow().sort_by("class_idx")
        w = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("weights").chunks]).reshape(-1, dim)
        blocks.append((lo, spark.sparkContext.broadcast((w.astype(np.float64), rows.column("bias").to_numpy().astype(np.float64)))))
    base = df.drop(*[c for c in (logits_col, "pred_idx", "loss", "correct") if c])
    fields = [T.StructField(logits_col, T.ArrayType(T.DoubleType()))] if logits_col else []
    out_schema = T.StructType(base.schema.fields + fields + [
        T.StructField("pred_idx", T.IntegerType()), T.StructField("loss", T.DoubleType()), T.StructField("correct", T.BooleanType())])
    few = max(1, 4_000_000 // max(step, n_classes if logits_col else 1))  # rows whose scores are held at a time

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, few):
                yield one(whole.slice(at, few))

    def one(rb):
        x, ok = _vectors(rb.column(rb.schema.get_field_index(features_col)), dim)
        ycol = rb.column(rb.schema.get_field_index(label_col))
        y_ok = np.asarray(ycol.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        y = np.asarray(ycol.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        n = rb.num_rows
        top, best, mass, own = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        kept = np.zeros((n, n_classes)) if logits_col else None
        for lo, shared in blocks:
            w, b = shared.value
            z = x @ w.T + b
            if logits_col:
                kept[:, lo:lo + len(b)] = z
            here = z.max(axis=1)
            best = np.where(here > top, lo + np.argmax(z, axis=1), best).astype(np.int32)  # the first maximum wins
            new = np.maximum(top, here)
            mass = mass * np.exp(top - new) + np.exp(z - new[:, None]).sum(axis=1)
            top = new
            mine = (y >= lo) & (y < lo + len(b))
            own[mine] = z[mine, y[mine] - lo]
            if len(blocks) > 1:
                vars(shared).pop("_value", None)  # the worker keeps the file, not the numbers
        known = y_ok & (y >= 0) & (y < n_classes) & ok
        loss = np.where(known, np.log(mass) + top - own, 0.0)
        cols = [rb.column(i) for i in range(rb.num_columns)]
        if logits_col:
            offsets = np.arange(n + 1, dtype=np.int32) * n_classes
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept.reshape(-1)), mask=pa.array(~ok)))
        cols += [pa.array(best, mask=~ok), pa.array(loss, mask=~known), pa.array(best == y, mask=~(y_ok & ok))]
        return pa.RecordBatch.from_arrays(cols, names=out_schema.fieldNames())

    return base.mapInArrow(run, out_schema)


def _vectors(feats, dim: int):
    """(n x dim matrix, usable?) of an Arrow list column; unusable rows are zeros."""
    import numpy as np
    import pyarrow as pa

    ok = feats.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    x = np.zeros((len(feats), dim))
    if ok.any():
        flat = feats.filter(pa.array(ok)).flatten()
        whole = np.asarray(flat.is_valid().to_numpy(zero_copy_only=False)).reshape(-1, dim).all(axis=1)
        x[ok] = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ok[ok] = whole
    return x, ok


def epoch_metrics(scored: DataFrame, label_col: str = "label_idx") -> DataFrame:
    """Rows, mean loss and accuracy over rows with a known label."""
    s = scored.where(F.col(label_col).isNotNull())
    return s.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("correct").cast("long")).alias("n_correct"),
                 F.avg("loss").alias("loss"),
                 F.avg(F.col("correct").cast("double")).alias("acc"))


def batch_metrics(scored: DataFrame, batch_col: str = "batch_id", label_col: str = "label_idx") -> DataFrame:
    """Per batch size, loss sum / mean and correct count.

    ``sum(loss_sum) / sum(n)`` over batches equals the G3 loss (Q15: the last
    partial batch counts, weighted by its size).
    """
    s = scored.where(F.col(label_col).isNotNull())
    return (s.groupBy(batch_col)
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum("loss").alias("loss_sum"),
                  F.avg("loss").alias("loss"),
                  F.sum(F.col("correct").cast("long")).alias("n_correct")))


def confusion_counts(pred: DataFrame, label_col: str = "label_idx", pred_col: str = "pred_idx",
                     n_col: str | None = None) -> DataFrame:
    """Number of rows per (true, predicted) pair; sparse.

    ``n_col``: the rows are counts already (one per pair and anything else) and are added up.
    """
    n = F.count(F.lit(1)) if n_col is None else F.sum(n_col).cast("long")
    return (pred.where(F.col(label_col).isNotNull() & F.col(pred_col).isNotNull())
                .groupBy(F.col(label_col).cast("int").alias("true_idx"),
                         F.col(pred_col).cast("int").alias("pred_idx"))
                .agg(n.alias("n")))


def confusion_matrix(counts: DataFrame, dictionary: DataFrame, max_classes: int = MAX_DENSE_CLASSES,
                     n_classes: int | None = None, form: str = "auto") -> DataFrame:
    """E1 on the dictionary's class grid.

    ``form='dense'`` gives every cell, zeros included; ``'sparse'`` the same
    without the zeros; ``'auto'`` is dense up to ``max_classes`` classes.  All
    leave out cells whose true or predicted class is not in the dictionary:
    these are the rows of ``outside_cells``, and the two tables' totals are
    E1's.  The dense grid is made from blocks of ``GRID_BLOCK`` cells, spread
    over the tasks, so no cross join is planned and no row grows with C.
    """
    if form not in ("auto", "dense", "sparse"):
        raise ValueError("form must be 'auto', 'dense' or 'sparse'")
    c = n_classes if n_classes is not None else dictionary.count()
    if form == "sparse" or c == 0 or (form == "auto" and c > max_classes):
        return _inside(counts, dictionary).select("true_idx", "pred_idx", "n")
    blocks = dictionary.select(F.col("label_idx").cast("int").alias("true_idx"),
                               F.explode(F.sequence(F.lit(0), F.lit(c - 1), F.lit(GRID_BLOCK))).alias("lo"))
    if c > GRID_BLOCK:
        blocks = blocks.repartition("true_idx", "lo")
    grid = blocks.select("true_idx", F.explode(F.sequence("lo", F.least(F.col("lo") + GRID_BLOCK, F.lit(c)) - 1)).alias("pred_idx"))
    return (grid.join(counts, ["true_idx", "pred_idx"], "left")
                .select("true_idx", "pred_idx", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def _inside(counts: DataFrame, dictionary: DataFrame, how: str = "left_semi") -> DataFrame:
    for c in ("true_idx", "pred_idx"):
        counts = counts.join(dictionary.select(F.col("label_idx").alias(c)), c, how)
    return counts


def outside_cells(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The cells of E1 that E2 has no place for: true or predicted class not in the dictionary."""
    known = dictionary.select(F.col("label_idx").cast("int").alias("i"), F.lit(True).alias("yes"))
    t, p = (known.select(F.col("i").alias(c), F.col("yes").alias(f"{c}_known")) for c in ("true_idx", "pred_idx"))
    flagged = counts.join(t, "true_idx", "left").join(p, "pred_idx", "left")
    return flagged.where(F.col("true_idx_known").isNull() | F.col("pred_idx_known").isNull()).select("true_idx", "pred_idx", "n")


def class_errors(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Errors per true class (row sum minus diagonal); classes without errors get 0."""
    errs = (counts.groupBy(F.col("true_idx").alias("label_idx"))
                  .agg(F.sum(F.when(F.col("true_idx") != F.col("pred_idx"), F.col("n"))
                             .otherwise(F.lit(0))).alias("errors")))
    return (dictionary.join(errs, "label_idx", "left")
                      .select(F.col("label_idx").cast("int").alias("class_idx"), "label",
                              F.coalesce(F.col("errors"), F.lit(0)).cast("long").alias("errors")))


def top_confusions(counts: DataFrame, dictionary: DataFrame, n: int = 10) -> DataFrame:
    """Off-diagonal non-zero cells; count, true name, predicted name, all descending."""
    off = counts.where((F.col("true_idx") != F.col("pred_idx")) & (F.col("n") > 0))
    named = decode_labels(decode_labels(off, dictionary, "true_idx", "true_label"),
                          dictionary, "pred_idx", "pred_label")
    return (named.orderBy(F.col("n").desc(), F.col("true_label").desc(), F.col("pred_label").desc())
                 .limit(n)
                 .select("true_idx", "pred_idx", "true_label", "pred_label", "n"))


def hardest_classes(errors: DataFrame, n: int | None = 20, n_classes: int | None = None) -> DataFrame:
    """The ``n`` classes with most errors, listed in ascending error order.

    Ties: errors ascending, class index ascending, keep the last ``n`` (Q17).
    When ``n`` is falsy or not below the number of classes, every class is
    kept in dictionary order (``rank = class_idx``), as the source pipeline does.
    """
    if n_classes is None:
        n_classes = errors.count()
    if not n or n >= n_classes:
        return errors.select(F.col("class_idx").alias("rank"), "class_idx", "label", "errors")
    top = errors.orderBy(F.col("errors").desc(), F.col("class_idx").desc()).limit(n)
    rank = F.row_number().over(Window.orderBy("errors", "class_idx")) - 1  # <= n rows
    return top.select(rank.cast("int").alias("rank"), "class_idx", "label", "errors")


def submatrix(cm: DataFrame, classes: DataFrame) -> DataFrame:
    """The matrix cut to ``classes`` (rank, class_idx, label) on both axes, re-indexed by rank."""
    t = classes.select(F.col("class_idx").alias("true_idx"), F.col("rank").alias("true_rank"),
                       F.col("label").alias("true_label"))
    p = classes.select(F.col("class_idx").alias("pred_idx"), F.col("rank").alias("pred_rank"),
                       F.col("label").alias("pred_label"))
    # no hint: AQE broadcasts the class list if its measured size allows it
    return (cm.join(t, "true_idx").join(p, "pred_idx")
              .select("true_rank", "pred_rank", "true_idx", "pred_idx", "true_label", "pred_label", "n"))


def heatmap_cells(cm: DataFrame) -> DataFrame:
    """Non-zero cells with the label-colour flag ``dark_cell = n > max(n) / 2``."""
    peak = cm.select(F.max("n")).scalar()
    return (cm.where(F.col("n") > 0)
              .withColumn("dark_cell", F.col("n").cast("double") > peak.cast("double") / F.lit(2.0)))


def example_predictions(scored: DataFrame, dictionary: DataFrame, n: int = 10, correct: bool = True,
                        seed: int = 42, key: str = "id", label_col: str = "label_idx",
                        tensors: DataFrame | Callable[[DataFrame], DataFrame] | None = None, mean: Sequence[float] = IMAGENET_MEAN,
                        std: Sequence[float] = IMAGENET_STD) -> DataFrame:
    """T4: ``n`` seeded-random rows that are right (or wrong), with both class names.

    Reuses the scored rows; nothing is scored a second time.  ``tensors``
    (key, tensor as the model saw it) adds ``image``: the picture of each
    example, denormalised to 0..1, or NULL where there is none.  It may be a
    function of the picked keys, so that only the examples' files are opened.
    """
    pool = scored.where(F.col(label_col).isNotNull() &
                        ((F.col(label_col) == F.col("pred_idx")) == F.lit(bool(correct))))
    picked = random_sample(pool.select(key, F.col(label_col).alias("true_idx"), "pred_idx"), n, seed, key)
    named = decode_labels(decode_labels(picked, dictionary, "true_idx", "true_label"),
                          dictionary, "pred_idx", "pred_label")
    if tensors is None:
        return named
    # at most n rows: the few tensors are fetched by a semi-join, the table is not shuffled
    few = picked.select(key) if n <= MAX_EXAMPLES else None
    if callable(tensors):
        tensors, few = tensors(picked.select(key)), None
    own = tensors.select(key, F.col("tensor").alias("image"))
    own = own if few is None else own.join(F.broadcast(few), key, "left_semi")
    return named.join(apply_step(own, denormalize(mean, std), "image"), key, "left")
