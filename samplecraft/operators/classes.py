"""The class dictionary and label lookups.

One dictionary is built from the training split and used everywhere
(a stated divergence: the source pipeline builds one per split and only warns on
a mismatch).  Test labels missing from it get ``label_idx = NULL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MAX_WINDOW_CLASSES = 1_000_000


def class_dictionary(df: DataFrame, label_col: str = "label", distributed: bool | None = None) -> DataFrame:
    """G1: sorted distinct labels with a dense 0-based index.

    ``distinct`` runs with partial aggregation, and the labels are counted.  Up
    to ``MAX_WINDOW_CLASSES`` of them are numbered by one window; more are ranked
    by a sampled range sort with per-partition offsets
    (``operators.sampling.dense_index``).  Both give the same numbers;
    ``distributed`` chooses one of them without counting.
    """
    labels = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    if distributed is None:
        distributed = labels.count() > MAX_WINDOW_CLASSES
    if distributed:
        from .sampling import dense_index
        ranked = dense_index(labels, [F.col("label")], "label_idx")
        return ranked.select(F.col("label_idx").cast("int").alias("label_idx"), "label")
    return labels.select(
        (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_idx"),
        "label")


def encode_labels(df: DataFrame, dictionary: DataFrame, label_col: str = "label") -> DataFrame:
    """Label -> ``label_idx`` (left join; NULL for labels not in the dictionary).

    The dictionary side is one row per class; AQE sees its runtime size and
    turns the join into a broadcast hash join, falling back to a shuffle join
    if it is unexpectedly large.
    """
    d = dictionary.select(F.col("label").alias(label_col), "label_idx")
    return df.join(d, label_col, "left")


def decode_labels(df: DataFrame, dictionary: DataFrame, idx_col: str, name_col: str) -> DataFrame:
    """Index -> class name."""
    d = dictionary.select(F.col("label_idx").alias(idx_col), F.col("label").alias(name_col))
    return df.join(d, idx_col, "left")


def class_consistency(train: DataFrame, test: DataFrame, label_col: str = "label") -> DataFrame:
    """Compare the class lists of two splits; one row per label with side flags."""
    a = train.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct() \
        .withColumn("in_train", F.lit(True))
    b = test.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct() \
        .withColumn("in_test", F.lit(True))
    j = a.join(b, "label", "full_outer")
    return j.select(
        "label",
        F.coalesce("in_train", F.lit(False)).alias("in_train"),
        F.coalesce("in_test", F.lit(False)).alias("in_test"),
        F.when(F.col("in_train") & F.col("in_test"), "both")
         .when(F.col("in_train").isNotNull(), "train_only")
         .otherwise("test_only").alias("side"))
