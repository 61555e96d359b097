"""Manifest parsing and metadata-table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_segment, join_path
from ..schemas import METADATA_COLUMNS


def parse_manifest(lines: DataFrame, root: str, ext: str = ".jpg", line_col: str = "value",
                   rejects: bool = False) -> DataFrame:
    """A2: ``class/item`` lines -> ``(image_path, label)``.

    label = text before the first '/' (whole line if none); path = root joined
    with the line plus ``ext``, backslashes turned into slashes (the label is
    cut before that).  A line starting with '/' has an empty label; such rows
    are returned only with ``rejects=True`` (a stated divergence: the
    source pipeline would keep them with label '').
    """
    line = F.col(line_col)
    parsed = lines.select(join_path(root, line, ext).alias("image_path"),
                          first_segment(line).alias("label"))
    bad = F.col("label") == F.lit("")
    return parsed.filter(bad) if rejects else parsed.filter(~bad)


def tag_split(df: DataFrame, name: str) -> DataFrame:
    """A3: add the constant ``dataset_type`` column."""
    return df.withColumn("dataset_type", F.lit(name))


def combine_splits(*frames: DataFrame) -> DataFrame:
    """UNION ALL of tagged splits, duplicates kept, contract column order."""
    if not frames:
        raise ValueError("need at least one frame")
    out = frames[0].select(*METADATA_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*METADATA_COLUMNS))
    return out


def filter_split(df: DataFrame, name: str) -> DataFrame:
    """B1: ``dataset_type = name`` (partition pruning on a partitioned table)."""
    return df.filter(F.col("dataset_type") == F.lit(name))


def filter_classes(df: DataFrame, classes: Sequence[str] | DataFrame | None,
                   label_col: str = "label", max_literal: int = 1000) -> DataFrame:
    """B2: keep rows whose label is listed; an empty or missing list means no filter.

    Short lists become an ``IN`` predicate (pushed to the scan); long lists or
    a DataFrame of labels become a left-semi join.
    """
    if classes is None:
        return df
    if isinstance(classes, DataFrame):
        keys = classes.select(F.col(classes.columns[0]).alias(label_col)).distinct()
        return df.join(keys, label_col, "left_semi")
    classes = list(classes)
    if not classes:
        return df
    if len(classes) <= max_literal:
        return df.filter(F.col(label_col).isin(classes))
    spark = df.sparkSession
    # the caller's list; AQE broadcasts it if its measured size allows it
    keys = spark.createDataFrame([(c,) for c in classes], f"{label_col} string").distinct()
    return df.join(keys, label_col, "left_semi")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated key order (top-n, no full sort)."""
    order = list(order_by) if order_by else list(df.columns)
    return df.orderBy(*order).limit(n)


def dataset_stats(df: DataFrame, split_col: str = "dataset_type", label_col: str = "label") -> DataFrame:
    """Rows and distinct classes per split, plus a total row (split = NULL)."""
    return (df.rollup(split_col)
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_distinct(F.col(label_col)).alias("n_classes"),
                   F.grouping(split_col).cast("boolean").alias("is_total")))
