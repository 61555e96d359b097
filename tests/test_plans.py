"""Plan-shape checks: the properties the design relies on at scale."""

import importlib
import re

from pyspark.sql import functions as F

from samplecraft.operators import classes as C
from samplecraft.operators import evaluate as E
from samplecraft.operators import sampling as S

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def q(name):
    return importlib.import_module("__spark_entry__").queries()[name]


def test_counts_combine_map_side(spark):
    p = plan(q("confusion_counts")(spark, SF))
    assert "partial_count" in p
    for name in ("top_confusions", "hardest_classes", "hardest_submatrix", "heatmap_cells", "class_errors", "confusion_matrix"):
        p = q(name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "embedding#" not in p, name  # the table was scanned once, into the kept counts
    p = plan(q("dataset_stats")(spark, SF))
    assert "partial_count" in p


def test_shuffle_batches_window_is_bucketed(spark):
    p = plan(q("shuffle_batches")(spark, SF))
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^,]*),", p)
    assert windows and all("_bucket" in w for w in windows)   # partitioned by bucket, never global
    assert "BroadcastHashJoin" in p


def test_split_scan_prunes_partitions_and_columns(spark):
    p = plan(q("metadata_scan")(spark, SF))
    assert "PartitionFilters: [isnotnull(dataset_type" in p
    assert "ReadSchema: struct<image_path:string,label:string>" in p


def test_class_filter_pushed_to_scan(spark):
    p = plan(q("class_filter")(spark, SF))
    assert "PushedFilters: [In(event_type" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_dictionary_join_broadcast_and_topn(spark):
    p = plan(q("label_encode")(spark, SF))
    assert "BroadcastHashJoin" in p
    p = plan(q("top_confusions")(spark, SF))
    assert "TakeOrderedAndProject" in p and "SortMergeJoin" not in p


def test_skewed_class_is_exact(spark):
    # one class holds a third of all rows
    n = 30000
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 97) + 1).cast("int").alias("label_idx"),
        F.array(*[((F.col("id") * (j + 1)) % 13).cast("double") for j in range(98)]).alias("logits"))
    scored = E.score(df)
    counts = E.confusion_counts(scored)
    assert counts.agg(F.sum("n")).first()[0] == n
    hot = counts.where("true_idx = 0").agg(F.sum("n")).first()[0]
    assert hot == n // 3
    names = spark.createDataFrame([(f"c{i:03d}",) for i in range(98)], "label string")
    d = C.class_dictionary(names)
    cm = E.confusion_matrix(counts, d)
    assert cm.count() == 98 * 98 and cm.agg(F.sum("n")).first()[0] == n
    b = S.shuffle_batches(df.select("id", "label_idx"), 1000, seed=5, key="id")
    assert b.agg(F.countDistinct("row_idx"), F.max("row_idx")).first() == (n, n - 1)
