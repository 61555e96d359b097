import os
import tempfile

import pytest
from pyspark.sql import functions as F

from samplecraft import cli
from samplecraft.session import scratch_path
from samplecraft.sources import run_log as RL


def test_cli_end_to_end(spark, capsys):
    d = tempfile.mkdtemp(prefix="cli-test-")
    classes = ["a", "b", "c"]
    for split, rng in (("train", range(20)), ("test", range(100, 108))):
        with open(os.path.join(d, f"{split}.txt"), "w") as fh:
            fh.write("\n".join(f"{c}/{i}" for c in classes for i in rng) + "\n")
    table, feats, heads, hist = (scratch_path(spark, n) for n in ("cli-t", "cli-f", "cli-w", "cli-h"))
    cli.main(["prepare", "--manifest", f"train={d}/train.txt", "--manifest", f"test={d}/test.txt",
              "--image-root", "/img", "--out", table], spark)
    meta = spark.read.parquet(table)
    label_num = F.when(F.col("label") == "a", 0).when(F.col("label") == "b", 1).otherwise(2)
    meta.select("image_path", F.array(*[(label_num == j).cast("double") * 2.0
                                        + F.pmod(F.xxhash64("image_path", F.lit(j)), F.lit(10)) / 10.0
                                        for j in range(3)]).alias("features")) \
        .write.mode("overwrite").parquet(feats)
    cli.main(["random", "--table", table, "-n", "3"], spark)
    cli.main(["train", "--table", table, "--features", feats, "--heads", heads, "--history", hist,
              "--run-id", "r", "--epochs", "8", "--lr", "0.1"], spark)
    cli.main(["analyze", "--table", table, "--features", feats, "--heads", heads, "--run-id", "r",
              "--kind", "final", "--top-classes", "2"], spark)
    out = capsys.readouterr().out
    assert "val_losses = [" in out and "seconds = " in out
    assert spark.read.parquet(hist).count() == 8
    assert spark.read.parquet(heads).where("kind = 'best'").count() == 3


def test_analyze_uses_the_dictionary_of_the_head(spark, tmp_path, capsys):
    """Trained on two of three classes, the analysis names and counts just these two."""
    table, feats, heads, out, log = (str(tmp_path / n) for n in ("t", "f", "w", "o", "log"))
    rows = [(f"/img/{c}/{i}.jpg", c, s) for c in "abc" for i, s in [(i, "train" if i < 20 else "test") for i in range(30)]]
    meta = spark.createDataFrame(rows, "image_path string, label string, dataset_type string")
    meta.write.partitionBy("dataset_type").parquet(table)
    meta.select("image_path", F.array(*[F.when(F.col("label") == c, 3.0).otherwise(0.0) for c in "abc"]).alias("features")) \
        .write.parquet(feats)
    cli.main(["train", "--table", table, "--features", feats, "--heads", heads, "--run-id", "r", "--classes", "b,c",
              "--epochs", "20", "--lr", "0.2", "--batch-size", "20", "--log", log], spark)
    cli.main(["analyze", "--table", table, "--features", feats, "--heads", heads, "--run-id", "r", "--out", out], spark)
    m = spark.read.parquet(f"{out}/metrics").first()
    assert (m.n, m.acc) == (20, 1.0)
    names = {r.true_label for r in spark.read.parquet(f"{out}/examples_correct").collect()}
    assert names == {"b", "c"} and spark.read.parquet(f"{out}/top_confusions").count() == 0
    runs, hist = RL.scan_run_log(spark, log)
    assert runs.first().batch_size == 20 and hist.count() >= 1
    spark.createDataFrame([(0, "b")], "label_idx int, label string").selectExpr("'r' run_id", "label_idx", "label") \
        .write.mode("overwrite").partitionBy("run_id").parquet(heads + "_classes")
    with pytest.raises(ValueError, match="classes"):
        cli.main(["analyze", "--table", table, "--features", feats, "--heads", heads, "--run-id", "r"], spark)


def test_cli_runlog_on_golden_log(spark, capsys):
    from test_history import RUNS, _ref_layout_log, golden
    d = tempfile.mkdtemp(prefix="cli-log-")
    with open(os.path.join(d, "runs.log"), "w", encoding="utf-8") as fh:
        fh.write(_ref_layout_log(golden(spark), RUNS))
    cli.main(["runlog", "--path", d], spark)
    out = capsys.readouterr().out
    assert "[12, 17]" in out and "[12, 18]" in out
