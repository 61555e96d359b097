import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from samplecraft.operators import evaluate as E
from samplecraft.operators import head as HD
from samplecraft.plans import workflows as WF
from samplecraft.session import scratch_path


def test_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="wf-test-")
    classes = ["apple_pie", "sushi", "tacos"]
    with open(os.path.join(d, "train.txt"), "w") as fh:
        fh.write("\n".join(f"{c}/{i}" for c in classes for i in range(30)) + "\n/bad/1\n\n")
    with open(os.path.join(d, "test.txt"), "w") as fh:
        fh.write("\n".join(f"{c}/{100 + i}" for c in classes + ["waffles"] for i in range(10)) + "\n")
    out = scratch_path(spark, "wf-meta")
    prep = WF.prepare_metadata(spark, {"train": os.path.join(d, "train.txt"), "test": os.path.join(d, "test.txt")},
                               "/images", out)
    stats = {r.dataset_type: (r.n_rows, r.n_classes) for r in prep.stats.collect()}
    assert stats == {"train": (90, 3), "test": (40, 4), None: (130, 4)}
    assert prep.rejects.count() == 1 and prep.preview.count() == 5
    assert WF.random_records(spark, out, 5, 1).count() == 5

    tables = WF.training_tables(spark, out)
    assert tables.dictionary.count() == 3
    assert tables.test.where(F.col("label_idx").isNull()).count() == 10  # waffles unknown
    assert {r.label: r.side for r in tables.consistency.collect()}["waffles"] == "test_only"

    def feats(df):  # a stand-in frozen feature column: class one-hot plus a hashed jitter
        return df.where(F.col("label_idx").isNotNull()).select(
            F.col("image_path").alias("id"), "label_idx",
            F.array(*[(F.col("label_idx") == j).cast("double") * 3.0
                      + F.pmod(F.xxhash64("image_path", F.lit(j)), F.lit(100)) / 100.0 for j in range(4)])
             .alias("features"))
    res = WF.train(feats(tables.train), feats(tables.test), 3, scratch_path(spark, "wf-h"), scratch_path(spark, "wf-w"),
                   HD.HeadOptions(lr=0.1, epochs=15, patience=None))
    w, b = res.weights, res.bias
    scored = E.score(feats(tables.test), features_col="features", weights=w.tolist(), bias=b.tolist()).cache()
    out = WF.analyze(scored, tables.dictionary, top_classes=2, top_errors=3, n_examples=4, seed=3)
    assert out["confusion"].count() == 9
    assert out["metrics"].first().acc > 0.9
    assert out["hardest"].count() == 2 and out["hardest_matrix"].count() == 4
    assert np.isclose(out["confusion"].agg(F.sum("n")).first()[0], 30)
    assert res.run.first().seconds > 0


def test_tensors_from_images(spark):
    from samplecraft.sources import images as IMG
    d = tempfile.mkdtemp(prefix="wf-img-")
    img_dir = os.path.join(d, "images")
    os.makedirs(os.path.join(img_dir, "a"))
    os.makedirs(os.path.join(img_dir, "b"))
    rng = np.random.default_rng(2)
    for c in ("a", "b"):
        for i in range(3):
            with open(os.path.join(img_dir, c, f"{i}.png"), "wb") as fh:
                fh.write(IMG.png_bytes(rng.integers(0, 256, (10, 12, 3)).astype(np.uint8)))
    with open(os.path.join(img_dir, "b", "3.png"), "wb") as fh:
        fh.write(b"broken")
    with open(os.path.join(d, "train.txt"), "w") as fh:
        fh.write("a/0\na/1\na/2\nb/0\nb/1\nb/2\nb/3\nb/9\n")   # b/3 broken, b/9 missing
    out = scratch_path(spark, "wf-img-meta")
    WF.prepare_metadata(spark, {"train": os.path.join(d, "train.txt")}, img_dir, out, ".png")
    tables = WF.training_tables(spark, out)
    res = WF.tensors(spark, tables.train, img_dir, train=True, size=8, seed=1, epoch=1)
    rows = res.tensors.collect()
    assert len(rows) == 8 and res.invalid.count() == 2
    good = [r for r in rows if r.tensor is not None]
    assert all(r.tensor.height == 8 and r.tensor.width == 8 and r.tensor.channels == 3 for r in good)
    ev = WF.tensors(spark, tables.train, img_dir, train=False, size=5)
    assert ev.invalid.count() == 2 and {r.tensor.height for r in ev.tensors.collect() if r.tensor} == {5}


def _pair(spark, path, run="r"):
    from samplecraft.sources import metadata as SRC
    return (sorted((r.kind, r.class_idx, r.bias) for r in SRC.read_head(spark, path, run).collect()),
            sorted(tuple(r) for r in SRC.read_dictionary(spark, path, run).collect()))


def _features(spark, n_classes):
    return spark.range(200).select("id", (F.col("id") % n_classes).cast("int").alias("label_idx"),
                                   F.array(F.col("id") % n_classes * 1.0, F.lit(1.0)).alias("features"))


def test_head_and_names_are_published_together(spark, monkeypatch):
    from samplecraft.sources import metadata as SRC
    path = scratch_path(spark, "published")
    old_names = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx int, label string")
    new_names = spark.createDataFrame([(0, "b"), (1, "c"), (2, "d")], "label_idx int, label string")
    opts = HD.HeadOptions(epochs=2, patience=None, run_id="r")
    WF.train(_features(spark, 2), _features(spark, 2), 2, head_path=path, opts=opts, dictionary=old_names)
    old = _pair(spark, path)
    assert len(old[0]) == 4 and old[1] == [(0, "a"), (1, "b")]

    steps, one = [], HD._sums

    def dies(*a, **k):
        steps.append(1)
        if len(steps) > 2:  # after a best head was saved
            raise RuntimeError("lost")
        return one(*a, **k)
    monkeypatch.setattr(HD, "_sums", dies)
    try:
        WF.train(_features(spark, 3), _features(spark, 3), 3, head_path=path, opts=opts, dictionary=new_names)
        raise AssertionError("did not die")
    except RuntimeError:
        pass
    monkeypatch.setattr(HD, "_sums", one)
    assert _pair(spark, path) == old

    # dies between the commit and the end of publishing: readers see the new pair, later calls finish it
    finish = SRC.finish_commit
    calls = []

    def late(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return finish(*a)
    monkeypatch.setattr(SRC, "finish_commit", late)
    try:
        WF.train(_features(spark, 3), _features(spark, 3), 3, head_path=path, opts=opts, dictionary=new_names)
        raise AssertionError("did not die")
    except RuntimeError:
        pass
    monkeypatch.setattr(SRC, "finish_commit", finish)
    new = _pair(spark, path)
    assert len(new[0]) == 6 and new[1] == [(0, "b"), (1, "c"), (2, "d")]
    assert SRC.read_head(spark, path).count() == 4  # the table itself is not replaced yet
    SRC.finish_commit(spark, path, "r")
    SRC.finish_commit(spark, path, "r")
    assert _pair(spark, path) == new and SRC.read_head(spark, path).count() == 6


def test_analysis_reports_labels_the_head_does_not_know(spark, tmp_path):
    rows = [(f"/img/{c}/{i}.jpg", c, s) for c, s, n in (("a", "train", 3), ("b", "train", 3), ("b", "test", 4), ("z", "test", 5))
            for i in range(n)]
    table = str(tmp_path / "t")
    spark.createDataFrame(rows, "image_path string, label string, dataset_type string").write.partitionBy("dataset_type").parquet(table)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx int, label string")
    t = WF.training_tables(spark, table, dictionary=names)
    assert {r.label: r.side for r in t.consistency.collect()} == {"a": "train_only", "b": "both", "z": "test_only"}
    assert t.test.where("label_idx is null").count() == 5 and t.train.count() == 6


def test_example_pictures_open_only_their_files(spark):
    scored = spark.range(50).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(0).alias("label_idx"), (F.col("id") % 2).cast("int").alias("pred_idx"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx int, label string")
    asked = []

    def pictures(keys):
        asked.append(keys.count())
        return keys.withColumn("tensor", F.expr("named_struct('height', 1, 'width', 1, 'channels', 3, 'data', array(0f, 0f, 0f))"))
    out = E.example_predictions(scored, names, 4, False, tensors=pictures).collect()
    assert asked == [4] and len(out) == 4 and all(abs(r.image.data[0] - 0.485) < 1e-6 for r in out)
