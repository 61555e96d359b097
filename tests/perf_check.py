"""Reproduce the performance numbers quoted in README / BASELINE.

    python tests/perf_check.py score      # Arrow/NumPy vs Catalyst scoring (10x64 and 101x1280 heads)
    python tests/perf_check.py elementwise  # unit + normalise: NumPy stage vs Catalyst lambdas
    python tests/perf_check.py tensors    # training preset throughput, 64x64x3 -> 56x56
    python tests/perf_check.py prune      # cached batches read by one training step's filter

All inputs are the driver tables (sf0.1), replicated inside Spark where
a larger size is needed.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.1"


def _timed(label, fn):
    t0 = time.perf_counter()
    fn()
    print(f"{label:60s} {time.perf_counter() - t0:7.2f} s", flush=True)


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def _replicate(df, key, k):
    return (df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__copy"))
              .withColumn(key, F.col(key) * k + F.col("__copy")).drop("__copy"))


def score(spark):
    import numpy as np
    from samplecraft.operators import evaluate as E
    from samplecraft.plans import fixtures as X
    emb = _replicate(X.embeddings(spark, SF), "vec_id", 100)
    small = emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label_idx"),
                       F.col("embedding").cast("array<double>").alias("features")).cache()
    small.count()
    w, b = X.fixture_head()
    big_c, big_d = 101, 1280
    big = _replicate(X.embeddings(spark, SF), "vec_id", 10).select(   # 20k rows, the vector tiled to 1280
        F.col("vec_id").alias("id"), (F.col("vec_id") % big_c).cast("int").alias("label_idx"),
        F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), big_d // 64)).alias("features")).cache()
    big.count()
    rng = np.random.default_rng(0)
    bw, bb = rng.normal(size=(big_c, big_d)).tolist(), rng.normal(size=big_c).tolist()
    for _ in range(2):
        for method in ("arrow", "catalyst"):
            _timed(f"score 200k rows, 10x64 head, {method}",
                   lambda: _noop(E.score(small, features_col="features", weights=w, bias=b, method=method)
                                 .select("id", "pred_idx", "loss")))
        for method in ("arrow", "catalyst"):
            _timed(f"score 20k rows, 101x1280 head, {method}",
                   lambda: _noop(E.score(big, features_col="features", weights=bw, bias=bb, method=method)
                                 .select("id", "pred_idx", "loss")))


def elementwise(spark):
    from samplecraft.functions import tensor as TX
    from samplecraft.operators import tensors as T
    from samplecraft.plans import fixtures as X
    emb = _replicate(X.embeddings(spark, SF), "vec_id", 5)
    big = T.apply_numpy_steps(X.tensors_8x8x3(emb, eight_bit=True), [T.resize(96, 96)]).cache()
    big.count()
    for _ in range(2):
        _timed("unit + normalise, 10k x 96x96x3, Catalyst lambdas",
               lambda: _noop(big.select("key", TX.normalize(TX.to_unit("tensor")).alias("tensor"))))
        _timed("unit + normalise, 10k x 96x96x3, NumPy stage",
               lambda: _noop(T.apply_numpy_steps(big, [T.to_unit(), T.normalize()])))


def tensors(spark):
    from samplecraft.operators import tensors as T
    from samplecraft.plans import fixtures as X
    for k in (10, 100):
        t = X.tensors_8x8x3(_replicate(X.embeddings(spark, SF), "vec_id", k), eight_bit=True)
        n = t.count()
        steps = [T.resize(64, 64)] + T.train_preset(56, seed=1, epoch=1, key="key")
        t0 = time.perf_counter()
        _noop(T.pipeline(t, steps))
        dt = time.perf_counter() - t0
        print(f"{n} images 64x64x3 -> training preset 56x56: {dt:.1f} s, {n / dt:.0f} images/s", flush=True)


def prune(spark):
    spark.conf.set("spark.sql.inMemoryTableScanStatistics.enable", "true")
    from samplecraft.plans import fixtures as X
    df = (_replicate(X.embeddings(spark, SF), "vec_id", 200)                       # 400k rows
          .select(F.col("vec_id").alias("id"), F.col("embedding").alias("f")).coalesce(8))
    bid = F.pmod(F.xxhash64(F.lit(1), F.lit(1), F.col("id")), F.lit(20)).cast("int")
    for name, c in (("batch-sorted cache", df.withColumn("__bid", bid).sortWithinPartitions("__bid", "id").cache()),
                    ("unsorted cache", df.withColumn("__bid", bid).cache())):
        c.count()
        q = c.where(F.col("__bid") == 7).select(F.size("f"))
        q.collect()
        nodes, found = [q._jdf.queryExecution().executedPlan()], None
        while nodes and found is None:
            node = nodes.pop()
            if node.getClass().getSimpleName() == "InMemoryTableScanExec":
                found = node
            it = node.children().iterator()
            while it.hasNext():
                nodes.append(it.next())
        print(f"{name}: cached batches read by one step's filter = {found.readBatches().value()}")


def main(argv):
    from samplecraft.session import local_session
    spark = local_session(8, 8)
    {"score": score, "elementwise": elementwise, "tensors": tensors, "prune": prune}[argv[1]](spark)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
