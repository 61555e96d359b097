"""Lost tasks: results must equal a failure-free run.

Runs in a subprocess on ``local[4,4]`` (four attempts per task); an identity
Arrow step fails the first attempt of every even partition, like an executor
lost mid-stage.
"""

import os
import subprocess
import sys

SCRIPT = r'''
import sys
sys.path.insert(0, REPO)
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from samplecraft.session import ensure_checkpoint_dir
from samplecraft.plans import fixtures as X
from samplecraft.operators import sampling as S, tensors as T, head as HD
ensure_checkpoint_dir(spark)

def flaky(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("injected task loss")
    yield from batches

def steady(batches):
    yield from batches

# same plan shape with and without lost tasks
def lose(df):
    return df.repartition(6).mapInArrow(flaky, df.schema)

def keep(df):
    return df.repartition(6).mapInArrow(steady, df.schema)

emb = X.embeddings(spark, SF)
ev = X.events(spark, SF)
checks = {}
t = X.tensors_8x8x3(emb, eight_bit=True)
run = lambda d: sorted((r.key, tuple(r.tensor.data)) for r in T.pipeline(d, T.train_preset(4, 7, 1, "key")).collect())
checks["pipeline"] = run(keep(t)) == run(lose(t))
s = X.samples(ev).select("id", "label")
d1 = lambda d: sorted(tuple(r) for r in S.shuffle_batches(d, 100, 3, 2, "id").collect())
checks["shuffle_batches"] = d1(keep(s)) == d1(lose(s))
d2 = lambda d: sorted(tuple(r) for r in S.sequential_batches(d, 100, "id").collect())
checks["sequential_batches"] = d2(keep(s)) == d2(lose(s))
f = emb.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
               F.col("label").cast("int").alias("label_idx"))
fit = lambda d: HD.fit_head(d.where("id % 4 != 0"), d.where("id % 4 = 0"), 10,
                            opts=HD.HeadOptions(epochs=3, patience=None)).weights
checks["fit_head"] = bool(np.array_equal(fit(keep(f)), fit(lose(f))))
print("CHECKS", checks)
'''


def test_results_survive_lost_tasks(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "faults.py"
    script.write_text(f"REPO = {repo!r}\nSF = '/root/testdata/sf0.001'\n" + SCRIPT)
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=900)
    line = [x for x in out.stdout.splitlines() if x.startswith("CHECKS")]
    assert line, out.stderr[-3000:]
    checks = eval(line[0][len("CHECKS "):])
    assert all(checks.values()), checks
