"""Inputs derived, by Spark, from the driver tables (see FIXTURES.md).

The driver tables hold no images, manifests or run logs, so each library
input is a deterministic projection of ``events`` or ``embeddings``; the work
of every query therefore grows with those tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tensor import make_tensor
from ..operators.history import history_table
from ..operators.manifest import combine_splits, parse_manifest, tag_split

IMAGE_ROOT = "/data/images"
SEED = 42
# The three classes of the small training run, here event types.
CLASS_SUBSET = ("click", "view", "error")
N_LOGITS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# ---- manifests / metadata -------------------------------------------------

def is_test_split(event_id) -> F.Column:
    """The 75 / 25 split: every fourth event goes to ``test``."""
    return F.pmod(event_id, F.lit(4)) == 0


def manifest_lines(ev: DataFrame) -> DataFrame:
    """Padded ``class/item`` lines (``value``) plus the event id and split."""
    return ev.select(
        F.concat(F.lit("  "), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"),
                 F.lit(" ")).alias("value"),
        F.col("event_id"),
        F.when(is_test_split(F.col("event_id")), "test").otherwise("train").alias("split"))


def metadata(ev: DataFrame) -> DataFrame:
    """The M2 table (image_path, label, dataset_type) built from both splits."""
    lines = manifest_lines(ev).withColumn("value", F.trim("value"))
    train = tag_split(parse_manifest(lines.where(F.col("split") == "train"), IMAGE_ROOT), "train")
    test = tag_split(parse_manifest(lines.where(F.col("split") == "test"), IMAGE_ROOT), "test")
    return combine_splits(train, test)


def samples(ev: DataFrame) -> DataFrame:
    """Keyed samples: ``id`` (event id), ``label`` (event type), ``dataset_type``."""
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("label"),
                     F.when(is_test_split(F.col("event_id")), "test").otherwise("train").alias("dataset_type"))


# ---- predictions ------------------------------------------------------------

def predictions_input(emb: DataFrame, dim: int = 64, name: bool = False) -> DataFrame:
    """``id, label_idx, logits`` (and the class name ``label``): the score of class c is the sum of the vector elements
    c, c + 10, c + 20, ... (0-based), added in that order, so every element counts."""
    def score(c):
        terms = [F.get("embedding", F.lit(j)).cast("double") for j in range(c, dim, N_LOGITS)]
        return functools.reduce(lambda a, b: a + b, terms)
    names = [F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label")] if name else []
    return emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label_idx"), *names,
                      F.array(*[score(c) for c in range(N_LOGITS)]).alias("logits"))


def class_names(emb: DataFrame) -> DataFrame:
    """Rows carrying the class name ``'class_' || label``."""
    return emb.select(F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"))


def fixture_head(n_classes: int = N_LOGITS, dim: int = 64):
    """A fixed linear head (model parameters, not data): w[c][j], b[c]."""
    w = [[((31 * c + 17 * j) % 11 - 5) / 10.0 for j in range(dim)] for c in range(n_classes)]
    b = [c / 100.0 for c in range(n_classes)]
    return w, b


# ---- tensors --------------------------------------------------------------

def tensors_8x8(emb: DataFrame, eight_bit: bool = False) -> DataFrame:
    """``key, tensor``: the 64-vector as an 8 x 8 x 1 tensor (8-bit form on request)."""
    data = F.col("embedding")
    if eight_bit:
        data = F.transform(data, lambda v: F.floor((v.cast("double") + 1.0) * 127.5))
    return emb.select(F.col("vec_id").alias("key"), make_tensor(F.lit(8), F.lit(8), F.lit(1), data).alias("tensor"))


def tensors_8x8x3(emb: DataFrame, eight_bit: bool = False) -> DataFrame:
    """``key, tensor``: the 64-vector as an 8 x 8 x 3 tensor; channel c is the vector turned
    by 21 c places, so each channel holds every element."""
    data = F.col("embedding")
    if eight_bit:
        data = F.transform(data, lambda v: F.floor((v.cast("double") + 1.0) * 127.5))

    def turned(c, k):  # the inner arrays are made once per row, not once per element
        return F.concat(F.slice(c, k + 1, 64 - k), F.slice(c, 1, k)) if k else c
    three = F.arrays_zip(*[turned(data, 21 * k).alias(f"c{k}") for k in range(3)])
    data = F.flatten(F.transform(three, lambda e: F.array(*[e[f"c{k}"] for k in range(3)])))
    return emb.select(F.col("vec_id").alias("key"), make_tensor(F.lit(8), F.lit(8), F.lit(3), data).alias("tensor"))


# ---- histories ------------------------------------------------------------

def _cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def history_metrics(ev: DataFrame) -> DataFrame:
    """Per (run, epoch, split) sums: run = event type, epoch = day of month.

    val rows: every event, loss = value (to the cent), correct = even event id;
    train rows: events of odd users only.
    """
    odd = F.pmod(F.col("user_id"), F.lit(2)) == 1
    even_id = (F.pmod(F.col("event_id"), F.lit(2)) == 0).cast("long")
    g = ev.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        (F.sum(_cents("value")).cast("double") / F.lit(100.0)).alias("v_loss"),
        F.sum(even_id).alias("v_correct"), F.count(F.lit(1)).alias("v_n"),
        (F.sum(F.when(odd, _cents("value"))).cast("double") / F.lit(100.0)).alias("t_loss"),
        F.sum(F.when(odd, even_id)).alias("t_correct"), F.sum(F.when(odd, F.lit(1))).alias("t_n"))
    return g.select("run_id", "epoch", F.inline(F.array(
        F.struct(F.lit("val").alias("split"), F.col("v_loss").alias("loss_sum"),
                 F.col("v_correct").alias("n_correct"), F.col("v_n").cast("long").alias("n")),
        F.struct(F.lit("train").alias("split"), F.col("t_loss").alias("loss_sum"),
                 F.col("t_correct").alias("n_correct"), F.col("t_n").cast("long").alias("n")))))


def history(ev: DataFrame) -> DataFrame:
    return history_table(history_metrics(ev))


def runs(ev: DataFrame) -> DataFrame:
    """One run per event type: model name, class scope (NULL = all), epochs, batch, seconds."""
    return ev.groupBy(F.col("event_type").alias("run_id")).agg(
        (F.sum(_cents("value")).cast("double") / F.lit(100.0)).alias("seconds")).select(
        "run_id", F.col("run_id").alias("model"),
        F.when(F.col("run_id") < F.lit("p"), F.lit(3)).cast("int").alias("n_classes"),
        F.lit(30).alias("epochs_asked"), F.lit(256).alias("batch_size"), "seconds")


# ---- heads ----------------------------------------------------------------

def centroid_head(df: DataFrame, features_col: str = "features", label_col: str = "label_idx",
                  run_id: str = "centroid") -> DataFrame:
    """A head derived from the data for the head round trip (A9): w_c = mean
    feature vector of class c, b_c = -|w_c|^2 / 2.  Element-wise means via
    posexplode + groupBy (partial aggregation; a hot class only adds rows to
    combine)."""
    long = df.select(F.col(label_col).cast("int").alias("class_idx"),
                     F.posexplode(F.col(features_col)).alias("j", "x"))
    means = long.groupBy("class_idx", "j").agg(F.avg(F.col("x").cast("double")).alias("w"))
    per_class = means.groupBy("class_idx").agg(
        F.array_sort(F.collect_list(F.struct("j", "w"))).alias("__w"))
    weights = F.transform("__w", lambda e: e["w"])
    return per_class.select(
        F.lit(run_id).alias("run_id"), F.lit("final").alias("kind"), "class_idx",
        (-0.5 * F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x * x)).alias("bias"),
        weights.alias("weights"))
