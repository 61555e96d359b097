"""Contract schemas (column order is part of the contract)."""

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("image_path", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("dataset_type", T.StringType()),
])
METADATA_COLUMNS = [f.name for f in METADATA.fields]

CLASS_DICTIONARY = T.StructType([
    T.StructField("label_idx", T.IntegerType(), False),
    T.StructField("label", T.StringType()),
])

TENSOR = T.StructType([
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.FloatType())),
])

CONFUSION = T.StructType([
    T.StructField("true_idx", T.IntegerType()),
    T.StructField("pred_idx", T.IntegerType()),
    T.StructField("n", T.LongType()),
])

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("train_acc", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_acc", T.DoubleType()),
])
HISTORY_COLUMNS = [f.name for f in HISTORY.fields]
HISTORY_METRICS = ["train_loss", "train_acc", "val_loss", "val_acc"]

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("n_classes", T.IntegerType()),
    T.StructField("epochs_asked", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
])
RUNS_COLUMNS = [f.name for f in RUNS.fields]

HEAD = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("class_idx", T.IntegerType()),
    T.StructField("bias", T.DoubleType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
])
HEAD_COLUMNS = [f.name for f in HEAD.fields]
