"""End-to-end jobs, one per script of the original pipeline.

* ``prepare_metadata``  manifests -> one partitioned Parquet table (one write),
  then stats and a preview read back from the written table;
* ``random_records``    seeded random rows of the table;
* ``training_tables``   split scan, class filter, one dictionary, encoding and
  the split-consistency report;
* ``train``             linear head on a feature column, history and heads written;
* ``analyze``           one scoring pass, then every error-analysis table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classes as C
from ..operators import evaluate as E
from ..operators import head as HD
from ..operators import manifest as M
from ..operators import sampling as S
from ..operators import tensors as T
from ..sources import images as IMG
from ..sources import metadata as SRC


@dataclass
class Prepared:
    stats: DataFrame
    preview: DataFrame
    rejects: DataFrame


def prepare_metadata(spark: SparkSession, manifests: dict[str, str], image_root: str, out_path: str,
                     ext: str = ".jpg") -> Prepared:
    """Parse each split's manifest, tag, union and write the table once (overwrite)."""
    parts, rejects = [], []
    for split, path in manifests.items():
        lines = SRC.scan_manifest(spark, path)
        parts.append(M.tag_split(M.parse_manifest(lines, image_root, ext), split))
        rejects.append(M.tag_split(M.parse_manifest(lines, image_root, ext, rejects=True), split))
    SRC.write_metadata(M.combine_splits(*parts), out_path)
    table = SRC.read_metadata(spark, out_path, columns=("image_path", "label", "dataset_type"))
    return Prepared(M.dataset_stats(table), M.preview(table, 5), M.combine_splits(*rejects))


def random_records(spark: SparkSession, path: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` seeded random (image_path, label) rows of the whole table."""
    return S.random_sample(SRC.read_metadata(spark, path), n, seed, key="image_path")


@dataclass
class TrainingTables:
    dictionary: DataFrame
    train: DataFrame
    test: DataFrame
    consistency: DataFrame


def training_tables(spark: SparkSession, path: str, classes: Sequence[str] | None = None,
                    train_split: str = "train", test_split: str = "test",
                    dictionary: DataFrame | None = None) -> TrainingTables:
    """Scan both splits (partition-pruned), filter classes, build one dictionary from
    the training split and encode both splits with it (unknown test labels -> NULL).

    ``dictionary``: the one that a head was trained with.  The training split is
    then cut to its classes; the test split is kept whole, so rows whose label
    the head does not know have ``label_idx = NULL`` and show up in
    ``consistency``, which compares the dictionary's classes with the test split.
    """
    train = SRC.read_metadata(spark, path, split=train_split)
    test = SRC.read_metadata(spark, path, split=test_split)
    if dictionary is None:
        train, test = M.filter_classes(train, classes), M.filter_classes(test, classes)
    else:
        train = M.filter_classes(train, dictionary.select("label"))
    # One row per class, reused by every later join: materialise it once (reliable checkpoint).
    d = (C.class_dictionary(train) if dictionary is None else dictionary).checkpoint(eager=True)
    known = train if dictionary is None else d
    return TrainingTables(d, C.encode_labels(train, d), C.encode_labels(test, d), C.class_consistency(known, test))


@dataclass
class Tensors:
    tensors: DataFrame   # encoded rows + ``tensor`` (NULL when the file is missing or undecodable)
    invalid: DataFrame   # the encoded rows without a usable image (lazy; count it if needed)


def tensors(spark: SparkSession, encoded: DataFrame, image_dir: str, train: bool, size: int = 224,
            seed: int = 42, epoch: int = 0) -> Tensors:
    """Encoded rows -> model-ready tensors.

    Only the files that the rows name are opened (``sources.images.listed_images``),
    and the train or eval preset runs on their raw bytes in one fused NumPy
    stage (channel fix included).  Rows whose image is missing or undecodable
    keep ``tensor = NULL`` and are also listed in ``invalid`` (without running
    the pipeline), where the original loader would have stopped; so are images
    whose bytes do not make up their height, width and channels.
    """
    joined = IMG.listed_images(spark, encoded, image_dir)
    steps = (T.train_preset(size, seed=seed, epoch=epoch, key="image_path") if train
             else T.eval_preset(size))
    out = T.pipeline(joined, steps, tensor_col="image").withColumnRenamed("image", "tensor")
    bad = joined.where(~T.usable_tensor(joined, "image")).drop("image")
    return Tensors(out, bad)


def train(train_features: DataFrame, val_features: DataFrame, n_classes: int, history_path: str | None = None,
          head_path: str | None = None, opts: HD.HeadOptions | None = None, key: str = "id",
          features_col: str = "features", label_col: str = "label_idx",
          dictionary: DataFrame | None = None) -> HD.FitResult:
    """Fit the head; history rows are appended per epoch and the best / final heads
    saved as training goes when paths are given.

    ``dictionary``: the class names that belong to the head.  Heads and names
    are then written to a staged folder while training goes, and published
    together at its end; a run that dies leaves the run's earlier pair in place.
    """
    opts = opts or HD.HeadOptions()
    staged = SRC.staged_head(head_path, opts.run_id) if head_path and dictionary is not None else head_path
    if staged != head_path:
        SRC.write_dictionary(dictionary, opts.run_id, staged)
    res = HD.fit_head(train_features, val_features, n_classes, features_col, label_col, key, opts,
                      history_path=history_path, head_path=staged)
    if staged != head_path:
        SRC.publish_head(train_features.sparkSession, staged, head_path, opts.run_id)
    return res


def analyze(scored: DataFrame, dictionary: DataFrame, top_classes: int = 20, top_errors: int = 10,
            n_examples: int = 10, seed: int = 42, key: str = "id",
            tensors: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
            matrix_form: str = "auto") -> dict[str, DataFrame]:
    """Every error-analysis table from one scored frame (cache ``scored`` upstream).

    The confusion counts (at most C^2 rows) feed every table, so they are
    materialised once with a reliable checkpoint.  ``matrix_form``: see
    ``confusion_matrix``; cells of classes outside the dictionary are in
    ``confusion_outside``.  ``tensors`` (key, tensor; or a function of the
    examples' keys that gives it) adds the pictures of the examples.
    """
    counts = E.confusion_counts(scored).checkpoint(eager=True)
    n_classes = dictionary.count()
    cm = E.confusion_matrix(counts, dictionary, n_classes=n_classes, form=matrix_form)
    errors = E.class_errors(counts, dictionary)
    hard = E.hardest_classes(errors, top_classes, n_classes=n_classes)
    sub = E.submatrix(cm, hard)
    return {
        "metrics": E.epoch_metrics(scored),
        "confusion": cm,
        "confusion_outside": E.outside_cells(counts, dictionary),
        "heatmap": E.heatmap_cells(counts),
        "class_errors": errors,
        "hardest": hard,
        "hardest_matrix": sub,
        "hardest_heatmap": E.heatmap_cells(sub.select(F.col("true_rank").alias("true_idx"),
                                                      F.col("pred_rank").alias("pred_idx"), "n")),
        "top_confusions": E.top_confusions(counts, dictionary, top_errors),
        "examples_correct": E.example_predictions(scored, dictionary, n_examples, True, seed, key, tensors=tensors),
        "examples_incorrect": E.example_predictions(scored, dictionary, n_examples, False, seed, key, tensors=tensors),
    }
