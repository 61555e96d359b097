"""Command line: one subcommand per job of the original pipeline.

    python -m samplecraft.cli prepare --manifest train=meta/train.txt --manifest test=meta/test.txt \
        --image-root /data/images --out /tables/metadata
    python -m samplecraft.cli random  --table /tables/metadata -n 5
    python -m samplecraft.cli tensors --table /tables/metadata --images /data/images --out /tables/tensors
    python -m samplecraft.cli train   --table /tables/metadata --features /tables/features \
        --run-id effnet --history /tables/history --heads /tables/heads [--classes a,b,c] [--small]
    python -m samplecraft.cli analyze --table /tables/metadata --features /tables/features \
        --heads /tables/heads --run-id effnet --out /tables/analysis
    python -m samplecraft.cli runlog  --path logs/

``--features`` is a Parquet table ``(image_path STRING, features ARRAY<FLOAT|DOUBLE>)``:
the frozen network's output, which stands in for the convolutional backbone.
The session comes from ``SparkSession.builder.getOrCreate()``, so cluster
settings (master, ``spark.checkpoint.dir``, ...) are taken as configured.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as E
from .operators import head as HD
from .operators import history as H
from .plans import workflows as WF
from .session import clear_scratch, ensure_checkpoint_dir, scratch_count
from .sources import metadata as SRC
from .sources import run_log as RL


def _show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def _features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("image_path", F.col("features").cast("array<double>").alias("features"))


def _encoded_features(spark, args, tables):
    feats = _features(spark, args.features)

    def join(df):
        return (df.where(F.col("label_idx").isNotNull()).join(feats, "image_path", "inner")
                  .select(F.col("image_path").alias("id"), "label_idx", "features"))
    return join(tables.train), join(tables.test)


def cmd_prepare(spark, args) -> None:
    manifests = dict(m.split("=", 1) for m in args.manifest)
    prep = WF.prepare_metadata(spark, manifests, args.image_root, args.out, args.ext)
    _show(prep.stats)
    _show(prep.preview)
    print(f"rejected lines: {prep.rejects.count()}")


def cmd_random(spark, args) -> None:
    _show(WF.random_records(spark, args.table, args.n, args.seed), args.n)


def cmd_train(spark, args) -> None:
    classes = [c for c in (args.classes or "").split(",") if c]
    tables = WF.training_tables(spark, args.table, classes or None)
    _show(tables.consistency.where(F.col("side") != "both"))
    n_classes = tables.dictionary.count()
    train, val = _encoded_features(spark, args, tables)
    if args.small:  # the small run: no weight decay, schedule or early stop
        opts = HD.HeadOptions(lr=args.lr, weight_decay=0.0, epochs=args.epochs, patience=None,
                              plateau_factor=None, steps_per_epoch=args.steps, seed=args.seed, run_id=args.run_id)
    else:
        opts = HD.HeadOptions(lr=args.lr, epochs=args.epochs, patience=args.patience,
                              steps_per_epoch=args.steps, seed=args.seed, run_id=args.run_id)
    opts.batch_size = args.batch_size
    res = WF.train(train, val, n_classes, args.history, args.heads, opts, dictionary=tables.dictionary)
    if res.skipped_train or res.skipped_val:
        print(f"rows without a usable vector: {res.skipped_train} train, {res.skipped_val} test")
    if args.log:
        RL.write_run_log(res.run, res.history.drop("lr", "improved"), args.log)
    for name, row in H.history_arrays(res.history.drop("lr", "improved")).first().asDict().items():
        if name != "run_id":
            print(f"{name} = {row}")
    print(f"seconds = {res.run.first().seconds}")


def cmd_tensors(spark, args) -> None:
    """Encoded rows of one split with their preprocessed images, written as Parquet."""
    classes = [c for c in (args.classes or "").split(",") if c]
    tables = WF.training_tables(spark, args.table, classes or None)
    rows = tables.train if args.split == "train" else tables.test
    res = WF.tensors(spark, rows, args.images, args.split == "train", args.size, args.seed, args.epoch)
    res.tensors.write.mode("overwrite").parquet(args.out)
    print(f"rows without a usable image: {res.invalid.count()}")


def cmd_analyze(spark, args) -> None:
    # the names and numbers of the classes are those the head was trained with
    SRC.finish_commit(spark, args.heads, args.run_id)
    tables = WF.training_tables(spark, args.table, dictionary=SRC.read_dictionary(spark, args.heads, args.run_id))
    _show(tables.consistency.where(F.col("side") != "both"))
    unknown = tables.test.where(F.col("label_idx").isNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    print(f"test rows with a label the head does not know: {unknown.agg(F.coalesce(F.sum('n'), F.lit(0))).first()[0]}")
    _, val = _encoded_features(spark, args, tables)
    w, b = HD.head_arrays(SRC.read_head(spark, args.heads, args.run_id, args.kind), args.run_id, args.kind)
    n_classes = tables.dictionary.count()
    if n_classes != len(b):
        raise ValueError(f"run {args.run_id}: the head has {len(b)} classes, its dictionary {n_classes}")
    scored = E.score(val, features_col="features", weights=w.tolist(), bias=b.tolist()).cache()
    pictures = None
    if args.images:  # only the examples' files are opened
        def pictures(keys):
            rows = keys.withColumnRenamed("id", "image_path")
            got = WF.tensors(spark, rows, args.images, False, args.size).tensors
            return got.withColumnRenamed("image_path", "id")
    out = WF.analyze(scored, tables.dictionary, args.top_classes, args.top_errors, args.examples, args.seed,
                     tensors=pictures, matrix_form=args.matrix)
    out["unknown_labels"] = unknown
    _show(out["metrics"])
    _show(out["top_confusions"])
    if args.out:
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")


def cmd_runlog(spark, args) -> None:
    runs, hist = RL.scan_run_log(spark, args.path, line_sep=args.line_sep)
    _show(H.run_summary(runs, hist), 100)
    rejected = RL.rejected_blocks(spark, args.path, line_sep=args.line_sep)
    print(f"blocks without a run header: {rejected.count()}")
    stops = H.early_stop(hist, args.patience).groupBy("run_id").agg(F.max("stop_epoch").alias("stop_epoch"))
    best = H.best_checkpoint(hist, args.patience)
    cuts = (H.plateau_lr(hist).where("cut").groupBy("run_id")
            .agg(F.array_sort(F.collect_list("epoch")).alias("lr_cut_after_epochs")))
    _show(stops.join(best, "run_id", "left").join(cuts, "run_id", "left").orderBy("run_id"), 100)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="samplecraft")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("prepare", help="manifests -> partitioned metadata table")
    a.add_argument("--manifest", action="append", required=True, help="split=path (repeatable)")
    a.add_argument("--image-root", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--ext", default=".jpg")
    a = sub.add_parser("random", help="seeded random rows of the table")
    a.add_argument("--table", required=True)
    a.add_argument("-n", type=int, default=5)
    a.add_argument("--seed", type=int, default=42)
    helps = {"train": "fit a linear head on a feature table (history and heads written as it goes)",
             "analyze": "score the test split and write every error-analysis table"}
    for name in ("train", "analyze"):
        a = sub.add_parser(name, help=helps[name])
        a.add_argument("--table", required=True)
        a.add_argument("--features", required=True)
        a.add_argument("--heads", required=True)
        a.add_argument("--run-id", default="run")
        a.add_argument("--seed", type=int, default=42)
        if name == "train":
            a.add_argument("--history")
            a.add_argument("--classes")
            a.add_argument("--epochs", type=int, default=20)
            a.add_argument("--lr", type=float, default=1e-3)
            a.add_argument("--patience", type=int, default=5)
            a.add_argument("--steps", type=int, default=1, help="optimisation steps per epoch")
            a.add_argument("--batch-size", type=int, help="rows per optimisation step (sets --steps)")
            a.add_argument("--log", help="also write the run as a run-log text folder")
            a.add_argument("--small", action="store_true", help="no weight decay, schedule or early stop")
        else:
            a.add_argument("--kind", default="best", choices=("best", "final"))
            a.add_argument("--top-classes", type=int, default=20)
            a.add_argument("--top-errors", type=int, default=10)
            a.add_argument("--examples", type=int, default=10)
            a.add_argument("--images", help="folder of the image files: adds the examples' pictures")
            a.add_argument("--size", type=int, default=224)
            a.add_argument("--matrix", default="auto", choices=("auto", "dense", "sparse"))
            a.add_argument("--out")
    a = sub.add_parser("tensors", help="preprocessed images of one split")
    a.add_argument("--table", required=True)
    a.add_argument("--images", required=True, help="folder of the image files")
    a.add_argument("--out", required=True)
    a.add_argument("--split", default="train", choices=("train", "test"))
    a.add_argument("--classes")
    a.add_argument("--size", type=int, default=224)
    a.add_argument("--epoch", type=int, default=0)
    a.add_argument("--seed", type=int, default=42)
    a = sub.add_parser("runlog", help="summaries and epoch rules of a run log")
    a.add_argument("--path", required=True)
    a.add_argument("--patience", type=int, default=5)
    a.add_argument("--line-sep", default="\n")
    return p


COMMANDS = {"prepare": cmd_prepare, "random": cmd_random, "tensors": cmd_tensors, "train": cmd_train,
            "analyze": cmd_analyze, "runlog": cmd_runlog}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"samplecraft-{args.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    before = scratch_count()
    try:
        COMMANDS[args.cmd](spark, args)
    finally:
        clear_scratch(spark, before)


if __name__ == "__main__":
    main(sys.argv[1:])
