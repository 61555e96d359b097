"""The hand-kept run log (text blocks) <-> ``runs`` + ``history`` tables.

A block is: a header line, up to four ``name = [v, v, ...]`` lists (a list may
break over lines, a key may repeat: the first one wins, a missing list gives
NULLs), and a closing line with the elapsed seconds.  Blocks are separated by
a blank line, so ``spark.read.text(lineSep='\\n\\n')`` yields one row per block
and files are split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import HISTORY_COLUMNS, HISTORY_METRICS, RUNS_COLUMNS

# The log's wording (Russian), which must match the text being read.
#   header:  "<model> на <N> классах <E> эпох батч <B>:"   (N may be "всех" = all classes)
#   footer:  "Обучение завершено за <S> секунд."
#   list keys: train_losses, train_accs, val_losses, val_accs
HEADER_RE = r"^\s*(.+?) на (\S+) класс\S* (\d+) эпох батч (\d+):"
HEADER_SPLIT_RE = r"(?m)(?=^[^\n]+ на \S+ класс\S* \d+ эпох батч \d+:)"
SECONDS_RE = r"([\d.]+) секунд"
ALL_CLASSES_WORD = "всех"
HEADER_FMT = "%s на %s классах %d эпох батч %d:"
FOOTER_FMT = "Обучение завершено за %.2f секунд."
LIST_KEYS = {"train_loss": "train_losses", "train_acc": "train_accs",
             "val_loss": "val_losses", "val_acc": "val_accs"}


def _list(block: Column, key: str) -> Column:
    """The list's numbers (``nan`` and ``inf`` as such, any other word NULL); NULL where there is no list."""
    pattern = r"(?s)\b" + key + r" = \[([^\]]*)\]"
    raw = F.regexp_extract(block, pattern, 1)
    items = F.transform(F.split(raw, ","), lambda x: F.trim(F.translate(x, "\n\t", "  ")).try_cast("double"))
    return F.when(F.trim(F.translate(raw, "\n\t", "  ")) != "", items).when(block.rlike(pattern), F.array().cast("array<double>"))


def parse_run_blocks(blocks: DataFrame, col: str = "value") -> DataFrame:
    """One row per block: run attributes plus the four metric arrays (other columns are kept).

    Blocks without a header line are left out; ``rejected_blocks`` has them.
    """
    b = F.col(col)
    cls = F.regexp_extract(b, HEADER_RE, 2)
    extra = [c for c in blocks.columns if c != col]
    out = blocks.select(
        *extra,
        F.regexp_extract(b, HEADER_RE, 1).alias("model"),
        cls.try_cast("int").alias("n_classes"),
        F.regexp_extract(b, HEADER_RE, 3).try_cast("int").alias("epochs_asked"),
        F.regexp_extract(b, HEADER_RE, 4).try_cast("int").alias("batch_size"),
        F.regexp_extract(b, SECONDS_RE, 1).try_cast("double").alias("seconds"),
        cls.alias("_scope"),
        *[_list(b, LIST_KEYS[m]).alias("_" + m) for m in HISTORY_METRICS])
    out = out.where(F.col("model") != F.lit(""))
    return out.withColumn("run_id", F.concat_ws(" ", "model", "_scope", "epochs_asked", "batch_size"))


def _blocks(spark: SparkSession, path: str, line_sep: str) -> DataFrame:
    """(file, part, pos, sub, value): one row per run, in file order by these columns.

    Text is read in blank-line separated chunks (so files split across tasks)
    and every chunk is also cut before each header line, so Windows line ends
    or a missing blank line between runs still give one block per run.
    """
    pos = F.monotonically_increasing_id()
    chunks = spark.read.text(path, lineSep=line_sep * 2).select(
        F.regexp_replace("value", "\r", "").alias("value"), F.input_file_name().alias("_file"),
        F.shiftright(pos, 33).alias("_part"), pos.alias("_pos"))
    blocks = chunks.select("_file", "_part", "_pos", F.posexplode(F.split("value", HEADER_SPLIT_RE)).alias("_sub", "value"))
    return blocks.where(F.trim(F.translate("value", "\n\t", "  ")) != "")


def rejected_blocks(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """The text blocks of a log that do not begin with a run's header line (``file``, ``value``)."""
    b = _blocks(spark, path, line_sep)
    return b.where(F.regexp_extract("value", HEADER_RE, 1) == "").select(F.col("_file").alias("file"), "value")


def scan_run_log(spark: SparkSession, path: str, line_sep: str = "\n") -> tuple[DataFrame, DataFrame]:
    """Read a run log into ``(runs, history)``.

    ``run_id`` = model, class scope, epochs and batch joined by spaces; when
    the same header appears more than once, later blocks get ``#2``, ``#3``...
    in file order.  Repeats are numbered inside each input split and shifted
    by the counts of the splits before it, so a header that most runs share is
    not one task's work.
    """
    parsed = parse_run_blocks(_blocks(spark, path, line_sep))
    place = ["run_id", "_file", "_part"]
    counts = parsed.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("run_id").orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*place, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*place).orderBy("_pos", "_sub"))
    parsed = parsed.withColumn("_local", local).join(before, place).withColumn("_nth", F.col("_before") + F.col("_local"))
    parsed = parsed.withColumn(
        "run_id", F.when(F.col("_nth") > 1, F.concat("run_id", F.lit("#"), F.col("_nth").cast("string")))
                   .otherwise(F.col("run_id")))
    runs = parsed.select(*RUNS_COLUMNS)
    n = F.greatest(*[F.coalesce(F.size("_" + m), F.lit(0)) for m in HISTORY_METRICS])
    hist = (parsed.where(n > 0)
                  .select("run_id", *["_" + m for m in HISTORY_METRICS],
                          F.explode(F.sequence(F.lit(1), n)).alias("epoch"))
                  .select("run_id", F.col("epoch").cast("int").alias("epoch"),
                          *[F.get(F.col("_" + m), F.col("epoch") - 1).alias(m) for m in HISTORY_METRICS]))
    return runs, hist.select(*HISTORY_COLUMNS)


def format_run_log(runs: DataFrame, h: DataFrame) -> DataFrame:
    """Inverse of ``scan_run_log``: one text block per run (``value`` column)."""
    arrays = h.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("epoch", *HISTORY_METRICS))).alias("__e"))

    def line(m: str) -> Column:
        vals = F.transform("__e", lambda e: e[m])
        body = F.array_join(F.transform(vals, lambda v: v.cast("string")), ", ", "null")
        has_any = F.exists(vals, lambda v: v.isNotNull())
        return F.when(has_any, F.concat(F.lit(LIST_KEYS[m] + " = ["), body, F.lit("]")))

    scope = F.coalesce(F.col("n_classes").cast("string"), F.lit(ALL_CLASSES_WORD))
    header = F.format_string(HEADER_FMT, F.col("model"), scope, F.col("epochs_asked"), F.col("batch_size"))
    footer = F.format_string(FOOTER_FMT, F.col("seconds"))
    j = runs.join(arrays, "run_id", "inner")
    text = F.concat_ws("\n", header, *[line(m) for m in HISTORY_METRICS], footer)
    return j.select(F.concat(text, F.lit("\n")).alias("value"))


def write_run_log(runs: DataFrame, h: DataFrame, path: str) -> None:
    format_run_log(runs, h).write.mode("overwrite").text(path)
