"""Text manifests and the Parquet tables of the library."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import HEAD, HEAD_COLUMNS, HISTORY, HISTORY_COLUMNS, METADATA, METADATA_COLUMNS


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A1: manifest text -> stripped, non-blank lines (``value STRING``).

    ``spark.read.text`` splits files across tasks; strip and filter are
    Catalyst expressions in the same stage.
    """
    lines = spark.read.text(path)
    return lines.select(strip("value").alias("value")).where(F.col("value") != F.lit(""))


def write_metadata(df: DataFrame, path: str) -> None:
    """A4: replace the metadata table (both splits in one write), partitioned by split."""
    (df.select(*METADATA_COLUMNS).write.mode("overwrite")
       .partitionBy("dataset_type").parquet(path))


def read_metadata(spark: SparkSession, path: str, split: str | None = None,
                  columns: tuple[str, ...] = ("image_path", "label")) -> DataFrame:
    """A5: declared-schema scan; a split filter prunes partitions, ``columns`` prunes columns."""
    df = spark.read.schema(METADATA).parquet(path).select(*METADATA_COLUMNS)
    if split is not None:
        df = df.where(F.col("dataset_type") == F.lit(split))
    return df.select(*columns)


def _replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write, replacing only the partitions that ``df`` has rows of: a rerun gives the same table."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def write_history(h: DataFrame, path: str) -> None:
    """The epoch rows of one or more runs, partitioned by run; replaces earlier rows of these runs."""
    _replace_partitions(h.select(*HISTORY_COLUMNS), path, "run_id")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path).select(*HISTORY_COLUMNS)


def write_head(head: DataFrame, path: str) -> None:
    """Save a linear head (one row per class) as M12 rows; replaces the run's head of that kind."""
    _replace_partitions(head.select(*HEAD_COLUMNS), path, "run_id", "kind")


def dictionary_path(head_path: str) -> str:
    """The table beside a table of heads that has the class names of each run's rows."""
    return head_path.rstrip("/") + "_classes"


def write_dictionary(dictionary: DataFrame, run_id: str, head_path: str) -> None:
    """The class dictionary that a run's head was trained with."""
    rows = dictionary.select(F.lit(run_id).alias("run_id"), F.col("label_idx").cast("int").alias("label_idx"), "label")
    _replace_partitions(rows, dictionary_path(head_path), "run_id")


# A run's head and dictionary change together.  Training writes both to a staged folder; publishing creates one
# small file that names this folder (the commit: it is there or it is not), replaces the run's partitions of the
# two tables, and removes the file.  While the file is there, readers take both from the staged folder, so they
# never see a new head with old names; a job that dies before the commit leaves the old pair as it was, and one that
# dies after it has published the new one.

def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _marker(head_path: str, run_id: str) -> str:
    return f"{head_path.rstrip('/')}_commits/{quote(run_id, safe='')}"


def staged_head(head_path: str, run_id: str) -> str:
    """A fresh folder, beside the tables of heads, for a run's heads and dictionary until they are published."""
    return f"{head_path.rstrip('/')}_staged/{quote(run_id, safe='')}-{uuid.uuid4().hex}/heads"


def _committed(spark: SparkSession, head_path: str, run_id: str) -> str | None:
    """The staged heads of a commit that is not finished."""
    fs, p = _files(spark, _marker(head_path, run_id))
    return spark.read.text(p.toString()).first()[0] if fs.exists(p) else None


def publish_head(spark: SparkSession, staged: str, head_path: str, run_id: str) -> None:
    """Make the heads and the dictionary at ``staged`` those of ``run_id``, as one change."""
    finish_commit(spark, head_path, run_id)
    fs, p = _files(spark, _marker(head_path, run_id))
    fs, new = _files(spark, _marker(head_path, run_id) + f".{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(staged.encode()))
    out.close()
    if not fs.rename(new, p):
        raise RuntimeError(f"could not commit {p.toString()}")
    finish_commit(spark, head_path, run_id)


def finish_commit(spark: SparkSession, head_path: str, run_id: str) -> None:
    """Carry a commit that was made into the two tables (nothing to do if there is none); may be repeated."""
    staged = _committed(spark, head_path, run_id)
    if staged is None:
        return
    write_head(spark.read.schema(HEAD).parquet(staged).where(F.col("run_id") == run_id), head_path)
    names = spark.read.schema(_DICTIONARY).parquet(dictionary_path(staged)).where(F.col("run_id") == run_id)
    write_dictionary(names, run_id, head_path)
    for path in (_marker(head_path, run_id), staged.rsplit("/", 1)[0]):
        fs, p = _files(spark, path)
        fs.delete(p, True)


_DICTIONARY = "label_idx int, label string, run_id string"


def read_dictionary(spark: SparkSession, head_path: str, run_id: str) -> DataFrame:
    """(label_idx, label) of a run's head."""
    at = _committed(spark, head_path, run_id) or head_path
    return (spark.read.schema(_DICTIONARY).parquet(dictionary_path(at))
            .where(F.col("run_id") == run_id).select("label_idx", "label"))


def read_head(spark: SparkSession, path: str, run_id: str | None = None, kind: str | None = None) -> DataFrame:
    at = path if run_id is None else _committed(spark, path, run_id) or path
    df = spark.read.schema(HEAD).parquet(at).select(*HEAD_COLUMNS)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    return df
