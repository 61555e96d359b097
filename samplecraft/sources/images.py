"""Image files -> RGB HWC tensors.

Decoding is Spark's own ``image`` data source (files split across tasks);
the channel fix (BGR -> RGB, gray -> three copies, alpha dropped) runs in the
Arrow-batched NumPy stage of ``operators.tensors``, either alone
(``scan_images``) or fused with a whole preprocessing pipeline
(``read_images`` + ``pipeline``).  ``invalid='drop'`` drops undecodable files,
``invalid='flag'`` keeps them with ``tensor = NULL`` so they can be counted.

``listed_images`` reads only the files that a table of rows names, block by block.  Paths are
compared as full, unescaped URIs (``path_key``): a row's path without a scheme
belongs to the folder's file system, and equal keys in two buckets differ.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from ..util import row_hash, unused_name

MAX_LISTED = 100_000      # rows of a block: its files are read by name, its rows are broadcast to the scan
BLOCK_BYTES = 64 << 20    # ... and at most about this many bytes of rows


def _load(spark: SparkSession, paths: str | Sequence[str], invalid: str) -> DataFrame:
    if invalid not in ("drop", "flag"):
        raise ValueError("invalid must be 'drop' or 'flag'")
    raw = spark.read.format("image").option("dropInvalid", invalid == "drop")
    if isinstance(paths, str):
        raw = raw.option("recursiveFileLookup", "true")  # images live in class/ sub-folders
    return raw.load(paths if isinstance(paths, str) else list(paths)).select(
        F.col("image.origin").alias("path"), F.col("image").alias("image"))


def read_images(spark: SparkSession, path: str, invalid: str = "drop") -> DataFrame:
    """Spark's image source as is: ``(path, image)`` with 8-bit BGR(A) bytes.

    Feed ``image`` straight into ``operators.tensors.pipeline``: the channel
    fix then happens in the pipeline's fused NumPy stage and pixels cross to
    Python as bytes, a quarter of the float size.
    """
    return _load(spark, path, invalid)


def scan_images(spark: SparkSession, path: str, invalid: str = "drop") -> DataFrame:
    """Read images under ``path`` into ``(path, tensor)``: RGB, HWC, values 0..255.

    Undecodable files are dropped (``invalid='drop'``) or kept with
    ``tensor = NULL`` (``invalid='flag'``) so they can be counted.
    """
    from ..operators.tensors import apply_numpy_steps
    ship_package(spark)
    raw = read_images(spark, path, invalid).withColumnRenamed("image", "tensor")
    return apply_numpy_steps(raw, [], "tensor")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def file_system(spark: SparkSession, path: str) -> str:
    """Scheme and authority of ``path`` (``file:``, ``hdfs://nn:8020``); the session's default where it has none."""
    at = path if re.match(_SCHEME, path) else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    scheme, rest = at.split(":", 1)
    host = rest[2:].split("/", 1)[0] if rest.startswith("//") else ""
    return f"{scheme}://{host}" if host else f"{scheme}:"


def path_key(c, default: str = "file:", escaped: bool = False) -> F.Column:
    """A path as ``scheme://authority/path`` (``file:/path``), so that metadata paths and
    image-source origins compare.

    ``default``: scheme and authority of a path without a scheme.  ``escaped``:
    the path is a URI with percent escapes, as origins are.
    """
    col = F.col(c) if isinstance(c, str) else c
    full = F.when(col.rlike(_SCHEME), col).otherwise(F.concat(F.lit(default), col))
    full = F.regexp_replace(full, r"^([A-Za-z][A-Za-z0-9+.\-]*:)///?(?=/)", "$1")
    full = F.regexp_replace(full, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//(?=/)", "$1")
    return F.coalesce(F.try_url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), full) if escaped else full


def attach_images(meta: DataFrame, images: DataFrame, path_col: str = "image_path", folder: str | None = None) -> DataFrame:
    """Join scanned tensors (or raw images) to metadata rows by path.

    ``folder``: where the images were read from; paths without a scheme are
    on its file system.  Both sides are table-sized, so this is a shuffle join;
    ``listed_images`` avoids it.
    """
    value = next(c for c in images.columns if c != "path")
    key = unused_name(meta, "_path_key")
    default = file_system(meta.sparkSession, folder or "/")
    right = images.select(path_key("path", default, escaped=True).alias(key), F.col(value))
    return meta.withColumn(key, path_key(path_col, default)).join(right, key, "left").drop(key)


def listed_images(spark: SparkSession, rows: DataFrame, folder: str, path_col: str = "image_path",
                  max_listed: int = MAX_LISTED) -> DataFrame:
    """``rows`` with the raw ``image`` of each row's file (NULL where it is missing or undecodable).

    The folder is listed without reading a file.  The rows are dealt into blocks
    of about ``max_listed`` rows or ``BLOCK_BYTES``, by path, so a file is opened for one
    block only (for several if more rows than a block has name it).  Every block
    is the same plan: its existing files, a list as long as a block at most,
    are scanned by name and meet the block's rows by a broadcast, so no pixel is
    shuffled.  All blocks but the last are written to the scratch folder one
    after another, so the driver holds one block's list at a time.
    """
    default = file_system(spark, folder)
    key, block = unused_name(rows, "_path_key"), unused_name(rows, "_block")
    image = "image"
    keyed = rows.withColumn(key, path_key(path_col, default))
    there = stored_paths(spark, folder, default, key)
    sized = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(keyed)).alias("b"))
    m = sized.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("n").alias("hot")).first()
    blocks = max(1, -(-(m["n"] or 0) // max_listed), -(-(m["b"] or 0) // BLOCK_BYTES))
    salts = max(1, -(-(m["hot"] or 0) // max_listed))
    salt = F.pmod(row_hash(rows), F.lit(salts)) if salts > 1 else F.lit(0)
    dealt = keyed.withColumn(block, F.pmod(F.xxhash64(key, salt), F.lit(blocks)))
    wanted = dealt.select(key, block).distinct().join(there, key, "left_semi")

    def scan(k: int) -> DataFrame | None:
        paths = [r[key] for r in wanted.where(F.col(block) == k).select(key).collect()]
        if not paths:
            return None
        glob = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
        found = _load(spark, glob, "flag").select(path_key("path", default, escaped=True).alias(key), F.col(image))
        mine = dealt.where(F.col(block) == k).drop(block)
        return found.join(F.broadcast(mine), key).select(*rows.columns, image)

    parts = []
    for k in range(blocks):
        part = scan(k)
        if part is not None and k < blocks - 1:
            path = scratch_path(spark, f"images-{k}")
            part.write.parquet(path)
            part = spark.read.schema(part.schema).parquet(path)
        if part is not None:
            parts.append(part)
    schema = parts[0].schema[image].dataType if parts else spark.read.format("image").schema["image"].dataType
    missing = keyed.join(there, key, "left_anti").drop(key).withColumn(image, F.lit(None).cast(schema))
    return functools.reduce(DataFrame.unionByName, parts, missing)


def stored_paths(spark: SparkSession, folder: str, default: str, key: str) -> DataFrame:
    """The paths of all files under ``folder``, listed once, as a table with the one column ``key``."""
    path = scratch_path(spark, "image-paths")
    (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
     .select(path_key("path", default, escaped=True).alias(key)).write.parquet(path))
    return spark.read.schema(f"`{key}` string").parquet(path)


def _row_bytes(df: DataFrame) -> F.Column:
    """About how many bytes a row takes; strings, binaries and arrays by their length."""
    total = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        part = (F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind in ("array", "map")
                else F.octet_length(F.to_json(c)) if kind == "struct" else F.lit(8))
        total = total + F.greatest(F.coalesce(part, F.lit(0)), F.lit(0))
    return total.cast("long")


# ---- PNG writing (fixtures only) ------------------------------------------

def png_bytes(pixels: np.ndarray) -> bytes:
    """Encode an (H, W) or (H, W, 3) uint8 array as a PNG (no filtering)."""
    if pixels.ndim == 2:
        color, channels = 0, 1
    else:
        color, channels = 2, pixels.shape[2]
    h, w = pixels.shape[0], pixels.shape[1]
    raw = b"".join(b"\x00" + pixels[y].reshape(-1).astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) & 0xFFFFFFFF)
    del channels
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def write_png_files(df: DataFrame, folder: str, key_col: str = "key", tensor_col: str = "tensor") -> int:
    """Write each 8-bit tensor as ``<folder>/<key>.png`` from the tasks; returns the count.

    The folder must be a path every executor can write with plain file I/O
    (a shared mount); Spark has no binary-file writer.
    """
    import os

    ship_package(df.sparkSession)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for rb in batches:
            keys = rb.column(0).to_pylist()
            tens = rb.column(1).to_pylist()
            for k, t in zip(keys, tens):
                a = np.clip(np.asarray(t["data"], dtype=np.float64), 0, 255).astype(np.uint8)
                a = a.reshape(t["height"], t["width"], t["channels"])
                if a.shape[2] == 1:
                    a = a[..., 0]
                with open(os.path.join(folder, f"{k}.png"), "wb") as fh:
                    fh.write(png_bytes(a))
            yield pa.RecordBatch.from_arrays([pa.array([rb.num_rows], pa.int64())], names=["n"])

    src = df.select(key_col, tensor_col).repartition(df.sparkSession.sparkContext.defaultParallelism)
    out = src.mapInArrow(run, "n long")
    return int(out.agg(F.sum("n")).collect()[0][0] or 0)
