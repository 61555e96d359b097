"""Seeded sampling, dense row index and mini-batches.

Randomness is an md5 order key (see ``functions.draws``), so results do not
depend on partitioning.  Rows with equal keys are ordered by a hash of all
their columns, so only rows that are equal in every column are
interchangeable, and a retried or re-read plan gives the same batches.

A dense index never pulls the table into one task.  D1 ranks rows inside
buckets of their order hash and shifts them by broadcast bucket offsets.  Any
other order, or a hash order with a hot bucket, ranks a projection of the sort
keys alone (equal rows pre-aggregated to one with a count), which is all that is
range-sorted and checkpointed, and joins the positions back to the rows; both
ways give the same index.

A table stored with ``write_indexed`` keeps which positions each of its files
holds, so ``fetch_indexed`` opens only the files of the positions asked for.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import order_hash
from ..session import ensure_checkpoint_dir
from ..util import as_col, row_hash, unused_name

TOP_N_ROWS = 1_000_000  # a larger sample is cut from the distributed index instead of a top-n merge


def random_sample(df: DataFrame, n: int, seed: int = 42, key: str | Sequence[str] = "id") -> DataFrame:
    """``n`` rows in seeded random order (fewer when the table is smaller).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every partition
    keeps its own top ``n``; no full sort, no shuffle of the table.  Its last
    merge is one task, so a sample above ``TOP_N_ROWS`` is taken by position
    from the distributed index of the same order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    h, tie = unused_name(df, "_order_hash"), unused_name(df, "_tie")
    tagged = df.withColumn(tie, row_hash(df)).withColumn(h, order_hash(seed, *keys))
    order = [F.col(h), *[F.col(k) for k in keys], F.col(tie)]
    if n > TOP_N_ROWS:
        idx = unused_name(tagged, "_row_idx")
        return dense_index(tagged, order, idx).where(F.col(idx) < n).drop(h, tie, idx)
    return tagged.orderBy(*order).limit(n).drop(h, tie)


HOT_EQUAL_ROWS = 100_000  # rows equal in every column, beyond which one of them stands for all
_SHARE = 1000             # ... and at least this part of the table, so there are no more than this many such groups
_COPIES = 1 << 16


def dense_index(df: DataFrame, order: Sequence, index_col: str = "row_idx") -> DataFrame:
    """Add a dense 0-based ``index_col`` following ``order``, ascending (Spark's order: NULLs first, NaN last).

    Rows with equal keys are ordered by two 64-bit hashes of the whole row, so
    only rows equal in every column are interchangeable.  The input is read
    twice: once for its keys and hashes, which are counted per distinct
    value, range-sorted and checkpointed (never the rows themselves), and once for
    the rows, which are shuffled once to meet their first position; equal rows
    are numbered on from it.  A group of equal rows that is much of the table
    is not shuffled: one of them is repeated as often as it was counted.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = [c for c in df.columns if c.lower() != index_col.lower()]
    keys = [unused_name(df, f"_key{i}") for i in range(len(order))] + [unused_name(df, x) for x in ("_tie0", "_tie1")]
    values = [as_col(o) for o in order] + [row_hash(df, 0), row_hash(df, 1)]
    keyed = df.select(*[F.col(f"`{c}`") for c in cols], *[v.alias(k) for v, k in zip(values, keys)])
    n, pid, start = (unused_name(keyed, x) for x in ("_n", "_pid", "_start"))
    ranked = (keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).orderBy(*keys)
              .withColumn(pid, F.spark_partition_id()).checkpoint(eager=True))
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a proven small side
    sizes = ranked.groupBy(pid).agg(F.sum(n).alias("m"))
    offsets = sizes.select(pid, F.coalesce(F.sum("m").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)).alias("off"))
    before = F.coalesce(F.sum(n).over(so_far.partitionBy(pid).orderBy(*keys)), F.lit(0))
    place = ranked.withColumn(start, before).join(F.broadcast(offsets), pid).select(
        *keys, n, (F.col("off") + F.col(start)).alias(start))

    total = ranked.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_EQUAL_ROWS, total // _SHARE)
    same = functools.reduce(lambda x, y: x & y, [keyed[k].eqNullSafe(place[k]) for k in keys])
    if not ranked.filter(hot).limit(1).count():
        hot, heavy = F.lit(False), None
    else:
        heavy = place.filter(hot)  # at most ``_SHARE`` groups
    rest = keyed if heavy is None else keyed.join(F.broadcast(heavy), same, "left_anti")
    met = rest.join(place.filter(~hot), functools.reduce(lambda x, y: x & y, [rest[k].eqNullSafe(place[k]) for k in keys]))
    met = met.select(*[rest[c] for c in cols], *[rest[k] for k in keys], start)
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(start)) - 1
    out = met.select(*[F.col(f"`{c}`") for c in cols], (F.col(start) + again).cast("long").alias(index_col))
    if heavy is None:
        return out
    one = (keyed.join(F.broadcast(heavy), same).select(*[keyed[k] for k in keys], n, start, F.struct(*[keyed[c] for c in cols]).alias("row"))
           .groupBy(*keys, n, start).agg(F.first("row").alias("row")))
    parts = one.select("row", n, start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_COPIES).cast("long"))).alias("lo"))
    parts = parts.repartition("lo", start)
    copies = parts.select("row", start, F.explode(F.sequence("lo", F.least(F.col("lo") + _COPIES, n) - 1)).alias("k"))
    return out.unionByName(copies.select(*[F.col("row").getField(c).alias(c) for c in cols],
                                         (F.col(start) + F.col("k")).alias(index_col)))


HOT_BUCKET_ROWS = 1_000_000


def hash_order_index(df: DataFrame, hash_col: Column, key: str, index_col: str = "row_idx",
                     prefix_digits: int = 4, hot_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """Dense 0-based rank by (hex hash, key): buckets are the first ``prefix_digits``
    hex digits, near-equal when the key is unique.

    Bucket row counts come first (one light scan, partial aggregation, at
    most ``16 ** prefix_digits`` rows to the driver).  Normally they become
    broadcast offsets for a ``row_number`` inside each bucket: one shuffle, no
    global sort, no checkpoint.  If a bucket holds more than ``hot_rows`` rows
    and far more than its share (a key repeated on a large share of the rows),
    ``dense_index`` ranks the same order, splitting the group across tasks.
    """
    if not 1 <= prefix_digits <= 5:
        raise ValueError("prefix_digits must be 1..5 (the bucket table is kept on the driver)")
    cols = [c for c in df.columns if c.lower() != index_col.lower()]
    max_buckets = 16 ** prefix_digits
    h, tie, b, r, off = (unused_name(df, x) for x in ("_h", "_tie", "_bucket", "_rank", "_off"))
    tagged = df.withColumn(tie, row_hash(df)).withColumn(h, hash_col)
    # a NULL bucket cannot occur (an md5 is never NULL), but a nullable one would be re-evaluated in joins
    tagged = tagged.withColumn(b, F.coalesce(F.conv(F.substring(h, 1, prefix_digits), 16, 10).cast("int"), F.lit(0)))
    order = [F.col(h), F.col(key), F.col(tie)]
    counts = tagged.groupBy(b).agg(F.count(F.lit(1)).alias("n")).toArrow()
    bucket = np.asarray(counts.column(b).to_numpy(), dtype=np.int32)
    n = np.asarray(counts.column("n").to_numpy(), dtype=np.int64)
    if len(n) and n.max() > max(hot_rows, 8 * n.sum() / max_buckets):
        return dense_index(tagged, order, index_col).select(*cols, index_col)
    by = np.argsort(bucket, kind="stable")
    start = np.cumsum(n[by]) - n[by]
    offsets = df.sparkSession.createDataFrame(pa.table({b: pa.array(bucket[by], pa.int32()),
                                                        off: pa.array(start.astype(np.int64), pa.int64())}))
    ranked = tagged.withColumn(r, F.row_number().over(Window.partitionBy(b).orderBy(*order)) - 1)
    out = ranked.join(F.broadcast(offsets), b)
    return out.select(*cols, (F.col(off) + F.col(r)).cast("long").alias(index_col))


def key_order_index(df: DataFrame, key: str, index_col: str = "row_idx") -> DataFrame:
    """Dense rank by ``key``, of any sortable type: NULL keys come first, equal keys are
    ordered by their other columns (``dense_index``)."""
    return dense_index(df, [F.col(key)], index_col)


def _with_batch(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col("row_idx") / F.lit(size)).cast("long"))


def shuffle_batches(df: DataFrame, size: int, seed: int = 42, epoch: int = 0,
                    key: str = "id", hot_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """A new seeded order per epoch, ``row_idx`` and ``batch_id = row_idx div size``.

    Order = ``md5('<seed>:<epoch>:<key>')`` then key; rows sharing a key
    (copies) are placed next to each other.  The last partial batch is kept.
    """
    if size <= 0:
        raise ValueError("batch size must be positive")
    return _with_batch(hash_order_index(df, order_hash(seed, F.lit(epoch), key), key, hot_rows=hot_rows),
                       size)


def sequential_batches(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Batches in key order (the stored order made explicit)."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return _with_batch(key_order_index(df, key), size)


def fetch_rows(df: DataFrame, indices, index_col: str = "row_idx") -> DataFrame:
    """Rows at the given positions (a list, or a DataFrame with ``index_col``)."""
    if isinstance(indices, DataFrame):
        return df.join(indices.select(index_col).distinct(), index_col, "left_semi")
    idx = sorted({int(i) for i in indices})
    if not idx:
        return df.limit(0)
    spark = df.sparkSession
    keys = spark.createDataFrame([(i,) for i in idx], f"{index_col} long")  # the caller's list: driver-sized
    return df.join(keys, index_col, "left_semi")


def write_indexed(df: DataFrame, path: str, index_col: str = "row_idx", rows_per_file: int = 1_000_000) -> None:
    """Store an indexed table so that each file holds one range of positions; beside it, the table of these ranges."""
    n = df.agg(F.max(index_col)).first()[0]
    files = 1 if n is None else int(n) // rows_per_file + 1
    dealt = df.withColumn("part", F.floor(F.col(index_col) / rows_per_file).cast("int"))
    out = dealt.repartition(files, "part").sortWithinPartitions("part", index_col).write.mode("overwrite")
    (out if n is None else out.partitionBy("part")).parquet(path)  # an empty table keeps its columns in a file
    stored = df.sparkSession.read.parquet(path)
    (stored.groupBy(F.col("_metadata.file_path").alias("file"), "part").agg(F.min(index_col).alias("lo"), F.max(index_col).alias("hi"))
     .withColumn("rows_per_file", F.lit(rows_per_file)).coalesce(1).write.mode("overwrite").parquet(ranges_path(path)))


def ranges_path(path: str) -> str:
    return path.rstrip("/") + "_ranges"


def fetch_indexed(spark: SparkSession, path: str, indices, index_col: str = "row_idx") -> DataFrame:
    """B5 over a table of ``write_indexed``: only the files that hold the given positions are opened.

    ``indices``: a list, or a DataFrame with ``index_col``, of which only the
    files it points to come to the driver (at most as many as the table has).
    """
    schema = spark.read.parquet(path).drop("part").schema
    ranges = spark.read.parquet(ranges_path(path))
    if isinstance(indices, DataFrame):
        size = ranges.agg(F.max("rows_per_file")).first()[0] or 1
        asked = indices.select(F.floor(F.col(index_col) / size).cast("int").alias("part")).distinct()
        files = [r.file for r in ranges.join(asked, "part", "left_semi").select("file").collect()]
        wanted = None
    else:
        wanted = sorted({int(i) for i in indices})
        known = sorted((r.lo, r.hi, r.file) for r in ranges.collect())  # one row per file
        lows = [lo for lo, _, _ in known]
        at = [bisect_right(lows, i) - 1 for i in wanted]
        files = sorted({known[k][2] for k, i in zip(at, wanted) if k >= 0 and i <= known[k][1]})
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if wanted is not None:  # the bounds reach the row groups' statistics, the list itself is joined
        rows, indices = rows.where(F.col(index_col).between(wanted[0], wanted[-1])), wanted
    return fetch_rows(rows, indices, index_col).select(*schema.names)
