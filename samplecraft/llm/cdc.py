"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; where ``CUT_BITS`` of its bits are
zero a chunk ends.  Bit k depends on the last k + 1 bytes, so with bits below
``WINDOW`` chunks depend on the ``WINDOW`` bytes before their ends and not on
their place: an insertion changes the chunks around it only.  Cuts closer than
``MIN_BYTES`` to the cut before are dropped, chunks above ``MAX_BYTES`` are cut
on, and a cut never parts a character.  Chunks with equal 128-bit digests are
copies; the one with the smallest (id, place) stays, and runs of other copies
of at least ``MIN_SPAN`` characters are repeated spans.

The hash runs over Arrow batches in NumPy; equal digests meet by an
aggregation that is partial before the shuffle, and a join.

Nulls: a null text has no chunks; a null id sorts first.  Rows that repeat both
id and text are one document: both stay.  Empty texts and tables give no spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..util import unused_name
from .text import byte_view, mix64, sub_batches

WINDOW = 16
CUT_BITS = 5
MIN_BYTES = 8
MAX_BYTES = 512
MIN_SPAN = 40
_CUT = np.uint32((1 << WINDOW) - (1 << (WINDOW - CUT_BITS)))
_GEAR = (mix64(np.arange(256)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The low ``WINDOW`` bits of h(i) = (h(i-1) << 1) + gear[byte i], from zero at the start of each text.

    The shift moves bytes ``WINDOW`` back out of these bits, so the sum over
    the window is built by doubling: four vector additions for 16 bytes.
    """
    n_docs = len(off) - 1
    place = np.arange(len(data)) + WINDOW * (1 + np.repeat(np.arange(n_docs), np.diff(off)))
    h = np.zeros(len(data) + WINDOW * (n_docs + 1), np.uint32)
    h[place] = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h[place] & np.uint32((1 << WINDOW) - 1)


def chunk_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, end byte) of every chunk, in order."""
    starts_char = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
    cut = np.flatnonzero((gear_hash(data, off) & _CUT == 0) & starts_char) + 1
    doc = np.searchsorted(off, cut - 1, side="right") - 1
    far = np.append(True, (np.diff(cut) >= MIN_BYTES) | (doc[1:] != doc[:-1])) if len(cut) else np.zeros(0, bool)
    full = np.flatnonzero(np.diff(off) > 0)
    ends = np.unique(np.concatenate([cut[far], off[full + 1]]))
    begin = np.concatenate([[0], ends[:-1]])
    more = []
    for k in np.flatnonzero(ends - begin > MAX_BYTES):
        at = int(begin[k]) + MAX_BYTES
        while at < ends[k]:
            while not starts_char[at - 1]:
                at -= 1
            more.append(at)
            at += MAX_BYTES
    if more:
        ends = np.union1d(ends, more)
    return np.searchsorted(off, ends - 1, side="right") - 1, ends


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, start, length, d1, d2) per chunk; places in characters, ``t`` tells texts of one id apart."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.crc32(F.col(text_col).cast("binary")).alias("t"),
                      F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("t", T.LongType()),
                           T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
                           T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def run(batches):
        for whole in batches:
            for b in sub_batches(whole, "text"):
                data, off = byte_view(b.column(2))
                doc, ends = chunk_ends(data, off)
                if not len(ends):
                    continue
                begin = np.concatenate([[0], ends[:-1]])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                raw = memoryview(np.ascontiguousarray(data))
                digests = np.frombuffer(b"".join(
                    xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begin.tolist(), ends.tolist())), "<i8").reshape(-1, 2)
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row),
                     pa.array((chars[begin] - chars[off[doc]]).astype(np.int32)),
                     pa.array((chars[ends] - chars[begin]).astype(np.int32)),
                     pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], names=schema.names)

    return src.filter("text <> ''").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, t, start, length, first_doc_id, first_start): runs of chunks that stand earlier in the corpus."""
    rows = chunk_rows(docs, id_col, text_col)
    first = (rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    own = F.struct("id", "start")
    later = (rows.join(first, ["d1", "d2"]).filter(~own.eqNullSafe(F.col("first")))
             .select("id", "t", "start", "length", "first").distinct())
    w = Window.partitionBy("id", "t").orderBy("start")
    opens = F.coalesce((F.lag(F.col("start") + F.col("length")).over(w) != F.col("start")).cast("int"), F.lit(1))
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    spans = runs.groupBy("id", "t", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"),
                                               F.min(F.struct("start", "first")).alias("f"))
    return spans.filter(F.col("length") >= min_span).select(
        F.col("id").alias("doc_id"), "t", "start", F.col("length").cast("int").alias("length"),
        F.col("f.first.id").alias("first_doc_id"), F.col("f.first.start").alias("first_start"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_span: int = MIN_SPAN) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts; all else as it was."""
    ship_package(docs.sparkSession)
    name, rid, rt = (unused_name(docs, x) for x in ("_cd_spans", "_cd_id", "_cd_t"))
    per = (repeated_spans(docs, id_col, text_col, min_span)
           .groupBy(F.col("doc_id").alias(rid), F.col("t").alias(rt))
           .agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(name)))
    own = F.crc32(F.col(text_col).cast("binary"))
    joined = docs.join(per, F.col(id_col).eqNullSafe(F.col(rid)) & (own == F.col(rt)), "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if s is None or t is None:
                out.append(t)
                continue
            keep, at = [], 0
            for x in s:
                keep.append(t[at:x["start"]])
                at = x["start"] + x["length"]
            out.append("".join([*keep, t[at:]]))
        return pd.Series(out, dtype=object)

    new = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(name)))
    return joined.withColumn(text_col, new).select(*docs.columns)
