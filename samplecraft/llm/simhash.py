"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has bit j set if more than half of its word-shingle
hashes (XXH64 of the shingle's words joined by one space) have it.  Two
fingerprints link at ``radius`` or fewer differing bits.

Equal fingerprints are one row from here on.  The 64 bits are cut into 1, 2 or
4 blocks; fingerprints with equal population counts in all blocks make a tile
class, and a class with more than ``TILE`` members is cut by hash into several
tiles.  A block's population counts differ by no more than its bits do, so two
tiles whose counts differ by more than ``radius`` in sum hold no link and are
skipped; all other tile pairs are compared in full, with NumPy's exclusive-or
and bit counts.  There are at most 17**4 classes whatever the corpus is, so the
list of classes is a bounded table.  A task gives the links of a tile pair as a
tree over each connected part of it, at most one row per member, never all
pairs.  The number of blocks follows the counted fingerprints (more blocks skip
more, fewer give fuller tiles); the links are the same with each.

The work per core is an exact comparison of all that is not skipped: about
24 %, 4.4 % (2, 4 blocks) of the pairs of random fingerprints, so it grows with
their square.

Nulls: a null text has no words and the fingerprint zero, linked like any
other; a null id takes part in no link and has a null component.  Rows that
repeat an id are one node: it has the links of all its texts.  An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import components, forget, stored
from .joins import join_counted
from .text import LOWER, Words, find_words, sub_batches

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096
FANOUT = 16
_CHUNK = 1 << 18
_STRIP = 1 << 18
#: blocks, and about how many classes hold most of random fingerprints
_CLASSES = ((4, 4700), (2, 137))
_FULL = 500  # fingerprints of a class that are worth a tile


def _shingle_hashes(w: Words, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the shingles of words ``first`` to ``last``; their starts ascend."""
    lo, hi = int(first[0]), int(last.max()) + 1
    lens = w.ends[lo:hi] - w.starts[lo:hi]
    region = slice(int(w.starts[lo]), int(w.ends[hi - 1]))
    kept = w.data[region][w.in_word[region]]
    out = np.full(len(kept) + len(lens), 0x20, np.uint8)  # one space after each word
    out[np.arange(len(kept)) + np.repeat(np.arange(len(lens)), lens)] = kept
    begin = np.cumsum(lens + 1) - lens - 1
    raw, digest = out.tobytes(), xxhash.xxh64_intdigest
    spans = zip(begin[first - lo].tolist(), (begin + lens)[last - lo].tolist())
    return np.fromiter((digest(raw[a:b], seed) for a, b in spans), np.uint64, len(first))


def fingerprint_column(col: pa.Array, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of every row; a long text is hashed in parts."""
    w = find_words(col)
    w = w._replace(data=LOWER[w.data])
    n_docs = len(w.word_off) - 1
    ones, total = np.zeros((n_docs, 64), np.int64), np.zeros(n_docs, np.int64)
    end = w.word_off[w.doc + 1]
    at = np.arange(len(w.starts))
    short = end - w.word_off[w.doc] < width
    first = np.flatnonzero((at + width <= end) | (short & (at == w.word_off[w.doc])))
    for lo in range(0, len(first), _CHUNK):
        f = first[lo:lo + _CHUNK]
        h = _shingle_hashes(w, f, np.minimum(f + width, end[f]) - 1, seed)
        doc = w.doc[f]
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for j in range(64):
            ones[doc[head], j] += np.add.reduceat(((h >> np.uint64(j)) & np.uint64(1)).astype(np.int32), head)
        total[doc[head]] += np.diff(np.append(head, len(f)))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(id, fp) per row; ``fp`` is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in sub_batches(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(fingerprint_column(b.column(1), width, seed).view(np.int64))], names=["id", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "id long, fp long"))


def blocks_for(n: int) -> int:
    """In how many blocks to count bits, for tiles that are neither empty nor too many."""
    return next((b for b, classes in _CLASSES if n >= classes * _FULL), 1)


def tile_class(fp: Column, blocks: int, radius: int) -> Column:
    """The population counts of all blocks as digits of one number, with room for ``radius`` on either side."""
    width, code = 64 // blocks, F.lit(0).cast("long")
    for b in range(blocks):
        part = F.shiftrightunsigned(fp, b * width)
        if width < 64:
            part = part.bitwiseAND((1 << width) - 1)
        code = code * 256 + F.bit_count(part) + radius
    return code


def class_steps(blocks: int, radius: int) -> list[int]:
    """What to add to a class to get those within reach; of two opposite steps only one."""
    steps = []
    for d in itertools.product(range(-radius, radius + 1), repeat=blocks):
        if sum(map(abs, d)) <= radius:
            code = 0
            for x in d:
                code = code * 256 + x
            if code >= 0:
                steps.append(code)
    return sorted(steps)


def _join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Put the ends of all links into one part each; ``parent`` stays flat, roots are smallest members."""
    while True:
        ru, rv = parent[u], parent[v]
        differ = ru != rv
        if not differ.any():
            return
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of ``a`` and ``b`` (None: ``a`` with itself) that are within ``radius``.

    Each connected part gives a tree in which a member has ``FANOUT`` children at most.
    """
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    parent = np.arange(len(nodes))
    step = max(1, _STRIP // max(1, len(other)))
    for lo in range(0, len(a), step):
        x = a[lo:lo + step]
        close = np.bitwise_count(x[:, None] ^ other[None, :]) <= radius
        if not close.any():
            continue
        i, j = np.nonzero(close)
        if b is None:
            i, j = i[i + lo < j], j[i + lo < j]
        if len(i):
            _join(parent, i + lo, j + shift)
    order = np.argsort(parent, kind="stable")
    root = parent[order]
    head = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
    start = np.repeat(head, np.diff(np.append(head, len(root))))
    rank = np.arange(len(root)) - start
    child = np.flatnonzero(rank)
    up = start[child] + (rank[child] - 1) // FANOUT
    return nodes[order[up]], nodes[order[child]]


def similar_links(fps: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` (a stored table of ``n`` different ``fp``) within ``radius``."""
    spark = fps.sparkSession
    ship_package(spark)
    blocks = blocks or blocks_for(n)
    assert blocks <= 4  # at most 17**4 classes: the table of classes stays small
    classed = fps.select("fp", tile_class(F.col("fp"), blocks, radius).alias("c"))
    classes = stored(classed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(
        "c", F.ceil(F.col("n") / tile).cast("long").alias("parts")), "tile-classes")
    tiles = stored(classed.join(F.broadcast(classes), "c")
                   .groupBy("c", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
                   .agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")  # about ``tile`` in each
    steps = F.array(*[F.lit(s).cast("long") for s in class_steps(blocks, radius)])
    near = (classes.select("c", "parts", F.explode(F.transform(steps, lambda s: F.col("c") + s)).alias("c2"))
            .join(classes.select(F.col("c").alias("c2"), F.col("parts").alias("parts2")), "c2"))
    pairs = (near.select("c", "c2", "parts2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
             .select("c", "c2", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts2") - 1)).alias("part2"))
             .filter("c < c2 OR part <= part2"))
    pairs = stored(pairs, "tile-pairs")
    tasks = min(100_000, pairs.count() // 32 + 1)
    left = tiles.withColumnRenamed("fps", "left_fps")
    right = tiles.select(F.col("c").alias("c2"), F.col("part").alias("part2"), F.col("fps").alias("right_fps"))

    def run(batches: Iterator[pa.RecordBatch]):
        for rb in batches:
            c, part, c2, part2, x, y = rb.columns
            same = [p == q for p, q in zip(zip(c.to_pylist(), part.to_pylist()), zip(c2.to_pylist(), part2.to_pylist()))]
            for k, one in enumerate(same):
                a = x[k].values.to_numpy().view(np.uint64)
                u, v = compare_tiles(a, None if one else y[k].values.to_numpy().view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

    rows = (pairs.join(left, ["c", "part"]).join(right, ["c2", "part2"])
            .select("c", "part", "c2", "part2", "left_fps", "right_fps").repartition(tasks, "c", "part", "c2", "part2"))
    links = stored(rows.mapInArrow(run, "a long, b long"), "tile-links")
    forget(classes, tiles, pairs)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row; a component has the smallest id of those that links reach."""
    seen = stored(fingerprints(docs, id_col, text_col), "simhash")
    named = seen.filter("id is not null")
    groups = stored(named.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprints")
    n_fps, n_rows = groups.count(), seen.count()
    links = similar_links(groups, n_fps, radius)
    # texts of one id are one node
    several = named.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count(F.lit(1)).alias("m")).filter("a <> z")
    several = stored(several, "several")
    own = join_counted(named, several, "id", "m", n_rows, "inner").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    comp = components(links.unionByName(own)).withColumnRenamed("node", "fp")
    part = stored(groups.join(comp, "fp", "left").select("fp", "rep", "n", F.coalesce("comp", "fp").alias("comp")), "parts")
    least = stored(part.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("k")), "least")
    named_fps = join_counted(part, least, "comp", "k", n_fps).select("fp", "n", "component_id")
    out = join_counted(seen, stored(named_fps, "component-names"), "fp", "n", n_rows)
    forget(links, part)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
