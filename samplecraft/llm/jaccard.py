"""N-gram Jaccard join by parity sketches.

A document is its set of distinct 5-word shingle hashes.  Its sketch XORs each
shingle into one of ``p`` parts: a part is a (virtual 2**64-bit wide) parity
vector, held as the XOR of the mixed hashes in it.  An element that only one of
two sets has changes one part at most, so the number of differing parts is a
lower bound of the symmetric difference.  Two sets of Jaccard similarity >= t,
the smaller of ``a`` elements, differ in at most d = a(1-t)/t elements, so at
most d parts differ.  ``p`` and ``d`` depend on the size band of the smaller
set; a document gives parts for its own band and, where it can be the larger
set, for the band below.

Which parts are given: the d + 1 rarest of those that are not empty (with the d
of the set's own size, which is no more than the band's), rarest first by the corpus's count (a table of fixed size over all documents) of the
rarest shingle inside, then by the part's value.  That order is the same for
all documents.  Of a similar pair no more parts of either set are not shared than either's d,
so the rarest shared part is among the first d + 1 of both: they meet, and
shared lines and passages bring almost nobody else together.  A set with fewer
than d + 1 parts that are not empty gives all of them and goes on with another
seed; after ``SEEDS`` of them it also gives its empty parts.  Of a pair, the set
that stops first meets the other there.

A key says how many one-element parts come before it; of a similar pair those
before the first shared key differ, so their numbers add up to the symmetric
difference at most.
Members of a copied family with many changes of their own are told apart by
this without looking at them.

Exact copies are one node; a task gives keys for the first of those it reads.
A similar pair shares most of its parts, so most groups have the same members
as many others: they are one group from here on, each member with its smallest number of
parts before, which tests no pair less and repeats few.  A group is linked to
one member first, the one with the fewest parts before; when the links found make it one
component it is done.  Only groups that still hold several components go on,
with 15, 240, ... more centres, until every pair in them is tested or
connected.  Two members meet in many groups, but are a candidate in the first
only: each has a list of other groups it is in with fewer parts before, and of
two that have one in common in their lists it was the place to meet.  A
candidate must pass its sizes and the Hamming distance of two
short parity bit sketches, also a lower bound of the symmetric difference, and
is then verified on the whole sets.  Groups of more than ``PART_ROWS`` rows are
ranked in parts, and no key's rows have to meet in one task after the first
shuffle, where they stream.

Nulls: a null text has an empty set and no links; a null id takes part in no
link and has a null component.  Rows that repeat an id are one node: it has
the links of all its texts.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..util import unused_name
from .components import components, forget, stored
from .joins import join_counted
from .text import LOWER, Words, find_words, mix64, sub_batches

SHINGLE = 5
SIMILARITY = (80, 100)
BAND = 1.5
SEEDS = 4
COUNTERS = 1 << 20
_BLOCKS = 64
MORE_CENTRES = 16
LONG_GROUP = 4096
SEEN_GROUPS = 16
PART_ROWS = 256
_PARTS = 64
_BEFORE = 0xFFFF
BROADCAST_IDS = 1_000_000
SHORT_WORDS = 4
LONG_WORD = 64
SKETCHED = 1 << 16
_B = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word's bytes: eight bytes a step for all words, xxHash for the long ones."""
    size = w.ends - w.starts
    if not len(size):
        return np.zeros(0, np.uint64)
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each byte on
    out = mix64(size)
    at = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        left = size[at] - step
        at, left = at[left > 0], left[left > 0]
        if not len(at):
            break
        unused = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        out[at] = mix64(out[at] ^ (eight[w.starts[at] + step] << unused))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[w.starts[i]:w.ends[i]].data)
    return out


def shingle_sets(col: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    w = find_words(col)
    code = word_hashes(w._replace(data=LOWER[w.data]))
    n = len(code)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[:max(0, n - k)] = rolled[:max(0, n - k)] * _B + code[k:]
    rolled = mix64(rolled)
    spans = list(zip(w.word_off[:-1].tolist(), w.word_off[1:].tolist()))
    for lo, hi in spans:
        rolled[lo:max(lo, hi - width + 1)].sort()
    fresh = np.append(True, rolled[1:] != rolled[:-1])
    for lo, hi in spans:
        if hi - lo >= width:
            fresh[lo] = True
            yield rolled[lo:hi - width + 1][fresh[lo:hi - width + 1]]
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for c in code[lo:hi]:
                whole = mix64(whole ^ c) * _B
            yield whole
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands and the sketch's shape in each."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY):
        self.num, self.den = similarity
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))

    def shape(self, j: int) -> tuple[int, int]:
        """(parts, the most that can differ) for pairs whose smaller set is in band ``j``."""
        most = (self.lows[j + 1] - 1) * (self.den - self.num) // self.num
        return 12 * most + 4, most

    def most(self, size: int, j: int) -> int:
        """The most parts of band ``j`` that can differ for pairs that a set of this size is in: ``shape``'s or fewer."""
        top = self.lows[j + 1] - 1
        if size <= top:  # whatever the other's size is
            return size * (self.den - self.num) // self.num
        return (size + top) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size can be one of a pair, but for equal sets."""
        j = bisect_right(self.lows, size) - 1
        out = []
        # the smallest partner has size * t elements
        while j >= 0 and (self.lows[j + 1] - 1) * self.den >= size * self.num:
            if (self.lows[j + 1] - 1) * (self.den - self.num) >= self.num:  # else only equal sets are similar
                out.append(j)
            j -= 1
        return out


def sketch_keys(s: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of one set, as ``sketches`` gives them."""
    _, keys, places = sketches([s], counts, bands)
    return keys, places


def sketches(sets: list[np.ndarray], counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the set, key, place) of many sets.

    A key mixes (band, seed, part, parity).  A place is ``n << 32 | before``:
    the size of the set, and how many parts of exactly one element come before
    this one in the rarest-first order.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.cumsum(sizes) - sizes
    of = {n: bands.of(n) for n in set(sizes.tolist())}
    # an entry is one band of one set
    doc = np.repeat(np.arange(len(sets)), [len(of[n]) for n in sizes.tolist()])
    band = np.array([j for n in sizes.tolist() for j in of[n]], np.int64)
    width = {j: bands.shape(j)[0] for j in set(band.tolist())}
    limit = {(n, j): bands.most(n, j) for n in of for j in of[n]}
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    every = np.concatenate(sets) if len(doc) else None
    for seed in range(SEEDS):
        if not len(doc):
            break
        parts = np.array([width[j] for j in band.tolist()], np.int64)
        size, base = sizes[doc], np.cumsum(parts) - parts
        most = np.array([limit[e] for e in zip(size.tolist(), band.tolist())], np.int64)
        entry = np.repeat(np.arange(len(doc)), size)
        s = every[np.arange(len(entry)) + (at[doc] - (np.cumsum(size) - size))[entry]]
        h = mix64(s ^ np.uint64(seed))
        part = base[entry] + (((h >> np.uint64(32)) * parts.astype(np.uint64)[entry]) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part)
        part, h = part[order], mix64(h[order])
        freq = counts[s[order] >> np.uint64(64 - (len(counts).bit_length() - 1))]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        value, rarest = np.bitwise_xor.reduceat(h, first), np.minimum.reduceat(freq, first)
        entry, part = entry[order[first]], part[first]
        single = np.diff(np.append(first, len(h))) == 1
        salt = mix64((band << 8) | seed)
        keys = mix64(value ^ mix64((part - base[entry]).astype(np.uint64) ^ salt[entry]))
        found = np.bincount(entry, minlength=len(doc))
        enough = found > most
        given = np.lexsort((keys, (entry << 16) | rarest))  # entries stay in their order
        start = np.cumsum(found) - found
        single = single[given]
        before = np.cumsum(single) - single
        before -= before[start][entry]
        few = (np.arange(len(entry)) - start[entry] <= most[entry]) | ~enough[entry]
        out.append((doc[entry[few]], keys[given[few]], (size[entry[few]] << 32) + before[few]))
        if seed == SEEDS - 1:  # an empty part says nothing of what comes before
            for e in np.flatnonzero(~enough).tolist():
                full = (part - base[e])[entry == e].astype(np.uint64)
                empty = mix64(mix64(np.setdiff1d(np.arange(parts[e], dtype=np.uint64), full) ^ salt[e]))
                out.append((np.full(len(empty), doc[e]), empty, np.full(len(empty), size[e] << 32)))
        doc, band = doc[~enough], band[~enough]
    number, keys, places = (np.concatenate(x) for x in zip(*out))
    return number, keys, places.astype(np.int64)


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the hashes per bit, as 64-bit words; a power of two of at least as many bits as elements."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = mix64(s ^ np.uint64(0x5EED)) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def short_sketch(bits: np.ndarray) -> np.ndarray:
    """A bit sketch folded to at most ``SHORT_WORDS`` words: its distances are lower bounds as well."""
    while len(bits) > SHORT_WORDS:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _sets(batches) -> Iterator[tuple[list, list[np.ndarray]]]:
    for whole in batches:
        for b in sub_batches(whole, "text"):
            yield b.column(0).to_pylist(), list(shingle_sets(b.column(1)))


def _narrow(block: np.ndarray) -> bytes:
    """The numbers in the fewest bytes each that hold the largest."""
    return block.astype(np.min_scalar_type(int(block.max()))).tobytes()


def describe(texts: DataFrame) -> DataFrame:
    """One pass: (id, n, digest) per row, and per task the blocks of its shingle count table."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        shift = np.uint64(64 - (COUNTERS.bit_length() - 1))
        for ids, sets in _sets(batches):
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            if sets:
                every = (np.concatenate(sets) >> shift).astype(np.int64)
                counts += np.bincount(every, minlength=COUNTERS).astype(np.uint32)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["id", "n", "digest", "block", "counts"])
        for k, block in enumerate(np.split(counts, _BLOCKS)):
            if block.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
                     pa.array([k], pa.int32()), pa.array([_narrow(block)], pa.binary())],
                    names=["id", "n", "digest", "block", "counts"])

    return texts.mapInArrow(run, "id long, n long, digest binary, block int, counts binary")


def shingle_counts(blocks: DataFrame) -> np.ndarray:
    """The corpus's count table: ``COUNTERS`` numbers, however large the corpus is (cut off at 65,535
    above the mean, beyond which all shingles count as equally common)."""

    def add(batches):
        now, total = None, None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "counts": [total.tobytes()]})
                    now, total = k, np.zeros(COUNTERS // _BLOCKS, np.uint64)
                total += np.frombuffer(raw, f"u{len(raw) // len(total)}")
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "counts": [total.tobytes()]})

    table = np.zeros(COUNTERS, np.float64)
    size = COUNTERS // _BLOCKS
    rows = (blocks.repartition(_BLOCKS, "block").sortWithinPartitions("block").select("block", "counts")
            .mapInArrow(add, "block int, counts binary").collect())
    for r in rows:
        table[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint64)
    return np.clip(table - table.min(), 0, 65_535).astype(np.uint16)


def key_rows(texts: DataFrame, counts: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, id): the given sketch parts of every set, of equal sets in a task those of the first.

    Nearly all of them are in one set only, so the rows are kept short: ``key``
    is 48 bits of the part's key, then 16 of how many parts come ``before`` (a
    lower bound of them, as every use needs).
    """

    def run(batches):
        bands, known = Bands(similarity), set()
        for ids, sets in _sets(batches):
            fresh = []
            for i, s in zip(ids, sets):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in known:
                    known.add(digest)
                    fresh.append((i, s))
            # a few sets at a time, so that the arrays stay small
            run_of = np.cumsum([len(s) for _, s in fresh]) // SKETCHED
            for some in np.split(np.arange(len(fresh)), np.flatnonzero(np.diff(run_of)) + 1):
                if len(some):
                    number, keys, places = sketches([fresh[k][1] for k in some], counts, bands)
                    ids_here = np.array([fresh[k][0] for k in some], np.int64)
                    before = np.minimum(places & 0xFFFFFFFF, _BEFORE).astype(np.uint64)
                    keys = (keys & ~np.uint64(_BEFORE)) | before
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids_here[number])],
                                                     names=["key", "id"])

    return texts.filter("id is not null").mapInArrow(run, "key long, id long")


def shared_groups(rows: DataFrame) -> DataFrame:
    """(key, id, before, parts) of the keys that two or more rows have; keys with the same members are one.

    ``key`` then is a hash of the members (two groups that collide are only
    tested together).  The rows of a key with more than ``LONG_GROUP`` stream
    on under the key itself, to be ranked in ``parts``.
    """

    def out(key, ids, before, parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ids), pa.array(before),
             pa.array(np.broadcast_to(parts, len(ids)).astype(np.int64))], names=["key", "id", "before", "parts"])

    def whole(k, d, p):
        """Complete short groups."""
        fresh = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
        k, d, p = k[fresh], d[fresh], p[fresh]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(head, len(k)))
        name = mix64(np.bitwise_xor.reduceat(mix64(d), head) + size.astype(np.uint64))
        many = np.repeat(size > 1, size)
        return out(np.repeat(name, size)[many], d[many], p[many], np.repeat(-(-size // PART_ROWS), size)[many])

    def run(batches):
        rest, long_key = [np.zeros(0, np.int64)] * 3, None
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            new = (key >> np.uint64(16)).astype(np.int64), b.column(1).to_numpy(), (key & np.uint64(_BEFORE)).astype(np.int64)
            k, d, p = (np.concatenate(x) for x in zip(rest, new))
            if not len(k):
                continue
            if long_key is not None:
                stop = int(np.searchsorted(k != long_key, True)) if (k != long_key).any() else len(k)
                if stop:
                    yield out(mix64(k[:stop]), d[:stop], p[:stop], _PARTS)
                k, d, p = k[stop:], d[stop:], p[stop:]
                if not len(k):
                    rest = [k, d, p]
                    continue
                long_key = None
            last = int(np.flatnonzero(np.append(True, k[1:] != k[:-1]))[-1])
            if last:
                got = whole(k[:last], d[:last], p[:last])
                if got.num_rows:
                    yield got
            rest = [k[last:], d[last:], p[last:]]
            if len(rest[0]) > LONG_GROUP:
                long_key = rest[0][0]
                yield out(mix64(rest[0]), *rest[1:], _PARTS)
                rest = [x[:0] for x in rest]
        if len(rest[0]):
            got = whole(*rest)
            if got.num_rows:
                yield got

    part = F.shiftrightunsigned("key", 16)
    groups = (rows.repartition(part).sortWithinPartitions(part, "id", "key")
              .mapInArrow(run, "key long, id long, before long, parts long"))
    return groups.groupBy("key", "id").agg(F.min("before").alias("before"), F.max("parts").alias("parts"))


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n, short, bits, set) of the given ids."""

    def lists(arrays):
        off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))

    def run(batches):
        for ids, sets in _sets(batches):
            bits = [bit_sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 lists([short_sketch(b) for b in bits]), lists(bits), lists(sets)], names=["id", "n", "short", "bits", "set"])

    return _only(texts, nodes.select("id")).mapInArrow(
        run, "id long, n int, short array<long>, bits array<long>, set array<long>")


def _hamming(x: Column, y: Column) -> Column:
    """Hamming distance of two bit sketches, the longer one folded to the other's length."""
    size = F.least(F.size(x), F.size(y))

    def folded(a: Column) -> Column:  # sizes of candidates differ by one doubling at most
        return F.when(F.size(a) == 2 * size, F.zip_with(
            F.slice(a, 1, size), F.slice(a, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(a)
    differ = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
    return F.when((size > 0) & (F.greatest(F.size(x), F.size(y)) <= 2 * size), differ).otherwise(0)


def _few_sent(ids: DataFrame) -> DataFrame:
    """The distinct rows, of a few numbers each; few are broadcast, so what they are joined with is not shuffled."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids  # 8 MB a column


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` with one of ``ids``."""
    return sets.join(_few_sent(ids), "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, as a stored table."""
    num, den = similarity
    pairs = stored(pairs, "pairs")

    def side(c: str, of: DataFrame, *more: str) -> DataFrame:
        few = _only(sets.select("id", *more), of.select(F.col(c).alias("id")))
        return few.select(F.col("id").alias(c), *[F.col(m).alias(f"{m}_{c}") for m in more])

    near = pairs.join(side("a", pairs, "n", "bits"), "a").join(side("b", pairs, "n", "bits"), "b")
    # |x - y| <= (den - num) / (den + num) (|x| + |y|) for similar sets
    near = near.filter((den + num) * _hamming(F.col("bits_a"), F.col("bits_b")) <= (den - num) * (F.col("n_a") + F.col("n_b")))
    near = stored(near.select("a", "b").distinct(), "near")
    both = near.join(side("a", near, "set"), "a").join(side("b", near, "set"), "b")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    found = stored(both.select("a", "b", inter.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
                   .filter(den * F.col("i") >= num * (F.col("s") - F.col("i"))).select("a", "b").distinct(), "verified")
    forget(pairs, near)
    return found


def _open(rows: DataFrame) -> DataFrame:
    """The rows, stored, of groups with several components, with the ``size`` of their group."""
    rows = rows.drop("size")
    several = (rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
               .filter("lo <> hi").select("key", "c", F.col("c").alias("size")))
    several = stored(several, "several")
    if several.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        out = stored(rows.join(F.broadcast(several.drop("c")), "key"), "groups")
    else:
        out = stored(join_counted(rows, several, "key", "c", rows.count(), "inner"), "groups")
    forget(several)
    return out


def _seen(groups: DataFrame) -> DataFrame:
    """(id, n, top): the ``SEEN_GROUPS`` largest groups of every member."""
    largest = Window.partitionBy("id", "n").orderBy(F.desc("size"), "before", "key")
    few = groups.select("id", "n", "key", "before", "size", F.row_number().over(largest).alias("r")).filter(F.col("r") <= SEEN_GROUPS)
    return few.groupBy("id", "n").agg(F.collect_list(F.struct("before", "key")).alias("top"))


def with_sketches(groups: DataFrame, short: DataFrame) -> DataFrame:
    """The rows with the ``short`` sketches of their ids and ``seen``: groups in which the member comes before this one.

    The order of a member's groups is (before, key).  Two members that have a group in
    both of their lists have no more parts before there, each, than here, so
    they were a candidate there if they are one here.  Of the groups in which they are,
    the one with the smallest (sum of the two ``before``, key) has no such group before
    it: they are a candidate there at least, whichever groups the lists hold.
    """
    of_member = _seen(groups).join(short, "id")
    earlier = F.filter("top", lambda g: (g["before"] < F.col("before")) | ((g["before"] == F.col("before")) & (g["key"] < F.col("key"))))
    return (groups.join(of_member, ["id", "n"])
            .withColumn("seen", F.transform(earlier, lambda g: g["key"])).drop("top"))


def candidates(groups: DataFrame, similarity: tuple[int, int], ranks: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, before_a): centres and the members of their groups, of other components, that may be similar to them.

    ``ranks``: of the centres, from one to below the other.  Without, a group
    has one centre, in however many parts it is ranked: its member with the
    fewest parts before.  So there are no more rows than members.
    """
    num, den = similarity
    if ranks is None:
        centres = groups.groupBy("key").agg(F.min(F.struct("before", "id", "n", "comp")).alias("c")).select("key", "c.*")
    else:
        centres = groups.filter((F.col("rank") >= ranks[0]) & (F.col("rank") < ranks[1]))
    centres = centres.select("key", *[F.col(c).alias(f"{c}_a") for c in centres.columns if c != "key"])
    most = (den - num) * (F.col("n") + F.col("n_a"))  # (den + num) times the largest symmetric difference
    near = [F.col("comp") != F.col("comp_a"),
            F.col("n") * den >= F.col("n_a") * num, F.col("n_a") * den >= F.col("n") * num,
            # the parts before the first shared one differ, so their numbers add up to it at most
            (den + num) * (F.col("before") + F.col("before_a")) <= most]
    if ranks is not None:
        near.append(F.col("rank") > F.col("rank_a"))
        near.append(~F.arrays_overlap("seen", "seen_a"))  # else they met in another group
        near.append((den + num) * _hamming(F.col("short"), F.col("short_a")) <= most)
    return groups.join(centres, "key").filter(functools.reduce(lambda x, y: x & y, near)).select(
        F.col("id_a").alias("a"), F.col("id").alias("b"), "before_a")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((id, n) per row, links (a, b), the stored tables the links are in): enough verified links to connect all
    that are similar."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    seen = stored(describe(texts), "shingle-sets")
    rows = seen.filter("block is null").select("id", "n", "digest")
    counts = shingle_counts(seen.filter("block is not null"))
    named = rows.filter("digest is not null and id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.count(F.lit(1)).alias("c"))
    first = stored(first.filter("rep < most").select("digest", "rep", "c"), "first-copies")
    copies = join_counted(named.select("digest", "id"), first, "digest", "c", seen.count(), "inner")
    copies = stored(copies.filter("id <> rep").select("id", "rep").distinct(), "copies")
    forget(first)
    links, tables = copies.select(F.col("rep").alias("a"), F.col("id").alias("b")), [copies]

    # an id with several texts keeps its own name: its other texts are not the representative's
    several = named.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y")
    one = copies.join(several, "id", "left_anti").groupBy("id").agg(F.min("rep").alias("rep"))
    shared = stored(shared_groups(key_rows(texts, counts, similarity)), "shared-keys")
    groups = (shared.join(_few_sent(one), "id", "left").withColumn("id", F.coalesce("rep", "id"))
              .groupBy("key", "id").agg(F.min("before").alias("before"), F.max("parts").alias("parts")))
    # an id with several texts is in each of its groups with the size of each text
    groups = groups.join(named.select("id", "n").distinct(), "id")
    # a rank of its own for each row of a group, the fewest parts before first
    part = F.pmod(F.xxhash64("id", "n"), "parts")
    in_part = F.row_number().over(Window.partitionBy("key", "part").orderBy("before", "id", "n")) - 1
    groups = groups.withColumn("part", part).withColumn("rank", in_part * F.col("parts") + F.col("part"))
    ranked = stored(groups.drop("part").withColumn("comp", F.col("id")), "ranked")
    groups = _open(ranked)
    forget(shared, ranked)
    sets = stored(_sets_of(texts, groups.select("id").distinct()), "sets")
    low, high, alone = 0, 1, True
    while True:
        largest = groups.agg(F.max("rank").alias("m")).first()["m"]
        if largest is None or low > largest:
            forget(sets, groups)
            return rows.select("id", "n"), links, tables
        pairs = candidates(groups, similarity, None if alone else (low, high))
        if alone:  # first only one centre of each member, the one with the fewest parts of its own: its family's
            pairs = pairs.groupBy("b").agg(F.min(F.struct("before_a", "a")).alias("c")).select("c.a", "b")
        found = verified(pairs.select("a", "b").distinct(), sets, similarity)
        if found.limit(1).count():
            links = links.unionByName(found.select("a", "b"))
            tables.append(found)
            names = groups.select("id", "comp").distinct()
            met = (found.join(names.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
                   .join(names.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
                   .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
            comp = components(met)
            new = comp.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            merged = stored(groups.join(_few_sent(new), "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new"), "groups")
            forget(groups, comp)
            groups = _open(merged)
            forget(merged)
        else:
            forget(found)
        if alone:
            alone = False
            short = sets.groupBy("id").agg(F.first("short").alias("short"), F.count(F.lit(1)).alias("texts"))
            # an id with several texts has no one sketch: its distance is taken as nothing
            one_text = F.when(F.col("texts") == 1, F.col("short")).otherwise(F.array().cast("array<long>"))
            sketched = stored(with_sketches(groups, short.select("id", one_text.alias("short"))), "groups")
            forget(groups)
            groups = sketched
        else:
            low, high = high, MORE_CENTRES * high


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    rows, links, tables = similar_links(docs, id_col, text_col, similarity)
    comp = components(links)
    forget(*tables)
    return rows.join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those that are similar to a kept one: the smallest id of a component stays.

    Texts without words stay.  Of rows that repeat a kept id one stays.
    """
    mark = unused_name(docs, "_jc_id")
    found = stored(join_components(docs, id_col, text_col, similarity), "components")
    drop = _few_sent(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(mark)))
    here = F.col(id_col).cast("long") == F.col(mark)
    left = docs.join(drop, here, "left_anti")
    again = (found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(mark)).agg(F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(mark))
    if not again.limit(1).count():
        return left
    once = left.join(again, here, "left_semi").dropDuplicates([id_col])
    return left.join(again, here, "left_anti").unionByName(once)
