"""Prefix trie of conversations that share a base conversation's head.

Conversation c is rebuilt from the first h turns of its base (c - c % 100;
h = crc32 of the decimal id, modulo 6) and its own turns after the first h.  Every
distinct sequence of first d rebuilt turns is a node.  Rebuilt texts are never
made: a turn is a reference into the stored turns with a fingerprint, an
element of a group (the maps x -> a x + b over a prime field, in two lanes of
62 bits), and a prefix's fingerprint is the product of its turns'.

1. Own prefixes: turns are range-partitioned by (conversation, turn, role,
   fingerprint, place), so a giant conversation spreads over many tasks; each
   task multiplies along its rows, and the products of the at most two
   conversations that it shares with its neighbours are carried over (a table of two
   rows a task).
2. Rebuilt prefixes: after the head's k turns the suffix's product is
   head(k) * own(h)^-1 * own(j), one factor per conversation.
3. Equality: all members of a node must name the same last turn fingerprint.  In
   a group equal products with equal last factors leave equal products before
   them, so by induction all turns named are equal; and all stored turns of
   one fingerprint must have one role and one text.  If either fails (a
   collision), everything starts again with another seed.
4. Sums over subtrees need no walk: a node's owner is its smallest member, and
   the nodes that a conversation owns are the end of its path.  So leaves, children
   and saved lengths are sums over a node's members of numbers that each of
   them knows of itself; the owner's own part drops out.

Groups that hold most rows (root, a common opening, a giant conversation) are
pre-aggregated or joined by ``join_counted``.  The hash of the ids that end at
a node is one SHA-256, so one task reads them, as blocks of joined ids and in order.

Nulls: a null conversation id takes no part; a null turn comes first; null roles
and texts are empty.  Turns of one number are ordered by role, then
fingerprint; equal rows are turns of their own.  A negative id's remainder is
negative, as in SQL.  An empty table gives no rows.  Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import forget, stored
from .joins import join_counted

HEADS = 6
GROUP = 100
_P = (1 << 31) - 1  # a prime, and the mask of 31 bits
_ONE = 1 << 31      # the map x -> x
_NODE = ["depth", "f1", "f2"]


def _compose(x: Column, y: Column) -> Column:
    """The product of two packed maps (a << 31 | b)."""
    a, b = F.shiftright(x, 31), x.bitwiseAND(_P)
    return a * F.shiftright(y, 31) % _P * _ONE + (a * y.bitwiseAND(_P) + b) % _P


def _inverse(x: Column) -> Column:
    a, b = F.shiftright(x, 31), x.bitwiseAND(_P)
    power = F.array(*[F.lit(int(c)) for c in bin(_P - 2)[3:]])  # a ** (p - 2) is 1 / a
    inv = F.aggregate(power, a, lambda acc, bit: acc * acc % _P * F.when(bit == 1, a).otherwise(1) % _P)
    return inv * _ONE + (_P - inv * b % _P) % _P


def _element(h: Column) -> Column:
    """A packed map, with a <> 0, from a 64-bit hash."""
    return ((F.pmod(F.shiftrightunsigned(h, 32), F.lit(_P - 1)) + 1) * _ONE + F.pmod(h.bitwiseAND(0xFFFFFFFF), F.lit(_P)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as they count here."""
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def with_fingerprints(turns: DataFrame, seed: int) -> DataFrame:
    return turns.select("*", *[_element(F.xxhash64(F.lit(2 * seed + i), "role", "text")).alias(f"t{i + 1}") for i in (0, 1)])


def _multiply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_compose`` of arrays."""
    a, b = x >> 31, x & _P
    return ((a * (y >> 31) % _P) << 31) + (a * (y & _P) + b) % _P


def _scan(batches):
    """Products, places and lengths along each conversation of this task's sorted rows."""
    pid = TaskContext.get().partitionId()
    names = ["conv_id", "pid", "pos", "t1", "t2", "p1", "p2", "chars", "cum", "edge"]

    def table(conv, pos, t1, t2, p1, p2, chars, cum, edge):
        n = len(conv)
        cols = [conv, np.full(n, pid), pos, t1, t2, p1, p2, chars, cum]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols] + [pa.array([edge] * n, pa.bool_())], names)

    def one(state):
        conv, pos, p1, p2, cum = state
        return table([conv], [pos], [0], [0], [p1], [p2], [0], [cum], True)
    state, first = None, None
    for rb in batches:
        conv, t1, t2, chars = (rb.column(i).to_numpy() for i in range(4))
        if not len(conv):
            continue
        goes_on = state is not None and conv[0] == state[0]
        if state is not None and not goes_on and first is None:
            first = state
        head = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        rank = np.arange(len(conv)) - np.repeat(head, np.diff(np.append(head, len(conv))))
        p = [t1.copy(), t2.copy()]
        if goes_on:
            for q, before in zip(p, state[2:4]):
                q[:1] = _multiply(np.array([before]), q[:1])
        step = 1
        while step <= rank.max():
            at = np.flatnonzero(rank >= step)
            for q in p:
                q[at] = _multiply(q[at - step], q[at])
            step *= 2
        pos, cum = rank + 1, np.cumsum(chars)
        cum = cum - np.repeat(cum[head] - chars[head], np.diff(np.append(head, len(conv))))
        if goes_on:
            stop = head[1] if len(head) > 1 else len(conv)
            pos[:stop] += state[1]
            cum[:stop] += state[4]
        yield table(conv, pos, t1, t2, *p, chars, cum, False)
        if first is None and len(head) > 1:
            first = tuple(int(x[head[1] - 1]) for x in (conv, pos, *p, cum))
        state = tuple(int(x[-1]) for x in (conv, pos, *p, cum))
    if first is not None:
        yield one(first)
    if state is not None:
        yield one(state)


def own_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, p1, p2, chars, cum): each turn with the product and length of its conversation up to it.

    ``turns``: with fingerprints; the table is stored.
    """
    spark = turns.sparkSession
    ship_package(spark)
    order = ["conv_id", "turn", "role", "t1", "t2", "place"]
    rows = turns.select("conv_id", "turn", "role", "t1", "t2", F.monotonically_increasing_id().alias("place"),
                        F.char_length("text").cast("long").alias("chars"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "chars")
    scanned = stored(sorted_rows.mapInArrow(
        _scan, "conv_id long, pid long, pos long, t1 long, t2 long, p1 long, p2 long, chars long, cum long, edge boolean"), "turn-scan")
    # two rows a task at most; a conversation that several tasks hold is the first or last of each
    edges = sorted((r.conv_id, r.pid, r.pos, r.p1, r.p2, r.cum) for r in scanned.filter("edge").collect())
    carry = []
    for prev, now in zip(edges, edges[1:]):
        if prev[0] == now[0]:
            before = carry[-1][2:] if carry and carry[-1][:2] == prev[:2] else (0, _ONE, _ONE, 0)
            p = [int(_multiply(np.array([x]), np.array([y]))[0]) for x, y in zip(before[1:3], prev[3:5])]
            carry.append((*now[:2], before[0] + prev[2], *p, before[3] + prev[5]))
    own = scanned.filter("NOT edge").drop("edge")
    if not carry:
        return own.drop("pid")
    kept = spark.createDataFrame(carry, "conv_id long, pid long, c_pos long, c1 long, c2 long, c_cum long")
    own = own.join(F.broadcast(kept), ["conv_id", "pid"], "left")
    one = F.lit(_ONE)
    return stored(own.select(
        "conv_id", (F.col("pos") + F.coalesce("c_pos", F.lit(0))).alias("pos"), "t1", "t2",
        *[_compose(F.coalesce(F.col(f"c{i}"), one), F.col(f"p{i}")).alias(f"p{i}") for i in (1, 2)],
        "chars", (F.col("cum") + F.coalesce("c_cum", F.lit(0))).alias("cum")), "turn-prefixes")


def members(own: DataFrame) -> DataFrame:
    """(conv_id, depth, f1, f2, t1, t2, chars, rem, ends) for every rebuilt conversation and each of its prefixes.

    ``rem``: code points from the prefix's last turn to the conversation's end; ``ends``: it is the whole.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    here = F.col("pos") == h
    convs = own.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("cum").alias("total"),
        *[F.max(F.when(here, F.col(c))).alias(f"h_{c}") for c in ("p1", "p2", "cum")])
    heads = own.filter(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(  # at most five turns of each
        F.sort_array(F.collect_list(F.struct("pos", "p1", "p2", "t1", "t2", "chars", "cum"))).alias("head"))
    convs = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(heads, "base", "left").withColumn(
        "head", F.filter(F.coalesce("head", F.array()), lambda x: x["pos"] <= F.col("h")))
    k = F.size("head").cast("long")
    last = F.get("head", F.size("head") - 1)
    one, none = F.lit(_ONE), F.lit(0).cast("long")
    off = F.coalesce(last["cum"], none) - F.coalesce("h_cum", none)
    convs = stored(convs.select(
        "conv_id", "n", "h", "head", (k - F.col("h")).alias("shift"), off.alias("off"),
        *[_compose(F.coalesce(last[f"p{i}"], one), _inverse(F.coalesce(F.col(f"h_p{i}"), one))).alias(f"c{i}") for i in (1, 2)],
        (k + F.greatest(F.col("n") - F.col("h"), none)).alias("len"),
        F.when(F.col("n") > F.col("h"), F.col("total") + off).otherwise(F.coalesce(last["cum"], none)).alias("all")), "conversations")

    def row(depth, f1, f2, t1, t2, chars, cum):
        return ["conv_id", depth.cast("long").alias("depth"), f1.alias("f1"), f2.alias("f2"), t1.alias("t1"), t2.alias("t2"),
                chars.alias("chars"), (F.col("all") - cum + chars).alias("rem"), (depth == F.col("len")).alias("ends")]
    root = convs.select(*row(none, one, one, none, none, none, none))
    head = convs.select("conv_id", "len", "all", F.inline("head"))
    head = head.select(*row(*[F.col(c) for c in ("pos", "p1", "p2", "t1", "t2", "chars", "cum")]))
    rows = own.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    suffix = join_counted(own, convs.select("conv_id", F.col("n").alias("rows"), *[
        c for c in convs.columns if c not in ("conv_id", "head", "n")]), "conv_id", "rows", rows, "inner")
    suffix = suffix.filter(F.col("pos") > F.col("h")).select(*row(
        F.col("pos") + F.col("shift"), _compose(F.col("c1"), F.col("p1")), _compose(F.col("c2"), F.col("p2")),
        F.col("t1"), F.col("t2"), F.col("chars"), F.col("cum") + F.col("off")))
    return root.unionByName(head).unionByName(suffix)


def end_hashes(rows: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256): SHA-256 of the ids in ascending order, comma-joined."""
    def blocks(batches):
        for rb in batches:
            cols = [c.to_numpy() for c in rb.columns]
            if not rb.num_rows:
                continue
            new = np.zeros(rb.num_rows, bool)
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            head = np.flatnonzero(np.append(True, new[1:]))
            ids = np.split(cols[3], head[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[head]) for c in cols] + [pa.array([",".join(map(str, x.tolist())) for x in ids])],
                names=[*_NODE, "first", "ids"])

    def digests(batches):
        now, sha = None, None
        for rb in batches:
            done = []
            for *node, _, ids in zip(*[c.to_pylist() for c in rb.columns]):
                if node != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*_NODE, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=[*_NODE, "ends_sha256"])

    order = [*_NODE, "conv_id"]
    joined = (rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(blocks, "depth long, f1 long, f2 long, first long, ids string"))
    return (joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
            .mapInArrow(digests, "depth long, f1 long, f2 long, ends_sha256 string"))


def _holds(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    turns = turns_of(conversations)
    while True:
        named = with_fingerprints(turns, seed)
        own = own_prefixes(named)
        rows = stored(members(own), "trie-members")
        nodes = stored(rows.groupBy(*_NODE).agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"),
            (F.sum(F.col("ends").cast("long")) == F.count(F.lit(1))).alias("leaf"),
            ((F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))).alias("same")), "trie-nodes")
        unlike = named.groupBy("t1", "t2").agg((F.min("role") == F.max("role")).alias("r"), (F.min("text") == F.max("text")).alias("x"))
        if not _holds(nodes.filter("NOT same")) and not _holds(unlike.filter("NOT (r AND x)")):
            break
        seed += 1  # two different turns or prefixes had one fingerprint
    total = rows.count()
    shared = nodes.filter("n > 1").select(*_NODE, "owner", "leaf", "n")
    mine = F.col("owner") == F.col("conv_id")
    owned = stored(join_counted(rows.select(*_NODE, "conv_id", "chars", "rem", "ends"), shared, _NODE, "n", total).select(
        *_NODE, "conv_id", "chars", "rem", F.coalesce("owner", "conv_id").alias("owner"),
        F.coalesce("leaf", "ends").alias("leaf")), "trie-owners")
    # a conversation owns the nodes from ``since`` to its end; above them owners ascend
    paths = stored(owned.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("since"), F.max(F.when(~mine, F.col("owner"))).alias("above"),
        F.coalesce(F.sum(F.when(mine, F.col("chars"))), F.lit(0)).alias("own"),
        F.max(F.when(mine & F.col("leaf"), F.lit(1)).otherwise(0)).cast("long").alias("leaves"),
        F.max("depth").alias("len"), F.count(F.lit(1)).alias("m")), "trie-paths")
    known = join_counted(owned, paths, "conv_id", "m", total, "inner")
    out = known.groupBy(*_NODE).agg(
        F.min("owner").alias("conv_id"),
        F.max(F.when(mine, F.when(F.col("since") == F.col("depth"), F.col("above")).otherwise(F.col("owner")))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        (F.sum(F.when(F.col("since") == F.col("depth") + 1, F.lit(1)).otherwise(0))
         + F.max(F.when(mine & (F.col("len") > F.col("depth")), F.lit(1)).otherwise(0))).cast("long").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.coalesce(F.sum(F.when(~mine, F.col("rem") - F.col("own"))), F.lit(0)).cast("long").alias("saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    result = stored(out.join(end_hashes(rows.filter("ends")), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "trie")
    forget(owned, paths, rows, nodes)
    return result
