"""URL filtering: host/path rules, then a Bloom filter cascade over a list of keys.

Level 1 holds the listed keys; level 2 the unlisted keys of the corpus that
level 1 lets through; level 3 the listed keys that level 2 lets through; and
so on until nothing is let through by mistake.  The first level that lacks a
key decides: an odd level says "not listed", an even one "listed".  Over the
universe that the cascade was built on this is exact, and a lookup reads a few
bits of constant arrays: no join.

Only DataFrame functions: a level is an aggregation (``bit_or`` of bit masks)
and reaches the lookups as a scalar subquery.  A level's array is held to
``MAX_LEVEL_BYTES``, by the counted keys and each level's own rate; for a longer
list membership is an equi-join on the key.

Nulls: a null url, or one without ``://``, has empty host and path.  Null keys
are not in the universe and never listed.  Repeated rows are judged alike, and
a key is listed if any of its rows is.  Of rules of equal length that fit, the
first by host and path is taken.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..util import unused_name

MAX_LEVEL_BYTES = 64 << 20
LATER_FP = 1 / 16
MAX_LEVELS = 64

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))


class Level(NamedTuple):
    words: DataFrame  # one row: array<bigint>
    bits: int
    hashes: int
    salt: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(longest fitting rule like ``net/``, its verdict); null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _size(n: int, fp: float) -> tuple[int, int]:
    """(bits, hash functions) for ``n`` keys at a false-positive rate."""
    hashes = max(1, round(math.log2(1 / fp)))
    return 64 * max(1, math.ceil(n * hashes * 1.4427 / 64)), hashes


def first_rate(n_listed: int, n_unlisted: int) -> float:
    """False-positive rate of level 1: about as many unlisted keys get through as there are listed ones."""
    return min(0.5, math.sqrt(0.5) * n_listed / n_unlisted) if n_listed and n_unlisted else LATER_FP


def largest_level(n_listed: int, n_unlisted: int) -> int:
    """Bytes of the largest level: the first, at its own rate.

    Level 2 holds the fewer than ``n_listed`` keys that level 1 lets through,
    every later one a part of those two levels ago.
    """
    return max(_size(n_listed, first_rate(n_listed, n_unlisted))[0], _size(n_listed, LATER_FP)[0]) // 8


def build_level(keys: DataFrame, n: int, fp: float, salt: int) -> Level:
    """A Bloom filter of the ``key`` column as one row of 64-bit words, written to the scratch folder."""
    spark = keys.sparkSession
    bits, hashes = _size(n, fp)
    words = (keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("pos"))
             .groupBy(F.expr("pos div 64").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("m")))
    dense = spark.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    one = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m")))),
                                lambda x: x["m"]).alias("words"))
    path = scratch_path(spark, "bloom-level")
    one.write.parquet(path)
    return Level(spark.read.parquet(path), bits, hashes, salt)


def in_level(key: Column, level: Level) -> Column:
    """Does the level let the key through?"""
    words = level.words.scalar()
    ok = None
    for pos in _positions(key, level.bits, level.hashes, level.salt):
        bit = F.getbit(F.get(words, F.floor(pos / F.lit(64)).cast("int")), (pos % F.lit(64)).cast("int")) == 1
        ok = bit if ok is None else ok & bit
    return ok


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for a universe of distinct (``key``, ``listed``)."""
    spark = universe.sparkSession
    path = scratch_path(spark, "universe")
    universe.filter(F.col("key").isNotNull()).select("key", "listed").write.partitionBy("listed").parquet(path)
    schema = "key string, listed boolean"
    both = spark.read.schema(schema).parquet(path)
    sizes = {r["listed"]: r["n"] for r in both.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    sides = {s: both.filter(F.col("listed") == s).select("key") for s in (True, False)}
    size = {s: sizes.get(s, 0) for s in (True, False)}
    levels: list[Level] = []
    side, fp = True, first_rate(size[True], size[False])
    while size[side]:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("two keys with equal hashes, one of them listed")
        level = build_level(sides[side], size[side], fp, len(levels) + 1)
        levels.append(level)
        other = not side
        through = scratch_path(spark, "through")
        sides[other].filter(in_level(F.col("key"), level)).write.parquet(through)
        sides[other] = spark.read.schema("key string").parquet(through)
        size[other] = sides[other].count()
        side, fp = other, LATER_FP
    return levels


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Listed?  Exact for every key of the universe; null keys are not listed."""
    out = None
    for i, level in enumerate(levels, 1):
        absent = ~in_level(key, level)
        answer = F.lit(i % 2 == 0)
        out = F.when(absent, answer) if out is None else out.when(absent, answer)
    if out is None:
        return F.lit(False)
    return F.when(key.isNull(), F.lit(False)).otherwise(out.otherwise(F.lit(len(levels) % 2 == 1)))


def judge(pages: DataFrame, listed: Column, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          max_level_bytes: int = MAX_LEVEL_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (replacing columns of these names).

    ``listed`` marks the rows whose key (host and path) goes on the list; a key
    is listed if any of its rows is.
    """
    host, path = host_and_path(F.col(url_col))
    key, part = unused_name(pages, "_uc_key"), unused_name(pages, "_uc")
    at = F.col(part)
    rule, said = match_rule(at["host"], at["path"], rules)
    named = pages.withColumn(part, F.struct(host.alias("host"), path.alias("path")))
    named = named.withColumn(key, F.concat(at["host"], at["path"]))
    universe = named.groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(listed, F.lit(False))).alias("listed"))
    sizes = {r["listed"]: r["n"] for r in universe.filter(F.col("key").isNotNull()).groupBy("listed").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if largest_level(sizes.get(True, 0), sizes.get(False, 0)) > max_level_bytes:
        mark = unused_name(pages, "_uc_listed")
        on_list = universe.filter("listed").select(F.col("key").alias(key), F.lit(True).alias(mark))
        named, member = named.join(on_list, key, "left"), F.coalesce(F.col(mark), F.lit(False))
    else:
        member = in_cascade(F.col(key), build_cascade(universe))
    keep = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return named.select(*keep, at["host"].alias("host"), at["path"].alias("path"), rule.alias("rule"),
                        F.coalesce(said, F.when(member, "block").otherwise("allow")).alias("verdict"))
