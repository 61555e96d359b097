"""Cross-site boilerplate lines by distinct-site spread.

Per line: how many sites it stands on, at how many places of different texts,
and in how many contexts (the lines before and after it), as HyperLogLog
sketches per line hash that merge by aggregation.  A line is boilerplate if it
is on at least ``MIN_SITES`` sites, in as many contexts, and the contexts are at
least half as many as the places.  Copies of a text add neither, so they cannot
dilute a line's contexts; the lines of a document with many copies or near
copies stand on many sites too, but in few contexts for their places, and are
left to the document deduplication.  Lines whose estimates are near a threshold get exact distinct
counts.

Up to ``MAX_IN_ROW`` boilerplate lines (counted) are looked up inside the rows,
as a constant table of buckets, without a shuffle of the documents; more are
joined, salted, and found by the same hashes.

Only DataFrame functions.  Lines are the ``\\n``-separated parts of a text; a
line without a word is never boilerplate.  Nulls: a null text has no lines and
stays null; a null site is no site.  An empty text is one empty line.  Repeated
rows count as copies, and each is cleaned.  Thresholds include their own value
(ties are boilerplate).  An empty table gives no rows.  Helper columns take names
that the table does not have.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import row_hash, unused_name
from .components import stored

MIN_SITES = 10
CONTEXT_SHARE = 0.5
LG_K = 12     # standard error 1.6 %
BAND = 0.10   # six standard errors
SHARE_BAND = 0.15   # six of a quotient of two estimates
SALTS = 16
MAX_IN_ROW = 4096
_SPACES = r"[\x20\x09-\x0D]"


def _two(value: Column, a: str, b: str) -> list[Column]:
    """A 128-bit hash as two columns."""
    return [F.xxhash64(value).alias(a), F.xxhash64(F.lit(1), value).alias(b)]


def line_rows(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(t1, t2, site, pos, h1, h2, context) per line that has a word; t1, t2 hash the whole text."""
    t = docs.select(*_two(F.col(text_col), "t1", "t2"), F.col(site_col).cast("string").alias("site"),
                    F.split(F.col(text_col), "\n").alias("a")).filter("a is not null")
    n = F.size("a")
    blank = F.array(F.lit(""))
    t = t.withColumn("z", F.arrays_zip(F.col("a").alias("line"),
                                       F.concat(blank, F.slice("a", 1, n - 1)).alias("prev"),
                                       F.concat(F.slice("a", 2, n), blank).alias("next")))
    rows = t.select("t1", "t2", "site", F.posexplode("z").alias("pos", "z"))
    rows = rows.filter(F.regexp_replace("z.line", _SPACES, "") != "")
    return rows.select("t1", "t2", "site", "pos", *_two(F.col("z.line"), "h1", "h2"),
                       F.xxhash64("z.prev", "z.next").alias("context"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, share: float = CONTEXT_SHARE) -> DataFrame:
    """(h1, h2) of the boilerplate lines."""
    place = F.xxhash64("t1", "t2", "pos")
    est = (lines.groupBy("h1", "h2")
           .agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"),
                F.hll_sketch_agg("context", F.lit(LG_K)).alias("c"), F.hll_sketch_agg(place, F.lit(LG_K)).alias("p"))
           .filter(F.col("n") >= min_sites)
           .select("h1", "h2", *(F.hll_sketch_estimate(k).alias(name)
                                 for k, name in (("s", "sites"), ("c", "contexts"), ("p", "places")))))
    est = stored(est, "line-spread")
    slack = max(1.0, BAND * min_sites)
    least = F.least("sites", "contexts")
    wide, few = least >= min_sites + slack, least < min_sites - slack
    mixed = F.col("contexts") >= F.col("places") * (share * (1 + SHARE_BAND))
    fixed = F.col("contexts") < F.col("places") * (share * (1 - SHARE_BAND))
    sure = est.filter(wide & mixed).select("h1", "h2")
    near = est.filter(~few & ~fixed & ~(wide & mixed)).select("h1", "h2")
    counted = (lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2")
               .agg(F.countDistinct("site").alias("sites"), F.countDistinct("context").alias("contexts"),
                    F.countDistinct("t1", "t2", "pos").alias("places"))
               .filter((F.least("sites", "contexts") >= min_sites) & (F.col("contexts") >= F.col("places") * share)))
    return sure.unionByName(counted.select("h1", "h2"))


def _found_in_row(text: Column, found: list[tuple[int, int]]) -> Column:
    """Numbers of the lines whose hashes are in ``found``, from a constant table of buckets; null if there is none."""
    size = 1 << max(0, len(found) - 1).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for h1, h2 in found:
        buckets[h1 % size].append({"a": h1, "b": h2})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<a:bigint,b:bigint>>>")

    def number(line: Column, i: Column) -> Column:
        h1, h2 = F.xxhash64(line), F.xxhash64(F.lit(1), line)
        known = F.get(table, F.pmod(h1, F.lit(size).cast("long")).cast("int"))
        return F.when(F.exists(known, lambda k: (k["a"] == h1) & (k["b"] == h2)), i)

    at = F.filter(F.transform(F.split(text, "\n"), number), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, at)


def mark(docs: DataFrame, text_col: str = "text", site_col: str = "source", name: str = "removed",
         min_sites: int = MIN_SITES, share: float = CONTEXT_SHARE, max_in_row: int = MAX_IN_ROW) -> DataFrame:
    """``docs`` with the 0-based numbers of the boilerplate lines of each row (null where there is none)."""
    lines = line_rows(docs, text_col, site_col)
    found = stored(boilerplate(lines, min_sites, share), "boilerplate")
    few = found.limit(max_in_row + 1).collect()
    if len(few) <= max_in_row:
        return docs.withColumn(name, _found_in_row(F.col(text_col), [(r.h1, r.h2) for r in few]))
    # a line can be in a large share of all texts, and a text in a large share of all rows: both are dealt over several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    hit = lines.select("t1", "t2", "pos", "h1", "h2", F.pmod("t1", F.lit(SALTS)).cast("int").alias("salt")).join(
        found.select("h1", "h2", salts.alias("salt")), ["h1", "h2", "salt"])
    k1, k2, k3 = unused_name(docs, "_ls_1"), unused_name(docs, "_ls_2"), unused_name(docs, "_ls_3")
    per = hit.groupBy(F.col("t1").alias(k1), F.col("t2").alias(k2)).agg(F.sort_array(F.collect_set("pos")).alias(name))
    keyed = docs.select("*", *_two(F.col(text_col), k1, k2), F.pmod(row_hash(docs), F.lit(SALTS)).cast("int").alias(k3))
    return keyed.join(per.withColumn(k3, salts), [k1, k2, k3], "left").drop(k1, k2, k3)


def remove_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, share: float = CONTEXT_SHARE,
                       max_in_row: int = MAX_IN_ROW) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the texts; all else as it was."""
    name = unused_name(docs, "_ls_removed")
    marked = mark(docs, text_col, site_col, name, min_sites, share, max_in_row)
    return marked.withColumn(text_col, cleaned(text_col, name)).select(*docs.columns)


def cleaned(text_col: str, removed: str) -> Column:
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(removed), i))
    return F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
