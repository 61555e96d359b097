"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is ``WINDOW`` consecutive words of an item, or a whole shorter item.
Instead of every window of a document only every ``stride``-th shorter n-gram
is looked up: n-gram length and stride are chosen so that each occurrence of a
window contains exactly one looked-up n-gram whole, so nothing is missed and
each occurrence is found once.  The hash set is broadcast if its counted size
is within ``MAX_BROADCAST_KEYS`` and is a shuffled join beyond.  What the set
lets through is verified word by word against the windows.

Only DataFrame functions.  A document is its id and the hash of its text, so
rows that repeat an id are kept apart.  Nulls: a null text has no words, is not
contaminated and is kept; items without words have no window.  Repeated rows
each get their result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..util import unused_name

WINDOW = 13
HIT_SHARE = 20  # contaminated from one hit word in 20
MAX_BROADCAST_KEYS = 4_000_000
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_SEP_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the same before lower-casing
_WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def with_words(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the array of lower-cased (A-Z) words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn(name, F.split(F.coalesce(low, F.lit("")), _SEP + "+"))
    w = F.col(name)
    lead = F.when(F.get(w, 0) == "", 1).otherwise(0)
    tail = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return df.withColumn(name, F.slice(w, lead + 1, F.size(w) - lead - tail))


def _scheme(m: int) -> tuple[int, int]:
    """(stride, n-gram length) for windows of ``m`` words."""
    stride = m // 2 + 1
    return stride, m - stride + 1


def _gram(words: Column, i: Column, m: int) -> Column:
    return F.xxhash64(F.lit(m), *[F.get(words, i + (j - 1)) for j in range(_scheme(m)[1])])


def bench_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """Distinct windows: (m, words, items)."""
    b = with_words(bench.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t")), F.col("t"), "w")
    m = F.least(F.size("w"), F.lit(window))
    b = b.filter(F.size("w") > 0).withColumn("m", m)
    b = b.withColumn("a", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    return (b.select("m", F.slice("w", F.col("a"), F.col("m")).alias("words"), "item")
            .groupBy("m", "words").agg(F.collect_set(F.col("item").cast("string")).alias("items")))


def _window_grams(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(h, d, m, words, items): the n-gram ``d`` words into each window."""
    out = None
    for m in lengths:
        grams = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _gram(F.col("words"), F.lit(d + 1), m).alias("h"))
                                    for d in range(_scheme(m)[0])]))
        part = windows.filter(F.col("m") == m).withColumn("g", grams).select("g.h", "g.d", "m", "words", "items")
        out = part if out is None else out.unionByName(part)
    return out


_ENTRY = "struct<m:int,i:int,before:int,h:bigint,near:array<string>>"


def _lookups(words: Column, n: Column, m: int) -> Column:
    """The looked-up n-grams of a document for windows of ``m`` words, with the words around them."""
    stride, k = _scheme(m)

    def entry(i: Column) -> Column:
        before = F.least(i - 1, F.lit(stride - 1))
        return F.struct(F.lit(m).alias("m"), i.alias("i"), before.alias("before"), _gram(words, i, m).alias("h"),
                        F.slice(words, i - before, before + k + stride - 1).alias("near"))

    found = F.transform(F.sequence(F.lit(1), n - (k - 1), F.lit(stride)), entry)
    return F.when(n >= m, found).otherwise(F.array().cast(f"array<{_ENTRY}>"))


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW,
         max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) per row; spans are merged word ranges [from, to)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "bench-windows")
    bench_windows(bench, bench_id, bench_text, window).write.parquet(path)
    windows = spark.read.schema("m int, words array<string>, items array<string>").parquet(path)
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most ``window`` values

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    src = src.withColumn("text_hash", F.xxhash64("t"))
    src = with_words(src, F.col("t"), "w").select("doc_id", "text_hash", "w", F.size("w").alias("n_words"))
    marker = F.array(F.lit(None).cast(_ENTRY))
    looked = F.concat(marker, *[_lookups(F.col("w"), F.col("n_words"), m) for m in lengths])
    rows = src.select("doc_id", "text_hash", "n_words", F.explode(looked).alias("e"))
    rows = rows.select("doc_id", "text_hash", "n_words", "e.*")
    if lengths:
        grams = _window_grams(windows, lengths)
        keys = grams.select("h", F.lit(True).alias("on")).distinct()
        if keys.limit(max_broadcast_keys + 1).count() <= max_broadcast_keys:
            rows = rows.join(F.broadcast(keys), "h", "left").filter("h is null or on").drop("on")
        else:
            rows = rows.filter("h is null").unionByName(rows.join(keys.select("h"), "h", "left_semi"))
    # one row per document, and the few n-grams that are also in a window
    found = scratch_path(spark, "bench-candidates")
    rows.write.parquet(found)
    rows = spark.read.schema(rows.schema).parquet(found)
    docs_seen = rows.filter("h is null").select("doc_id", "text_hash", "n_words")
    if not lengths:
        return docs_seen.withColumn("spans", F.array().cast("array<struct<from:int,to:int>>")).withColumn(
            "items", F.array().cast("array<string>"))
    near = F.slice("near", F.col("before") - F.col("d") + 1, F.col("m"))
    true = (rows.filter("h is not null").join(grams, ["h", "m"]).filter("before >= d")
            .filter(near == F.col("words")))
    start = F.col("i") - F.col("d") - 1
    per = (true.select("doc_id", "text_hash", start.alias("from"), (start + F.col("m")).alias("to"), "items")
           .groupBy("doc_id", "text_hash")
           .agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("raw"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    per = per.withColumn("spans", _merge("raw")).drop("raw")
    same = [docs_seen["doc_id"].eqNullSafe(per["doc_id"]), docs_seen["text_hash"].eqNullSafe(per["text_hash"])]
    none = F.array().cast("array<struct<from:int,to:int>>")
    return docs_seen.join(per, same, "left").select(
        docs_seen["doc_id"], docs_seen["text_hash"], "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merge(name: str) -> Column:
    """Sorted ranges to disjoint ranges: a range that starts past all before it opens a new one."""
    return F.expr(f"""
        aggregate({name}, cast(array() as array<struct<from:int,to:int>>), (acc, x) ->
            if(size(acc) > 0 and element_at(acc, -1).to >= x.from,
               concat(slice(acc, 1, size(acc) - 1),
                      array(struct(element_at(acc, -1).from as from, greatest(element_at(acc, -1).to, x.to) as to))),
               concat(acc, array(struct(x.from as from, x.to as to)))))""")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated) from ``hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return found.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256)
        .alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``documents``: drop contaminated rows.  ``spans``: cut the hit words out of every text instead.

    All columns are returned as they are, in ``spans`` mode but for the text.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    found = hits(docs, bench, id_col, text_col, **options)
    rid, rth, here = unused_name(docs, "_dc_id"), unused_name(docs, "_dc_hash"), unused_name(docs, "_dc_text")
    key = docs.withColumn(rth, F.xxhash64(F.col(text_col).cast("string")))
    if mode == "documents":
        bad = report(found).filter("contaminated").select(F.col("doc_id").alias(rid), F.col("text_hash").alias(here))
        bad = bad.distinct()
        cond = key[id_col].eqNullSafe(bad[rid]) & (key[rth] == bad[here])
        return key.join(bad, cond, "left_anti").drop(rth)
    cut_col = unused_name(docs, "_dc_spans")
    cut = (found.filter(F.size("spans") > 0)
           .select(F.col("doc_id").alias(rid), F.col("text_hash").alias(here), F.col("spans").alias(cut_col)).distinct())
    cond = key[id_col].eqNullSafe(cut[rid]) & (key[rth] == cut[here])
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{_SEP_RAW}*{_WORD_RAW}+|{_SEP_RAW}+$"), 0)
    left = F.filter(pieces, lambda x, i: ~F.exists(F.col(cut_col), lambda s: (s["from"] <= i) & (i < s["to"])))
    out = key.join(cut, cond, "left").withColumn(
        text_col, F.when(F.col(cut_col).isNull(), F.col(text_col)).otherwise(F.array_join(left, "")))
    return out.select(*docs.columns)
