"""Repetition-coverage quality rules.

Per document: how many characters lie inside word n-grams and lines that stand
earlier in it too.  Words become dense ids per Arrow batch (exact); the
n-grams of a whole batch are rolling polynomial hashes modulo 2**64 over the
mixed ids, with the document mixed in.  An n-gram can only be repeated where
the shorter n-grams at its start and one word on are, so each length is looked
for only at the places that the length before it left.

Nulls: a null text has no words.  Empty text, repeated rows and very long
texts need no special case; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..util import unused_name
from .text import Words, find_words, mix64, span_strings, sub_batches, word_ids

#: n-gram length -> largest share of word characters inside n-grams that stand earlier in the text too; the
#: values of the published web-text rules.  First occurrences do not count, as with the lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_CHAR_LIMIT = 0.30
SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 50
WINDOW = 3
TEXT_BYTES = 512 << 10  # of text at once, as the arrays of its words take many times that
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_B = np.uint64(0x9E3779B97F4A7C15)

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
          *[f"dup_{n}gram_chars" for n in NGRAM_LIMITS]]


def _per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more, and which of these have occurred before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    out = later.copy()
    out[order[:-1][same]] = True
    return out, later


class _Rolling:
    """Rolling n-gram hashes over the words of a batch, grown one word at a time."""

    def __init__(self, w: Words, ids: np.ndarray):
        self.w, self.code = w, mix64(ids)
        self.at = np.arange(len(ids))       # where an n-gram that may be repeated starts
        self.n = 1
        self.h = self.code ^ mix64(w.doc + (1 << 48))  # apart from every word id
        self.left = w.word_off[w.doc + 1]   # end of the word's document

    def grow_to(self, n: int) -> None:
        """Hashes of length ``n`` at the places where all of it lies in one document."""
        fits = self.at + n <= self.left[self.at]
        self.at, self.h = self.at[fits], self.h[fits]
        for k in range(self.n, n):
            self.h = self.h * _B + self.code[self.at + k]
        self.n = n

    def keep_repeated(self) -> np.ndarray:
        """Starts of the repeated n-grams; later lengths look only at these."""
        rep, later = _repeated(self.h)
        self.at, self.h, self.later = self.at[rep], self.h[rep], later[rep]
        return self.at

    def covered(self, again: bool = False) -> np.ndarray:
        """Which words lie in a repeated n-gram (``again``: in an occurrence after the first)."""
        at = self.at[self.later] if again else self.at
        edge = np.zeros(len(self.code) + 1, np.int32)
        edge[at] += 1
        np.add.at(edge, at + self.n, -1)
        return np.cumsum(edge[:-1]) > 0


def _lines(data: np.ndarray, off: np.ndarray, in_word: np.ndarray, chars: np.ndarray):
    """(document, dense id, characters) of every line that has a word."""
    n_docs = len(off) - 1
    nl = np.flatnonzero(data == 10)
    nl_doc = np.searchsorted(off, nl, side="right") - 1
    starts = np.concatenate([off[:-1], nl + 1])
    doc = np.concatenate([np.arange(n_docs), nl_doc])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends[:-1] = starts[1:] - 1
    ends[last] = off[doc[last] + 1]
    ids = span_strings(data, data != 10, ends - starts).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    in_upto = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    real = in_upto[ends] > in_upto[starts]
    return doc[real], ids[real].astype(np.int64), (chars[ends] - chars[starts])[real]


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every row of a text column."""
    w = find_words(col)
    n = len(w.doc_off) - 1
    chars = np.concatenate([[0], np.cumsum(w.in_word & ((w.data & 0xC0) != 0x80), dtype=np.int64)])
    word_chars = chars[w.ends] - chars[w.starts]
    symbols = np.flatnonzero(_SYMBOLS[w.data])
    out = {"n_words": np.diff(w.word_off), "word_chars": _per_doc(w.doc, n, word_chars),
           "n_symbols": _per_doc(np.searchsorted(w.doc_off, symbols, side="right") - 1, n)}
    doc, ids, size = _lines(w.data, w.doc_off, w.in_word, chars)
    first = np.zeros(len(ids), bool)
    first[np.unique(doc * (ids.max(initial=0) + 1) + ids, return_index=True)[1]] = True
    out["n_dup_lines"] = _per_doc(doc[~first], n)
    out["dup_line_chars"] = _per_doc(doc[~first], n, size[~first])
    roll = _Rolling(w, word_ids(w)[0])
    roll.grow_to(WINDOW)
    roll.keep_repeated()
    covered = roll.covered()
    out["n_repeat_words"] = _per_doc(w.doc[covered], n)
    for k in NGRAM_LIMITS:
        roll.grow_to(k)
        roll.keep_repeated()
        covered = roll.covered(again=True)
        out[f"dup_{k}gram_chars"] = _per_doc(w.doc[covered], n, word_chars[covered])
    return out


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) for every row; one Arrow pass, no shuffle."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType)]
                          + [T.StructField(f, T.LongType()) for f in FIELDS])

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", TEXT_BYTES):
                m = measure(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m[f].astype(np.int64)) for f in FIELDS]],
                                                 names=["doc_id", *FIELDS])

    return src.mapInArrow(run, schema)


def _rules(m) -> tuple[Column, Column]:
    """(fails the base rules, fails any rule); ``m`` gives a count's column by name."""
    base = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    bad = (base | (m("dup_line_chars") > F.lit(DUP_LINE_CHAR_LIMIT) * m("word_chars"))
           | (m("n_symbols") > F.lit(SYMBOLS_PER_WORD) * m("n_words")))
    for n, limit in NGRAM_LIMITS.items():
        bad = bad | (m(f"dup_{n}gram_chars") > F.lit(limit) * m("word_chars"))
    return base, bad


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row, with ``base_failed`` and ``kept``."""
    base, bad = _rules(F.col)
    return repetition_counts(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~bad)


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns, unchanged.

    The verdict is a function of the text alone, so it is a column of the
    scan: nothing is shuffled.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf("struct<" + ",".join(f"{f}:long" for f in FIELDS) + ">")
    def counts(text: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([text], names=["text"])
        parts = [measure(b.column(0)) for b in sub_batches(whole, "text", TEXT_BYTES)]
        columns = [np.concatenate([np.zeros(0, np.int64), *(m[f] for m in parts)]).astype(np.int64) for f in FIELDS]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=FIELDS)

    name = unused_name(docs, "_ql")
    _, bad = _rules(lambda f: F.col(name)[f])
    return docs.withColumn(name, counts(F.col(text_col).cast("string"))).filter(~bad).drop(name)
