"""Best-two-fit packing of tokenised documents into fixed-length sequences.

``tokenize`` turns documents into pieces of at most ``capacity`` tokens.
``pack`` plans on the histogram of piece lengths, which never has more than
``capacity`` entries however large the corpus is: a bin is filled greedily
with the longest unpacked piece that still fits, then its smallest member is
replaced by two unpacked pieces that fill the enlarged gap more tightly.  A
bin layout is repeated for as long as the counts allow, so the plan is the one
that the sequential algorithm makes, in a bounded number of layouts.  The
pieces then take their places by their rank among the pieces of equal length;
ranks come from row counts of small file ranges, so a length that holds most
of the corpus is still ranked by many tasks.

Nulls: a null text is an empty document (one end token).  A null id is kept.
Repeated rows are packed once each.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .components import stored
from .text import LOWER, find_words, sub_batches, word_ids

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 500_000
TEXT_BYTES = 512 << 10  # of text at once: the arrays over its bytes, words and tokens take some 50 times that
_BLOCK = 2000
RANK_ROWS = 65_536
_END_OF_WORD = "</w>"


_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts, by way of their distinct white-space-free runs.

    Exact for a tokenizer whose normaliser and pre-tokenizer never look across
    ASCII white space and drop it, and which cuts between a letter and a
    punctuation mark.  Distinct runs are encoded once per batch; the first
    ``CACHE_WORDS`` of them stay for later batches and tasks of the worker, as
    Arrow and NumPy arrays: the worker lives on through other stages, and
    as many Python strings in a dict take three times the memory.
    """

    @staticmethod
    def of(path: str) -> WordTokenizer:
        """The Python worker's own one, kept between tasks."""
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        return _TOKENIZERS[path]

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        norm = json.loads(self.tok.to_str())["normalizer"] or {}
        self.lower = "Lowercase" in {x.get("type") for x in norm.get("normalizers", [norm])}
        self.marks = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(_END_OF_WORD)]] = True
        self.words = pa.array([], pa.large_string())
        self.hashes = np.zeros(0, np.uint64)  # of the words, ascending
        self.slots = np.zeros(0, np.int32)    # the word of each hash
        self.lens = np.zeros(0, np.int32)
        self.offs = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _find(self, distinct: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of every word, -1 for unknown ones; words are compared, so equal hashes do no harm."""
        slot = np.full(len(distinct), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            maybe = np.flatnonzero(self.hashes[at] == hashes)
            cand = self.slots[at[maybe]]
            same = pc.equal(self.words.take(pa.array(cand)), distinct.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
            slot[maybe[same]] = cand[same]
        return slot

    def _keep(self, fresh: pa.Array, hashes: np.ndarray) -> None:
        """Add words, which take the next slots."""
        slots = np.concatenate([self.slots, np.arange(len(self.words), len(self.words) + len(fresh), dtype=np.int32)])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slots = hashes[order], slots[order]
        self.words = pa.concat_arrays([self.words, fresh])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, offsets into the ids, ids) of new words.

        Plain runs (letters, maybe closing marks) are encoded many at a time
        and cut apart at the tokens that close a pre-token, if their number is
        the expected one; all others one by one.
        """
        col = pa.array(words, pa.large_string())
        one = pc.match_substring_regex(col, r"^(\p{L}+|[.,!;:?]+)$").to_numpy(zero_copy_only=False)
        two = pc.match_substring_regex(col, r"^\p{L}+[.,!;:?]+$").to_numpy(zero_copy_only=False)
        ends = one.astype(np.int64) + 2 * two
        lens, offs = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat: list[np.ndarray] = []
        at = 0
        plain = np.flatnonzero(ends)
        single = [np.flatnonzero(ends == 0)]
        for lo in range(0, len(plain), _BLOCK):
            block = plain[lo:lo + _BLOCK]
            enc = self.tok.encode_batch_fast(["\n".join([words[i] for i in block])], add_special_tokens=False)[0]
            ids = np.array(enc.ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            upto = np.cumsum(ends[block])
            if len(stops) != upto[-1] or stops[-1] != len(ids):
                single.append(block)
                continue
            cut = np.concatenate([[0], stops[upto - 1]])
            lens[block], offs[block] = np.diff(cut), at + cut[:-1]
            flat.append(ids)
            at += len(ids)
        rest = np.concatenate(single)
        for lo in range(0, len(rest), _BLOCK):
            block = rest[lo:lo + _BLOCK]
            got = [e.ids for e in self.tok.encode_batch_fast([words[i] for i in block], add_special_tokens=False)]
            lens[block] = [len(x) for x in got]
            offs[block] = at + np.cumsum(lens[block]) - lens[block]
            flat.append(np.array([i for x in got for i in x], np.uint32))
            at += len(flat[-1])
        return lens, offs, np.concatenate(flat) if flat else np.zeros(0, np.uint32)

    def encode_column(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with ``end_id`` after each, row offsets into them)."""
        w = find_words(col, split_marks=True)
        raw = w.data.tobytes()
        if self.lower and not any(m in raw for m in self.marks):
            # added tokens are looked for before lower-casing; a run with other bytes is left to the tokenizer,
            # which composes first: a capital and its accent may have a composed form in lower case only
            high = np.concatenate([[0], np.cumsum(w.data >= 0x80, dtype=np.int32)])
            plain = high[w.ends] == high[w.starts]
            edge = np.zeros(len(w.data) + 1, np.int8)
            edge[w.starts[plain]] += 1
            edge[w.ends[plain]] -= 1
            w = w._replace(data=np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, LOWER[w.data], w.data))
        ids, distinct = word_ids(w)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.as_buffer()) for x in distinct), np.uint64, len(distinct))
        slot = self._find(distinct, hashes)
        new = np.flatnonzero(slot < 0)
        known, all_lens, all_offs, all_ids = len(self.lens), self.lens, self.offs, self.ids
        if len(new):
            fresh = distinct.take(pa.array(new))
            lens, offs, flat = self._encode(fresh.to_pylist())
            slot[new] = np.arange(known, known + len(new))
            all_offs = np.concatenate([all_offs, len(all_ids) + offs])
            all_lens, all_ids = np.concatenate([all_lens, lens.astype(np.int32)]), np.concatenate([all_ids, flat])
            if known < CACHE_WORDS:
                self._keep(fresh, hashes[new])
                self.lens, self.offs, self.ids = all_lens, all_offs, all_ids
        n_docs = len(w.doc_off) - 1
        at = slot[ids] if len(ids) else ids
        lens, offs = all_lens[at].astype(np.int64), all_offs[at]
        upto = np.concatenate([[0], np.cumsum(lens)])
        doc_off = upto[w.word_off] + np.arange(n_docs + 1)
        out = np.full(int(upto[-1]) + n_docs, end_id, np.uint32)
        total = int(upto[-1])
        if total:
            place = np.arange(total)
            src = all_ids[place + np.repeat(offs - upto[:-1], lens)]
            out[place + np.repeat(w.doc, lens)] = src
        return out, doc_off


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (id, piece, start, length, ids_crc32[, ids]).

    A document is its ids, then ``end_id``; only documents above ``capacity``
    are cut.  ``ids_crc32`` is over little-endian unsigned 32-bit ids.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        tok = WordTokenizer.of(tokenizer_path)
        for whole in batches:
            for batch in sub_batches(whole, "text", TEXT_BYTES):
                ids, off = tok.encode_column(batch.column(1), end_id)
                n = np.diff(off)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                lo = (off[row] + start).tolist()
                hi = (off[row] + start + length).tolist()
                crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(lo, hi)), np.int64, len(row))
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                        pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:  # the pieces of a batch are its ids in order
                    cut = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType(fields))


def _largest(mask: int, limit: int) -> int:
    """The largest set bit at or below ``limit`` (0 if none; lengths start at 1)."""
    m = mask & ((2 << limit) - 1)
    return m.bit_length() - 1 if m else 0


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-two-fit layouts: [(member lengths, how many bins use them)]."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    mask = sum(1 << k for k in left)
    bins: list[tuple[list[int], int]] = []
    while mask:
        used: Counter[int] = Counter()
        free = mask
        members: list[int] = []

        def take(size: int) -> None:
            nonlocal free
            members.append(size)
            used[size] += 1
            if used[size] >= left[size]:
                free &= ~(1 << size)

        def give_back(size: int) -> None:
            nonlocal free
            members.remove(size)
            used[size] -= 1
            free |= 1 << size

        take(_largest(free, capacity))
        gap = capacity - members[0]
        while gap and (size := _largest(free, gap)):
            take(size)
            gap -= size
        while gap and len(members) > 1:
            smallest = min(members)
            room = gap + smallest
            give_back(smallest)
            best, pair = smallest, None
            a = _largest(free, room - 1)
            while a * 2 > best and a:
                spare = left[a] - used[a]
                b = _largest(free, min(room - a, a if spare > 1 else a - 1))
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = _largest(free, a - 1)
            if pair is None:
                take(smallest)
                break
            take(pair[0])
            take(pair[1])
            gap = room - best
        times = min(left[s] // n for s, n in used.items() if n)
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                mask &= ~(1 << s)
        bins.append((sorted(members, reverse=True), times))
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, consecutive rank ranges: (length, first rank, bins, first bin, offset)."""
    rows, seen, base = [], Counter(), 0
    for members, times in bins:
        at = 0
        for size, n in sorted(Counter(members).items(), reverse=True):
            rows.append((size, seen[size], times, base, at))
            seen[size] += n * times
            at += n * size
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "times", "base", "at"), table.T.copy()))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` column.

    The pieces are written once to the scratch folder, so that every later
    reader, also a retried task, ranks the same rows in the same order.  That
    job runs the tokenizer, with the small Arrow batches of ``stored``.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    extra = [c for c in pieces.columns if c != "ids"]
    place = stored(pieces, "pieces").select("*", F.col("_metadata.file_name").alias("_pk_file"),
                                             F.col("_metadata.row_index").alias("_pk_row"))
    place = place.withColumn("_pk_block", F.floor(F.col("_pk_row") / RANK_ROWS))
    keys = ["length", "_pk_file", "_pk_block"]
    counts = place.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pk_n"))
    upto = Window.partitionBy("length").orderBy("_pk_file", "_pk_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, F.coalesce(F.sum("_pk_n").over(upto), F.lit(0)).alias("_pk_before"))
    histogram = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                 counts.groupBy("length").agg(F.sum("_pk_n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))

    ids = ["_pk_file", "_pk_row"] if "ids" in pieces.columns else []
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("_pk_row")) - 1
    ranked = (place.select(*extra, *[c for c in keys if c != "length"], "_pk_row")
              .withColumn("_pk_local", local).join(before, keys)
              .select(*extra, *ids, (F.col("_pk_before") + F.col("_pk_local")).alias("_pk_rank")))
    out_fields = [ranked.schema[c] for c in [*extra, *ids]]
    schema = T.StructType(out_fields + [T.StructField("sequence_id", T.LongType()),
                                        T.StructField("offset", T.LongType())])
    wide = int(slots["rank"].max(initial=0) + 1 + max(histogram.values(), default=0))
    key = slots["size"] * wide + slots["rank"]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            size = t["length"].to_numpy().astype(np.int64)
            rank = t["_pk_rank"].to_numpy().astype(np.int64)
            s = np.searchsorted(key, size * wide + rank, side="right") - 1
            copy, number = np.divmod(rank - slots["rank"][s], slots["times"][s])
            t = t.drop_columns(["_pk_rank"])
            t = t.append_column("sequence_id", pa.array(slots["base"][s] + number))
            t = t.append_column("offset", pa.array(slots["at"][s] + copy * size))
            yield from t.to_batches()

    packed = ranked.mapInArrow(run, schema)
    if not ids:
        return packed
    return packed.join(place.select(*ids, "ids"), ids).drop(*ids)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per training sequence: its ids and the start of each piece (needs ``ids``)."""
    one = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return one.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"),
                      F.col("p.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece."""
    return pack(tokenize(docs, tokenizer_path, id_col, text_col, capacity, keep_ids=keep_ids), capacity)
