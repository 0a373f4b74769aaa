"""Substring deduplication: repeated token windows, found by Rabin-Karp hashes and merged into removal intervals.

Every window of ``size`` consecutive words has a rolling (polynomial) hash over its bytes, words joined by one space.
A task hashes the windows of its documents in runs; of the windows that repeat within a run it keeps the first and
marks the others. The first ones are dealt by hash into buckets, packed as arrays, and counted there: of the windows
with one hash all but the first by (id, start) are marked. No hash has more than one row per run in a bucket, so a
passage that a third of all documents share makes no hot key. The marks are dealt by document, merged into maximal
intervals of words, and joined to the documents.

A window is first if no window with the same words starts at a smaller id, or in the same document at a smaller word.
Nulls are empty texts: no words, nothing removed. Texts shorter than a window lose nothing. Rows with equal ids
are compared by start alone, so equal rows keep their words. Rows without id come after all others.
"""

from __future__ import annotations

import functools

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bounded_batches
from tidemark.llm.bpe import raw_texts

WINDOW = 20
#: Windows of a run, words hashed at once, and windows that a bucket should have.
RUN, SLICE, BUCKET = 2_000_000, 150_000, 1_500_000
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(20)
    base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5  # odd: it has an inverse modulo 2**64
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1), base % (1 << 64), pow(base, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 20), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def window_hashes(words: list[bytes], size: int = WINDOW) -> np.ndarray:
    """The hash of each window of ``words``, in order: sum of table[byte] * base**place, brought to place 0 and mixed."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    table, base, inverse = _constants()
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(base, len(data)), out=total[1:])
    h = (total[ends[size - 1 :]] - total[starts]) * _power(inverse, len(data))[starts]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    return h ^ (h >> _U(33))


def later(h: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the windows whose hash also occurs at a smaller (key, start)."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    if not len(at):
        return at
    at = at[np.lexsort((start[at], key[at], h[at]))]
    first = np.ones(len(at), bool)
    first[1:] = h[at[1:]] != h[at[:-1]]
    lead = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return at[(key[at] != key[lead]) | (start[at] != start[lead])]


def _small(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _back(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _by_doc(at: np.ndarray, doc: np.ndarray, start: np.ndarray, keys: np.ndarray, sums: np.ndarray, groups: int) -> Iterator[tuple[int, dict]]:
    """Marked windows, packed by group of documents."""
    if not len(at):
        return
    at = at[np.lexsort((start[at], doc[at]))]
    own = ((keys[doc[at]].astype(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(groups)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    for part, g in zip(np.split(at, np.flatnonzero(np.diff(own)) + 1), np.unique(own).tolist()):
        d = doc[part]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        yield g, {"a": _small(keys[d[edge]]), "b": _small(sums[d[edge]]), "c": _small(np.diff(np.append(edge, len(d))).astype(np.uint32)), "d": _small(_deltas(start[part].astype(np.int64)).astype(np.int32))}


_SCHEMA = "marks boolean, part int, a binary, b binary, c binary, d binary, e binary"
_ARROW = pa.schema([("marks", pa.bool_()), ("part", pa.int32()), *((x, pa.binary()) for x in "abcde")])


def _batch(rows: list[tuple[bool, int, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[2].get(x) for r in rows], pa.binary()) for x in "abcde")], schema=_ARROW)


class _Run:
    """Windows of some documents; emptied at RUN windows."""

    def __init__(self, size: int, buckets: int) -> None:
        self.size, self.buckets = size, buckets
        self.clear()

    def clear(self) -> None:
        self.keys: list[int] = []
        self.sums: list[int] = []
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: list[tuple[int, int, list[bytes], int]]) -> None:
        """Hash (key, checksum, words, first word's place) in one go."""
        words = [w for _, _, ws, _ in docs for w in ws]
        h = window_hashes(words, self.size)
        at = 0
        for key, checksum, ws, first in docs:
            n = len(ws) - self.size + 1
            if n > 0:
                self.docs.append(np.full(n, len(self.keys), np.int32))
                self.starts.append(np.arange(first, first + n, dtype=np.uint32))
                self.hashes.append(h[at : at + n])
                self.keys.append(key)
                self.sums.append(checksum)
                self.n += n
            at += len(ws)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, sums = np.array(self.keys, np.int64), np.array(self.sums, np.uint32)
        doc, start, h = np.concatenate(self.docs), np.concatenate(self.starts), np.concatenate(self.hashes)
        self.clear()
        gone = later(h, keys[doc], start)
        yield from self._out([(True, g, x) for g, x in _by_doc(gone, doc, start, keys, sums, self.buckets)])
        keep = np.ones(len(h), bool)
        keep[gone] = False
        doc, start, h = doc[keep], start[keep], h[keep]
        bucket = ((h >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.uint16 if self.buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = []
        for b in range(self.buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                d = doc[at]
                edge = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
                low = np.ascontiguousarray(h[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
                rows.append((False, b, {"a": _small(_deltas(keys[d[edge]])), "b": _small(sums[d[edge]]), "c": _small(np.diff(np.append(edge, len(d))).astype(np.uint32)), "d": _small(_deltas(start[at].astype(np.int64)).astype(np.int32)), "e": low}))
                if len(rows) == 16:
                    yield from self._out(rows)
                    rows = []
        yield from self._out(rows)

    @staticmethod
    def _out(rows: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 16):
            yield _batch(rows[at : at + 16])


def repeated_windows(docs: DataFrame, size: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(_key, _sum, spans array<struct<start, stop>>) of ``docs(_key, _sum, _text)``: maximal intervals of words to remove."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 6 // BUCKET + 1)

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, words = _Run(size, buckets), [], 0
        for b in batches:
            for key, checksum, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2))):
                ws = raw.split()
                if len(ws) < size:
                    continue
                if len(ws) > SLICE:
                    for at in range(0, len(ws) - size + 1, SLICE):
                        run.add([(key, checksum, ws[at : at + SLICE + size - 1], at)])
                        if run.n >= RUN:
                            yield from run.flush()
                    continue
                held.append((key, checksum, ws, 0))
                words += len(ws)
                if words >= SLICE:
                    run.add(held)
                    held, words = [], 0
                    if run.n >= RUN:
                        yield from run.flush()
        run.add(held)
        yield from run.flush()

    def count(table: pa.Table) -> pa.Table:
        """A bucket's windows: marks for all but the first of each hash. Marks pass through."""
        out, keys, sums, doc, start, h = [], [], [], [], [], []
        n = 0
        for r in table.to_pylist():
            if r["marks"]:
                out.append((True, r["part"], r))
                continue
            k, c = np.cumsum(_back(r["a"], "<i8")), _back(r["c"], "<u4")
            keys.append(k)
            sums.append(_back(r["b"], "<u4"))
            doc.append(np.repeat(np.arange(n, n + len(k)), c))
            start.append(np.cumsum(_back(r["d"], "<i4").astype(np.int64)).astype(np.uint32))
            low = np.zeros((len(start[-1]), 8), np.uint8)
            low[:, :7] = np.frombuffer(r["e"], np.uint8).reshape(-1, 7)
            h.append(low.view("<u8")[:, 0])
            n += len(k)
        if keys:
            key, d, s = np.concatenate(keys), np.concatenate(doc), np.concatenate(start)
            out += [(True, g, x) for g, x in _by_doc(later(np.concatenate(h), key[d], s), d, s, key, np.concatenate(sums), buckets)]
        return pa.Table.from_batches([_batch(out)])

    def merge(table: pa.Table) -> pa.Table:
        """Marks of a group of documents: intervals."""
        keys, sums, doc, start, n = [], [], [], [], 0
        for r in table.to_pylist():
            keys.append(_back(r["a"], "<i8"))
            sums.append(_back(r["b"], "<u4"))
            c = _back(r["c"], "<u4")
            doc.append(np.repeat(np.arange(n, n + len(c)), c))
            start.append(np.cumsum(_back(r["d"], "<i4").astype(np.int64)))
            n += len(c)
        key, total = np.concatenate(keys), np.concatenate(sums)
        d, s = np.concatenate(doc), np.concatenate(start)
        order = np.lexsort((s, total[d], key[d]))
        key, total, s = key[d[order]], total[d[order]], s[order]
        new = np.ones(len(s), bool)
        new[1:] = (key[1:] != key[:-1]) | (total[1:] != total[:-1])
        fresh = new.copy()
        fresh[1:] |= s[1:] > s[:-1] + size  # intervals that touch are one
        lo = np.flatnonzero(fresh)
        stop = s[np.append(lo[1:], len(s)) - 1] + size
        per = np.flatnonzero(new[lo])
        spans = pa.ListArray.from_arrays(pa.array(np.append(per, len(lo)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s[lo]), pa.array(stop)], ["start", "stop"]))
        return pa.table([pa.array(key[lo[per]]), pa.array(total[lo[per]].astype(np.int64)), spans], ["_key", "_sum", "spans"])

    dealt = docs.select("_key", "_sum", "_text").mapInArrow(hash_runs, _SCHEMA)
    marks = dealt.groupBy("part").applyInArrow(count, _SCHEMA)
    return marks.groupBy("part").applyInArrow(merge, "_key bigint, _sum bigint, spans array<struct<start: bigint, stop: bigint>>")


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept, n_words, n_removed = [], [], []
    for raw, own in zip(raw_texts(text), spans.to_pylist()):
        words = raw.split()
        n_words.append(len(words))
        if own:
            left, at = [], 0
            for s in own:
                left += words[at : s["start"]]
                at = s["stop"]
            words = left + words[at:]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


def with_cut(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """``docs`` with columns __spans and __cut(n_words, n_removed, kept); the rows carry their other columns along."""
    # an empty text for null, so that neither part of the join's key is ever null
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order, total = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), F.crc32(whole.cast("binary"))
    spans = repeated_windows(docs.select(order.alias("_key"), total.alias("_sum"), whole.alias("_text")), size)
    spans = spans.toDF("__key", "__sum", "__spans")
    both = docs.withColumns({"__key": order, "__sum": total}).join(spans, ["__key", "__sum"], "left")
    return both.withColumn("__cut", F.arrow_udf(_cut, _CUT)(whole, F.col("__spans")))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, spans, kept) per row of ``docs``; kept: the words left, joined by one space."""
    out = with_cut(docs.select(key, text), text, key, size)
    return out.select(key, "__cut.n_words", "__cut.n_removed", F.col("__spans").alias("spans"), "__cut.kept")
