"""Exact BM25 top-k search: an inverted index per shard, block-max pruning list by list, and an exact merge.

Indexing: a task turns the documents of its partition into shards of bounded size. A shard has a row per term with
its postings (documents' places and term frequencies) and one row for its documents (ids and rising lengths). A
list of more than one block also holds, for every block of ``BLOCK`` postings, its last document, its largest term
frequency and the length of its shortest document: whatever the corpus statistics, no posting of the block scores more
than these two together. The document frequency of a term, the number of documents and their mean length are sums
over all shards, so a score does not depend on the sharding.

Searching: postings of the terms asked for are gathered by unit, a few shards that one task searches one after the
other, and slice of the queries, a slice being a bounded number of queries, so that neither many documents nor many
queries make a task long, and queries are sent once per unit. A task's rows come in order, its queries and then shard by
shard, and it holds the lists of one shard at a time; what it frees goes back to the system. A query goes list by list, all documents of a shard at
once. Lists of up to a 24th of the shard's documents are added up whole. The commoner ones stand as rows of scores,
with a bound for every block of documents that comes from the bounds in the index; they follow in steps from the rarest
to the commonest. A document takes part in a step only if its score so far and its block's bounds of all remaining rows
reach the k-th score. Documents of a shard stand in order of length, which keeps the bounds of a block close. Each
unit returns its own k best; the best of these are exact. The shards take part in three rounds, each of about five
times as many as the round before; a round starts from the k-th score that the earlier ones found for a query, and a
shard from that of its unit's earlier ones, so that shards skip, and do not return, what can't be among the k best of
all. ``wand`` and ``wand_by_list`` search lists that are not scored yet (``Postings``); ``search`` does not call them,
as a walk in Python costs more than a scan of the shard.

Scores are multiples of 2**-32, the nearest to each posting's BM25 weight: sums are then exact in any order (below
2**53 units), and documents with the same words tie exactly, in whatever shards they are. Equal scores rank by id.

Terms are the words of the text, A-Z lower-cased. Null and empty texts have no terms and match nothing, but count as
documents. Rows without id are indexed and returned without id, after all others of equal score. Repeated rows are
separate documents. Empty tables, of documents or of queries, give no rows; other columns are not read.
"""

from __future__ import annotations

import ctypes
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, bounded_batches
from tidemark.llm.bpe import raw_texts

K1, B = 1.2, 0.75
#: Words and documents of a shard, postings of a block.
SHARD, DOCS, BLOCK = 6_000_000, 1 << 16, 64
#: Terms of a query for which ``wand``, document by document, is meant; queries of a slice.
FEW, SLICE = 16, 1 << 14
#: Looking a document up in a list costs as much as adding so many postings.
LOOKUP = 16
#: A list with more than this share of a shard's documents may become a row of scores; the rows hold so many numbers.
COMMON, ROWS = 24, 6_000_000
#: Words of the shards that one task searches; postings that are scored at a time.
UNION, STEP = 18_000_000, 1 << 18
UNIT = 2.0**32
NO_ID = 2**63 - 1
_BOUND = np.dtype([("last", "<u2"), ("tf", "<u4"), ("least", "<u4")])
_DOCS = np.dtype([("id", "<i8"), ("n", "<u4")])


class _Vocabulary(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


_SCHEMA = "shard bigint, term string, n bigint, total bigint, docs binary, tfs binary, bounds binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _give_back() -> None:
    """Return to the system what freed arrays leave in this worker; it lives on, and else keeps the most that a task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that are the stretches of an array between ``ends``."""
    offsets = ((ends - ends[0]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ends[0] : ends[-1]].tobytes())])


def _bounds(docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block bounds of all lists between ``ends``, and where each list's bounds end; none for lists of one block."""
    sizes = np.diff(ends)
    blocks = np.where(sizes > BLOCK, -(-sizes // BLOCK), 0)
    where = np.concatenate([[0], np.cumsum(blocks)])
    many = np.repeat(sizes > BLOCK, sizes)
    docs, tfs = docs[many], tfs[many]
    first = np.concatenate([[0], np.cumsum(sizes[blocks > 0])])
    own = np.repeat(np.arange(len(first) - 1), blocks[blocks > 0])
    starts = first[own] + BLOCK * (np.arange(len(own)) - np.concatenate([[0], np.cumsum(blocks[blocks > 0])])[own])
    out = np.empty(len(starts), _BOUND)
    if len(starts):
        out["last"] = docs[np.append(starts[1:], len(docs)) - 1]
        out["tf"], out["least"] = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs], starts)
    return out, where


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(shard, term, n, total, docs, tfs, bounds): a row per term of a shard, and one for its documents, whose term is null."""
    bounded_batches(docs.sparkSession)
    names = ["shard", "term", "n", "total", "docs", "tfs", "bounds"]

    def flush(shard: int, ids: list[int], sizes: list[int], terms: list[np.ndarray], tfs: list[np.ndarray], vocabulary: _Vocabulary) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))  # by length: blocks have close bounds
        doc = np.repeat(np.arange(len(order), dtype=np.uint16), [len(terms[i]) for i in order])
        tf = np.concatenate([tfs[i] for i in order])
        tfs.clear()
        docs = np.empty(len(order), _DOCS)
        docs["id"], docs["n"] = [ids[i] for i in order], [sizes[i] for i in order]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([shard], [None], [len(order)], [int(docs["n"].sum())], [docs.tobytes()], [None], [None]), _KINDS)], names)
        flat = np.concatenate([terms[i] for i in order])
        terms.clear()
        sizes, by_term = np.bincount(flat, minlength=len(vocabulary)), np.argsort(flat, kind="stable")
        del flat
        doc, tf = doc[by_term], tf[by_term]
        del by_term
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds, where = _bounds(doc, tf, docs["n"], ends)
        words = list(vocabulary)
        vocabulary.clear()
        for at in range(0, len(words), 20_000):
            to = min(at + 20_000, len(words))
            part = tf[ends[at] : ends[to]]
            small = part.astype(np.uint8 if part.max(initial=0) < 1 << 8 else np.uint16 if part.max() < 1 << 16 else np.uint32)
            size = pa.array(sizes[at:to])
            columns = [_blobs(doc, ends[at : to + 1]), _blobs(small, ends[at : to + 1] - ends[at]), _blobs(bounds, where[at : to + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, shard)), pa.array([w.decode("utf-8", "replace") for w in words[at:to]]), size, size, *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, words = TaskContext.get().partitionId() << 32, ([], [], [], [], _Vocabulary()), 0
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                own = raw.lower().split()
                count, vocabulary = Counter(own), held[4]
                row = (NO_ID if key is None else key, len(own), np.fromiter(map(vocabulary.__getitem__, count), np.int32, len(count)), np.fromiter(count.values(), np.uint32, len(count)))
                for to, x in zip(held, row):
                    to.append(x)
                words += len(own)
                if words >= SHARD or len(held[0]) == DOCS:
                    yield from flush(shard, *held)
                    shard, held, words = shard + 1, ([], [], [], [], _Vocabulary()), 0
                    _give_back()
        if held[0]:
            yield from flush(shard, *held)
        del held
        _give_back()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").alias("_text")).mapInArrow(run, _SCHEMA)


def words_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query, term): the distinct terms of each row's whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for query, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                terms = [t.decode("utf-8", "replace") for t in set(raw.lower().split())]
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["query", "term"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").alias("_text")).mapInArrow(run, "query bigint, term string").distinct()


def frequencies(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the terms asked for, over all shards."""
    wanted = terms.select("term").distinct().hint("merge")
    return indexed.where("term is not null").select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))


def idf(n: int, df: int) -> float:
    return float(np.log(1 + (n - df + 0.5) / (df + 0.5)))


def weigh(weight: float | np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """BM25 weights of postings in whole units."""
    return np.rint(weight * tf * (K1 + 1) / (tf + norm) * UNIT)


class Postings:
    """One term's list in a shard: bounds of its blocks at once, scores of a block when they are asked for."""

    def __init__(self, weight: float, docs: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, norm: np.ndarray, mean: float, stats: Counter | None = None) -> None:
        self.weight, self.docs, self.tfs, self.norm, self.stats = weight, docs, tfs, norm, stats
        self.n = len(docs)
        self.scores = np.empty(self.n)
        self.ready = np.zeros(max(1, len(bounds)), bool)
        if len(bounds):
            self.block_last = bounds["last"]
            self.block_most = weigh(weight, bounds["tf"].astype(np.float64), K1 * (1 - B + B * bounds["least"] / mean))
        else:  # a list of one block has no bounds but itself
            self.decode(np.zeros(1, np.int64))
            self.block_last, self.block_most = docs[-1:], np.array([self.scores.max()])
        self.most = float(self.block_most.max())
        self.whole: np.ndarray | None = None

    def _score(self, at: slice) -> None:
        tf = self.tfs[at].astype(np.float64)
        self.scores[at] = weigh(self.weight, tf, self.norm[self.docs[at]])
        if self.stats is not None:
            self.stats["scored"] += len(tf)

    def decode(self, blocks: np.ndarray) -> None:
        """Score the postings of these blocks, unless that has been done."""
        for b in blocks[~self.ready[blocks]].tolist():
            self._score(slice(b * BLOCK, min((b + 1) * BLOCK, self.n)))
            self.ready[b] = True

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all postings."""
        if self.whole is None:
            if not self.ready.any():
                self._score(slice(None))
                self.ready[:] = True
            self.decode(np.flatnonzero(~self.ready))
            self.whole = self.docs.astype(np.intp)
        return self.whole, self.scores


class Cursor:
    """A place in a list."""

    def __init__(self, p: Postings) -> None:
        self.p, self.at, self.doc, self.most = p, 0, int(p.docs[0]), p.most

    def go(self, doc: int) -> None:
        """To the first posting at ``doc`` or beyond; blocks in between stay undecoded."""
        if doc > self.doc:
            block = max(self.at // BLOCK, int(np.searchsorted(self.p.block_last, doc)))
            lo = max(self.at, block * BLOCK)
            self.at = lo + int(np.searchsorted(self.p.docs[lo : (block + 1) * BLOCK], doc))
            self.doc = int(self.p.docs[self.at]) if self.at < self.p.n else NO_ID

    def score(self) -> float:
        self.p.decode(np.array([self.at // BLOCK]))
        return float(self.p.scores[self.at])

    def block(self, doc: int) -> int:
        return int(np.searchsorted(self.p.block_last, doc))


def wand(lists: list[Postings], k: int, stats: Counter | None = None, floor: float = 0.0) -> list[tuple[float, int]]:
    """The k best (score, document) that score at least ``floor``, best first; equal scores by document.

    Scores are in units. Block-max WAND, document by document.
    """
    heap: list[tuple[float, int]] = []
    least = 0.0
    cursors = [Cursor(p) for p in lists]
    live = cursors
    while True:
        live = sorted((c for c in live if c.doc != NO_ID), key=lambda c: c.doc)
        bound, pivot = 0.0, None
        for i, c in enumerate(live):
            bound += c.most
            if bound >= floor and (bound > least or len(heap) < k):
                pivot = i
                break
        if pivot is None:
            break
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        head = live[: pivot + 1]
        blocks = [c.block(doc) for c in head]
        ceiling = sum(float(c.p.block_most[b]) for c, b in zip(head, blocks) if b < len(c.p.block_most))
        if ceiling < floor or len(heap) == k and ceiling <= least:
            # no document up to the end of the nearest block can do it
            ends = [int(c.p.block_last[b]) + 1 for c, b in zip(head, blocks) if b < len(c.p.block_last)]
            nxt = min([*ends, *([live[pivot + 1].doc] if pivot + 1 < len(live) else [])], default=NO_ID)
            for c in head:
                c.go(max(nxt, doc + 1))
            continue
        if head[0].doc == doc:
            score = 0.0
            for c in head:
                score += c.score()
                c.go(doc + 1)
            if stats is not None:
                stats["documents"] += 1
            # documents come in rising order, so an equal score does not displace an earlier one
            if score < floor:
                continue
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            elif score > heap[0][0]:
                heapq.heapreplace(heap, (score, -doc))
            least = heap[0][0] if len(heap) == k else 0.0
        else:
            for c in head:
                if c.doc < doc:
                    c.go(doc)
    return [(s, -d) for s, d in sorted(heap, key=lambda x: (-x[0], -x[1]))]


def wand_by_list(lists: list[Postings], total: np.ndarray, k: int, floor: float = 0.0) -> list[tuple[float, int]]:
    """As ``wand``, list by list for all documents at once, on top of ``total``, what other lists have given each document."""
    n, size = len(total), len(lists)
    rest = np.append(np.cumsum([p.most for p in reversed(lists)])[::-1], 0.0)  # rest[i]: maxima of the lists from i on

    def add(lo: int, hi: int) -> None:
        if hi > lo:
            docs, scores = zip(*[p.all() for p in lists[lo:hi]])
            np.add(total, np.bincount(np.concatenate(docs), np.concatenate(scores), n), out=total)

    def kth(scores: np.ndarray) -> float:
        return float(np.partition(scores, -k)[-k]) if k < len(scores) else 0.0

    least, at = floor, 0
    if not floor:  # no shard has given a score to begin with: most of the lists do
        at = size * 3 // 4
        add(0, at)
        least = kth(total)
    # up to here a document that no list has had could still win
    stop = max(at, size - int(np.searchsorted(rest[::-1], least)) + 1) if least else size
    stop = min(stop, size)
    add(at, stop)
    at, step = stop, max(4, (size - stop) // 8)
    while at < size:
        seen = np.flatnonzero(total + rest[at] >= least)
        if len(seen) * LOOKUP <= lists[at].n:
            break
        add(at, min(at + step, size))
        at = min(at + step, size)
    if at < size:
        own = total[seen]
        for i in range(at, size):
            p = lists[i]
            block = np.minimum(np.searchsorted(p.block_last, seen), len(p.block_last) - 1)
            fine = own + p.block_most[block] + rest[i + 1] >= least
            seen, own = seen[fine], own[fine]
            if not len(seen):
                break
            place = np.minimum(np.searchsorted(p.docs, seen), p.n - 1)
            hit = np.flatnonzero(p.docs[place] == seen)
            p.decode(np.unique(place[hit] // BLOCK))
            own[hit] += p.scores[place[hit]]
    else:
        seen = np.flatnonzero(total)
        own = total[seen]
    least = max(floor, kth(own))
    fine = (own >= least) & (own > 0)
    seen, own = seen[fine], own[fine]
    best = np.lexsort((seen, -own))[:k]
    return list(zip(own[best].tolist(), seen[best].tolist()))


def by_rows(rows: np.ndarray, most: np.ndarray, at: np.ndarray, total: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that score at least the k-th best score and ``floor``, from ``total`` and the rows ``at``.

    ``rows`` hold the scores of all documents in lists, ``most`` their maxima by blocks of ``BLOCK`` documents, and
    ``total``, of whole blocks, what other lists have given each document.
    """
    least, size = floor, len(total)
    if not floor:  # no shard has given a score to begin with: the best ones so far give a score that k documents reach
        few = np.argpartition(total, -4 * k)[-4 * k :] if 4 * k < size else np.arange(size)
        if k <= len(few):
            least = float(np.partition(total[few] + rows[at[:, None], few].sum(0), -k)[-k])
    cuts = np.arange(0, len(at), max(4, -(-len(at) // 5)))[:4]
    rest = np.zeros((len(cuts) + 1, most.shape[1]))  # rest[i]: the block's maxima from the i-th cut on
    rest[:-1] = np.cumsum(np.add.reduceat(most[at], cuts, axis=0)[::-1], axis=0)[::-1]
    seen = np.flatnonzero(total.reshape(-1, BLOCK) >= (least - rest[0])[:, None])
    own, whole = total[seen], True
    for i, lo in enumerate(cuts.tolist()):
        part = at[lo : cuts[i + 1] if i + 1 < len(cuts) else None]
        if whole and len(seen) * 4 > size:
            for r in part.tolist():
                total += rows[r]
            own = total[seen]
        else:
            whole = False
            own = own + rows.ravel().take(part[:, None] * size + seen).sum(0)
        fine = own >= least - rest[i + 1][seen // BLOCK]
        seen, own = seen[fine], own[fine]
    if k < len(own):
        least = max(least, float(np.partition(own, -k)[-k]))
    fine = (own >= least) & (own > 0)
    return seen[fine], own[fine]


class Shard:
    """The lists of a shard that some query asks for, by term number."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, df: np.ndarray, columns: list[pa.Array], n: int, mean: float, stats: Counter | None = None) -> None:
        """``columns``: docs, tfs and bounds of each term as binary arrays; ``terms`` rise."""
        self.ids, self.mean, self.stats = docs["id"], mean, stats
        self.norm = K1 * (1 - B + B * docs["n"] / mean)
        self.terms, self.weight = terms, np.log(1 + (n - df + 0.5) / (df + 0.5))
        (self.docs, ends), (self.tfs, tf_ends), (self.bounds, bound_ends) = map(_flat, columns)
        self.docs, self.bounds = self.docs.view("<u2"), self.bounds.view(_BOUND)
        self.ends, self.tf_ends, self.bound_ends = ends // 2, tf_ends, bound_ends // _BOUND.itemsize
        self.n = np.diff(self.ends)
        self.big = np.diff(self.bound_ends) > 0
        self.size = -(-len(docs) // BLOCK) * BLOCK
        common = np.flatnonzero(self.big & (self.n * COMMON > len(docs)))
        common = common[np.argsort(-self.n[common], kind="stable")][: ROWS // max(self.size, 1)]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))  # row 0 is the commonest
        self.rows = np.zeros((len(common), self.size))
        self.flat_ends = np.zeros(len(terms) + 1, np.int64)
        np.cumsum(np.where(self.row < 0, self.n, 0), out=self.flat_ends[1:])
        self.flat = np.empty(self.flat_ends[-1], np.int64)  # score and document in one number, so that they are gathered at once
        width = np.where(self.n > 0, np.diff(tf_ends) // np.maximum(self.n, 1), 1)
        lo = 0
        while lo < len(terms):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.ends[lo] + STEP, "right")) - 1)
            owner = np.repeat(np.arange(lo, hi), self.n[lo:hi])
            doc, wide = self.docs[self.ends[lo] : self.ends[hi]].astype(np.intp), width[owner]
            first = self.tf_ends[owner] + (np.arange(self.ends[lo], self.ends[hi]) - self.ends[owner]) * wide
            tf = np.zeros(len(doc))
            for i in range(int(wide.max(initial=0))):
                inside = wide > i
                tf[inside] += self.tfs[first[inside] + i] * float(256**i)
            scores, row = weigh(self.weight[owner], tf, self.norm[doc]), self.row[owner]
            self.rows[row[row >= 0], doc[row >= 0]] = scores[row >= 0]
            self.flat[self.flat_ends[lo] : self.flat_ends[hi]] = scores[row < 0].astype(np.int64) << 16 | doc[row < 0]
            lo = hi
        self.most = self._most(common)
        if stats is not None:
            stats["scored"] += int(self.n.sum())

    def _most(self, lists: np.ndarray) -> np.ndarray:
        """Bounds of these lists for each block of documents: those of the blocks of postings that reach into it."""
        out = np.zeros((len(lists), self.size // BLOCK))
        blocks = np.diff(self.bound_ends)[lists]
        at = _ranges(self.bound_ends[lists], blocks)
        owner, last = np.repeat(lists, blocks), self.bounds["last"][at].astype(np.int64)
        bound = weigh(self.weight[owner], self.bounds["tf"][at].astype(np.float64), K1 * (1 - B + B * self.bounds["least"][at] / self.mean))
        begin = np.append(0, last[:-1] + 1)
        begin[np.cumsum(blocks) - blocks] = 0
        begin //= BLOCK
        reach = last // BLOCK - begin + 1
        np.maximum.at(out, (np.repeat(self.row[owner], reach), _ranges(begin, reach)), np.repeat(bound, reach))
        return out

    def best(self, terms: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, place) of this shard's documents for a query's terms."""
        return self.best_at(self.find(terms), k, floor)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.searchsorted(self.terms, terms)
        return np.where(self.terms[np.minimum(at, len(self.terms) - 1)] == terms, at, -1)

    def best_at(self, at: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """As ``best``, for the numbers of lists; -1 is none."""
        at = at[at >= 0]
        if not len(at):
            return []
        rows = self.row[at]
        flat, rows = at[rows < 0], np.sort(rows[rows >= 0])[::-1]
        big = self.big[flat]
        own = _ranges(self.flat_ends[flat[~big]], self.n[flat[~big]])
        spans = [slice(*x) for x in zip(self.flat_ends[flat[big]].tolist(), self.flat_ends[flat[big] + 1].tolist())]
        got = np.concatenate([self.flat[own], *map(self.flat.__getitem__, spans)])
        total = np.bincount(got & 0xFFFF, got >> 16, self.size).astype(np.float64, copy=False)  # of nothing it is whole numbers
        if len(rows):
            seen, own = by_rows(self.rows, self.most, rows, total, k, floor)
        else:
            least = max(floor, float(np.partition(total, -k)[-k]) if k < self.size else 0.0)
            seen = np.flatnonzero((total >= least) & (total > 0))
            own = total[seen]
        best = np.lexsort((self.ids[seen], -own))[:k]
        return list(zip(own[best].tolist(), seen[best].tolist()))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, null as empty, and where each value ends (0 first)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def unite(shards: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """(shard, unit, turn) for ``shards`` (shard, words) in an order by chance, and the units of each of three turns.

    The first turn has a shard in 25, the second another four; a unit is what one task searches.
    """
    ends = [-(-len(shards) // 25), -(-len(shards) // 5), len(shards)]
    of, unions, unit = [], [], -1
    for turn, (lo, hi) in enumerate(zip([0, *ends], ends)):
        unions.append([])
        for i, (shard, words) in enumerate(shards[lo:hi]):
            if not i or held + words > UNION:
                unit, held = unit + 1, 0
                unions[turn].append(unit)
            held += words
            of.append((shard, unit, turn))
    return of, unions


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[pa.RecordBatch]]]:
    """(unit, slice, shard) and its rows, of batches in that order; shard is -1 where it is null. The caller may empty the list."""
    key, held = None, []
    for b in batches:
        keys = np.stack([np.asarray(b.column(c).fill_null(-1)) for c in ("unit", "slice", "shard")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                now = tuple(keys[:, lo].tolist())
                if now != key and held:
                    yield key, held
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
    if held:
        yield key, held


class Asked:
    """The queries of a slice and the best found for them so far; ``rows`` (query, terms, floor) as one table."""

    def __init__(self, rows: pa.Table, k: int) -> None:
        self.queries, self.k = rows.column("query").to_pylist(), k
        self.floors = [x * UNIT for x in rows.column("floor").to_pylist()]
        terms = rows.column("terms").combine_chunks()
        self.flat, self.ends = np.asarray(terms.flatten()), np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(False))])
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.queries]

    def search(self, shard: Shard) -> None:
        for lo in range(0, len(self.queries), 512):  # the lists' numbers take as much memory as the terms
            ends = self.ends[lo : lo + 513]
            at, ends = shard.find(self.flat[ends[0] : ends[-1]]), (ends - ends[0]).tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:]), lo):
                found = shard.best_at(at[a:b], self.k, self.floors[i])
                if found:
                    best = self.best[i] = sorted([*self.best[i], *((-score, int(shard.ids[doc])) for score, doc in found)])[: self.k]
                    if len(best) == self.k:
                        self.floors[i] = max(self.floors[i], -best[-1][0])

    def results(self) -> pa.RecordBatch:
        out = [(query, doc, -score / UNIT) for query, found in zip(self.queries, self.best) for score, doc in found]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query", "id", "score"])


def search_sorted(batches: Iterator[pa.RecordBatch], n: int, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """(query, id, score) for rows by unit, slice, shard and t: a slice's queries, whose shard is null, then shard by shard its
    documents, whose t is null, and its lists. One shard is held at a time, however many a unit has."""
    group, asked = None, None
    for (unit, cut, own), rows in stretches(batches):
        if (unit, cut) != group:
            if asked:
                yield asked.results()
            group, asked = (unit, cut), None
        part = pa.Table.from_batches(rows)
        rows.clear()
        if own < 0:
            asked = Asked(part.select(["query", "terms", "floor"]), k)
        elif asked:
            part = part.select(["t", "df", "docs", "tfs", "bounds"])
            docs, part = np.frombuffer(part.column("docs")[0].as_py(), _DOCS), part.slice(1)
            t, df, *columns = (part.column(c).combine_chunks() for c in part.column_names)
            del part
            shard = Shard(docs, np.asarray(t), np.asarray(df), columns, n, mean)
            del t, df, columns
            asked.search(shard)
            del shard, docs
            _give_back()
    if asked:
        yield asked.results()
    del asked
    _give_back()


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Whole numbers as a table, by Arrow: a list would start further Python workers on the executors."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names))


def search(indexed: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, score) for ``queries(query, term, df)``; ``indexed`` is a stored result of ``index``."""
    n, total = indexed.where("term is null").agg(F.sum("n"), F.sum("total")).first()
    n, mean = n or 0, max((total or 0) / max(n or 0, 1), 1e-9)
    spark = indexed.sparkSession
    scratch = Scratch(spark)
    slices = queries.select("query").distinct().count() // SLICE + 1
    cut = F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int").alias("slice")
    # sort-merge joins at every size: the terms asked for grow with the input and have no bound to broadcast by.
    # Terms go by numbers
    terms = scratch.keep(queries.groupBy("term").agg(F.max("df").alias("df")).select("term", "df", F.monotonically_increasing_id().alias("t")), "terms")
    numbered = scratch.keep(queries.select("query", "term", cut).join(terms.hint("merge"), "term").select("query", "slice", "term", "t", "df"), "numbered")
    of, unions = unite(indexed.where("term is null").select("shard", "total").orderBy(F.xxhash64("shard")).collect())  # a row per shard
    of = F.broadcast(_rows(spark, of, ["shard", "unit", "turn"]))
    parts = ["docs", "tfs", "bounds"]
    wanted = numbered.select("slice", "term", "t", "df").distinct()
    lists = indexed.where("term is not null").join(wanted.hint("merge"), "term").select("shard", "slice", "t", "df", *parts)
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    heads = indexed.where("term is null").select("shard", every, F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("df"), *parts)
    used = scratch.keep(lists.unionByName(heads).join(of, "shard"), "lists")
    asked = numbered.groupBy("query", "slice").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    asked = scratch.keep(asked, "asked")  # as many terms as a query has

    schema = "query bigint, id bigint, score double"
    ranks = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).alias("rank")
    best = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (("query", "long"), ("id", "long"), ("score", "double"), ("rank", "int"))))
    for turn in range(3):
        now = F.broadcast(_rows(spark, [(u,) for u in unions[turn]], ["unit"]))
        floor = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        right = asked.join(floor, "query", "left").crossJoin(now).select("unit", "slice", "query", "terms", F.coalesce("floor", F.lit(0.0)).alias("floor"))
        left = used.where(F.col("turn") == turn).drop("turn")
        rows = left.unionByName(right, allowMissingColumns=True).repartition("unit", "slice").sortWithinPartitions("unit", "slice", "shard", "t")
        found = rows.mapInArrow(lambda batches: search_sorted(batches, n, mean, k), schema)
        best = scratch.keep(best.drop("rank").unionByName(found).select("query", "id", "score", ranks).where(F.col("rank") <= k), "best")
    return best.select("query", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "score")


def more_like_these(docs: DataFrame, queries: DataFrame, k: int = 10, terms: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query, rank, id, score): for each row of ``queries`` the documents that match the words of its whole text best.

    With ``terms``, only so many words of a query count: those of the smallest document frequency, but of two documents
    at least; equal frequencies by term. The query itself, if among the documents, is a result like any other.
    """
    scratch = Scratch(docs.sparkSession)
    indexed = scratch.keep(index(docs, text, key), "index")
    words = scratch.keep(words_of(queries, text, key), "words")
    chosen = words.join(frequencies(indexed, words), "term")
    if terms is not None:
        rare = Window.partitionBy("query").orderBy("df", "term")
        chosen = chosen.where("df >= 2").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= terms)
    return search(indexed, scratch.keep(chosen.select("query", "term", "df"), "chosen"), k)
