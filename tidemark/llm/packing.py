"""Hierarchical multi-length packing.

Every document is encoded, ended by an end-of-text id, and routed: whole longest windows are cut off it, the rest
goes to the shortest context-size tier that holds it. Tiers are packed from the longest down; the gap behind a
document is filled best-fit from the same and the shorter tiers, and what then is still open is closed by cutting one
more document. Sequences of a tier are dealt into step groups of equal tokens, costly ones (sum of squared piece
lengths) in turn from either end, so that the groups of a tier take about the same time.

Each task packs the documents of its own partition, a bounded buffer at a time; no shuffle is needed. What remains of
the last buffer of a task is cut into windows of powers of two, which need no padding.

Null texts are empty: one piece with the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches
from tidemark.llm.bpe import codec, default_vocabulary, raw_texts

TIERS = (256, 512, 1024, 2048)
#: Tokens a task holds before it packs them, and the tokens of a step group.
BUFFER_TOKENS, STEP_TOKENS = 1 << 21, 1 << 15

Piece = tuple[int, int, int]  # document's place in the buffer, start, length


def pack_lengths(lengths: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (tier, pieces) made of ``(document, start, length)`` runs, and the runs left over (none if ``last``).

    Every window but the tail's is full. The tail of the last buffer becomes windows of powers of two.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start)
    for doc, start, n in lengths:
        while n >= top:
            windows.append((top, [(doc, start, top)]))
            start, n = start + top, n - top
        if n:
            pool.append((n, doc, start))
    pool.sort()
    left = sum(x[0] for x in pool)

    def fill(size: int) -> list[Piece]:
        """A full window: the longest run of the pool that fits, again and again; then one is cut."""
        gap, pieces = size, []
        while gap:
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                n, doc, start = pool.pop(at)
            else:
                n, doc, start = pool.pop(0)
                insort(pool, (n - gap, doc, start + gap))
                n = gap
            pieces.append((doc, start, n))
            gap -= n
        return pieces

    for i in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[i], tiers[i - 1] if i else 0
        if not last and pool and pool[-1][0] > tier:
            break  # too little is left for a longer window: it waits for the next buffer
        # a window of this tier is opened by a document that was routed to it
        while left >= tier and pool and pool[-1][0] > below:
            windows.append((tier, fill(tier)))
            left -= tier
    if not last:
        return windows, [(doc, start, n) for n, doc, start in pool]
    size = top
    while left:
        while size > left:
            size //= 2
        windows.append((size, fill(size)))
        left -= size
    return windows, []


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """The step group of each window, numbered from 0: groups are of one tier and hold ``step_tokens`` at most."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = sorted((i for i, (t, _) in enumerate(windows) if t == tier), key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
        groups = -(-len(own) * tier // step_tokens)
        for k, i in enumerate(own):
            lap, at = divmod(k, groups)
            out[i] = first + (at if lap % 2 == 0 else groups - 1 - at)
        first += groups
    return out


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row per piece: key, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids (little-endian 32 bit)."""
    path = path or default_vocabulary()
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")
    bounded_batches(docs.sparkSession)
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        part = TaskContext.get().partitionId()
        sequence = group = part << 36
        keys: list = []
        ids: list[np.ndarray] = []
        runs: list[Piece] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, keys, ids, runs, held
            windows, rest = pack_lengths(runs, tiers, last)
            steps = step_groups(windows, step_tokens)
            rows: list[tuple] = []
            for (tier, pieces), step in zip(windows, steps):
                offset = 0
                for d, s, n in pieces:
                    rows.append((keys[d], s, n, len(ids[d]), sequence, offset, tier, group + step, ids[d][s : s + n].astype("<u4").tobytes()))
                    offset += n
                sequence += 1
            group += max(steps, default=-1) + 1
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [kind, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()])], names)
            kept = sorted({d for d, _, _ in rest})
            place = {d: i for i, d in enumerate(kept)}
            keys, ids = [keys[d] for d in kept], [ids[d] for d in kept]
            runs = [(place[d], s, n) for d, s, n in rest]
            held = sum(n for _, _, n in runs)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for k, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                a = np.append(c.whole(raw), np.uint32(end_id))
                runs.append((len(keys), 0, len(a)))
                keys.append(k)
                ids.append(a)
                held += len(a)
                if held >= buffer_tokens:
                    yield from flush(False)
        yield from flush(True)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint, ids binary"
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
