"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts every document, however short, into chunks whose borders depend on content alone, so
documents that share passages share chunks; a chunk is encoded once per worker and its ids are reused. A chunk's first
and last words may have been cut or may merge with the neighbour, so joins are repaired: the text around a join is
encoded again as one string, from a *certain* border in the left chunk to one in the right chunk. A border is certain
where a space follows a character that is not white space: no pre-token crosses it and none looks past it. The string
takes in one stretch between such borders more on either side than the join needs, and its ids there must be exactly
those of the chunks; where they are not, it grows by a stretch on each side until its outermost ones agree. A document whose joins
never agree is encoded as one string. Chunks without a certain border become part of the join around them.

Sharing is per Python worker (a bounded memo), not cluster-wide: sharing across workers would shuffle every chunk's
text twice, which costs more than encoding it.

Nulls are empty texts; an empty text has no ids. Rows keep their id columns as they are, repeated rows included.
"""

from __future__ import annotations

import functools
import json

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches

#: Mean bytes of a chunk, as a power of two, and the most one may have.
CHUNK_BITS, CHUNK_MOST = 10, 1 << 16
#: Chunks and joins a worker remembers.
MEMO = 16_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Disagreement(Exception):
    """The joins of a text do not agree with its chunks, as in a text that is no valid UTF-8."""


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE vocabulary without normaliser or prefix space is needed")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids do not follow the order of the merges")
        self.names = set(special)
        self._pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.path, self.special = path, special
        for s in special:
            ranks.pop(s.encode(), None)
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = b
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.chunks: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.joins: dict[bytes, np.ndarray] = {}
        rng = np.random.default_rng(1)
        self.gear = rng.integers(0, 1 << 32, 256, dtype=np.uint32)

    @functools.cached_property
    def fast(self):
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        return tiktoken.Encoding("vocabulary", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens=self.special)

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def whole(self, raw: bytes) -> np.ndarray:
        """Ids of one string, encoded in one go."""
        text = raw.decode("utf-8", "replace")
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.names, disallowed_special=())
        except BaseException as e:  # the regex engine's panic on very long runs is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Chunk borders: where the hash of the last 32 bytes has CHUNK_BITS zero bits, moved to a character's start."""
        h = self.gear[data]
        for step in (1, 2, 4, 8, 16):
            moved = np.zeros_like(h)
            moved[step:] = h[:-step] << np.uint32(step)
            h = h + moved
        cuts = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
        for _ in range(3):
            inside = (cuts < len(data)) & ((data[np.minimum(cuts, len(data) - 1)] & 0xC0) == 0x80)
            cuts = cuts + inside
        cuts = np.unique(cuts[cuts < len(data)])
        if len(data) > CHUNK_MOST:
            edge = np.concatenate([[0], cuts, [len(data)]])
            wide = np.flatnonzero(np.diff(edge) > CHUNK_MOST)
            more = [np.arange(edge[i] + CHUNK_MOST, edge[i + 1], CHUNK_MOST) for i in wide]
            extra = np.concatenate(more) if more else np.zeros(0, np.int64)
            for _ in range(3):
                extra = extra + ((extra < len(data)) & ((data[np.minimum(extra, len(data) - 1)] & 0xC0) == 0x80))
            cuts = np.unique(np.concatenate([cuts, extra[extra < len(data)]]))
        return cuts

    def _ids(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's ids and where in it each of them ends."""
        got = self.chunks.get(chunk)
        if got is None:
            ids = self.whole(chunk)
            ends = np.cumsum(self.length[ids]).astype(np.int32)
            if not len(ends) or ends[-1] != len(chunk):
                raise Disagreement
            if len(self.chunks) >= MEMO:
                for old in [k for k, _ in zip(self.chunks, range(MEMO // 2))]:
                    del self.chunks[old]
            got = self.chunks[chunk] = ids, ends
        return got

    def _join(self, raw: bytes) -> np.ndarray:
        got = self.joins.get(raw)
        if got is None:
            got = self.whole(raw)
            if len(raw) < 1 << CHUNK_BITS + 1:
                if len(self.joins) >= MEMO:
                    self.joins.clear()
                self.joins[raw] = got
        return got

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a whole text, by chunk; if chunks can't be made to agree, by encoding all of it again."""
        try:
            return self._by_chunk(raw)
        except Disagreement:
            return self.whole(raw)

    def _by_chunk(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        cuts = self._cuts(data)
        if not len(cuts):
            return self._join(raw)  # the text is one chunk
        prev, prev2 = data[:-1], np.concatenate([data[:1], data[:-2]])
        solid = (prev >= 0x21) & (prev <= 0x7E) | (prev >= 0x80) & (prev2 == 0xC3)
        certain = np.flatnonzero((data[1:] == 0x20) & solid) + 1
        start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(data)]])
        a, b = np.searchsorted(certain, start + 2, "left"), np.searchsorted(certain, end, "left") - 1
        borders = certain.tolist()
        out: list[np.ndarray] = []
        held = None  # the last chunk with borders: ids, ends, start, byte from which it is not yet put out, first and last border left
        last = -1
        for k, (s, e, i, j) in enumerate(zip(start.tolist(), end.tolist(), a.tolist(), b.tolist())):
            if i > j:
                continue
            ids, ends = self._ids(raw[s:e])
            if held is None and s == 0:
                held = ids, ends, 0, 0, i, j
            else:
                left, right, joined, border = self._repair(raw, borders, held, (ids, ends, s, i, j))
                if held is not None:
                    out.append(held[0][_place(held[1], held[3] - held[2]) : _place(held[1], left - held[2])])
                out.append(joined)
                held = ids, ends, s, right, border, j
            last = k
        if held is None:
            return self._join(raw)
        ids, ends, s, at, _, j = held
        if last == len(start) - 1:
            out.append(ids[_place(ends, at - s) :])
        else:
            out.append(ids[_place(ends, at - s) : _place(ends, borders[j] - s)])
            out.append(self._join(raw[borders[j] :]))
        return np.concatenate(out)

    def _repair(self, raw: bytes, borders: list[int], held: tuple | None, new: tuple) -> tuple[int, int, np.ndarray, int]:
        """Encode the text around a join again until it agrees with the chunks on both sides: from, to, ids, border it ends at."""
        ids, ends, s, i, j = new
        wider = 0
        while True:
            right = min(i + 1 + wider, j)
            to = borders[right]
            if held is None:
                left, start = 0, 0
            else:
                left = max(held[5] - 1 - wider, held[4])
                start = borders[left]
            joined = self._join(raw[start:to])
            stops = np.cumsum(self.length[joined])
            # the outermost stretches decide; what lies between is what the join changes
            inner = borders[max(right - 1, i)]
            agrees = _same(joined, stops, inner - start, to - start, ids, ends, inner - s, to - s)
            if agrees and held is not None:
                inner = borders[min(left + 1, held[5])]
                agrees = _same(joined, stops, 0, inner - start, held[0], held[1], start - held[2], inner - held[2])
            if agrees:
                return start, to, joined, right
            if right == j and (held is None or left == held[4]):
                raise Disagreement
            wider += 1


def _place(ends: np.ndarray, offset: int) -> int:
    """How many ids end at or before a byte; raises if none ends there."""
    n = int(np.searchsorted(ends, offset)) + 1 if offset else 0
    if n and (n > len(ends) or ends[n - 1] != offset):
        raise Disagreement
    return n


def _same(x: np.ndarray, x_ends: np.ndarray, x_from: int, x_to: int, y: np.ndarray, y_ends: np.ndarray, y_from: int, y_to: int) -> bool:
    """Whether two stretches of text have the same ids, with borders of ids at both ends."""
    try:
        return np.array_equal(x[_place(x_ends, x_from) : _place(x_ends, x_to)], y[_place(y_ends, y_from) : _place(y_ends, y_to)])
    except Disagreement:
        return False


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for each row of ``docs``. ``path``: a vocabulary file every executor has."""
    path = path or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists([c.encode(x) for x in raw_texts(part.column(1))])], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids, decoded string) for each row of (key, ids). Null ids decode to an empty text."""
    path = path or default_vocabulary()
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], [key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
