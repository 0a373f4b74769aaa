import random

import numpy as np
import pytest
from brute import crc_ids, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing, queries

TEXTS = [
    None, "", " ", "   \n\n  x", "plain words only", "it's we'll they've 'tis '' 'll", "a  b   c \n d\t e\r\nf",
    "<|endoftext|>", "x<|endoftext|> y <|endoftext|>z <|endof text|>", "tab\tand nbsp   x  y\u0085 z", "\x1c \x1d x \x00 y",
    "日本語 のテキスト と English", "é è ê à " * 400, "word " * 3000, "ab" * 40000, " " * 5000 + "x", "🙂 🙂🙂 " * 500, "1234 56 7.8 " * 800,
]


def mixed(n, seed):
    rng = random.Random(seed)
    stock = ["the quick brown fox jumps over it's lazy dog's tail.", "Über naïve façade ", "\n\n", "  ", "<|endoftext|>", " ", "don't ", "x1 ", "'", "l", " ré", "日本", "\t", "!!! ..."]
    return "".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_vocabulary())


def reference(codec, text):
    return codec.slow.encode(text or "", add_special_tokens=False).ids


def test_encodes_as_the_library(codec):
    for t in [*TEXTS, *(mixed(n, n) for n in (5, 50, 500, 3000))]:
        assert codec.encode((t or "").encode()).tolist() == reference(codec, t), repr(t)[:80]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "é", " ", "\n", "'s", "<|endoftext|>", " ", "a", "Zz", "1", "—"]), max_size=60), st.integers(1, 60))
def test_chunks_agree_wherever_they_are_cut(parts, times):
    c = bpe.codec(bpe.default_vocabulary())
    text = "".join(parts) * times
    assert c.encode(text.encode()).tolist() == reference(c, text)


def test_joins_grow_until_they_agree(codec, monkeypatch):
    text = mixed(9000, 5).encode()
    want = reference(codec, text.decode())
    single = {b[0]: i for i, b in enumerate(codec.bytes_of) if len(b) == 1}
    honest, repair, wide = codec._ids, codec._repair, []

    def spoilt(chunk):
        """The last ids of a chunk in single bytes, as if more than its last word depended on what follows."""
        ids, _ = honest(chunk)
        if not text.endswith(chunk) and len(ids) > 100:
            ids = np.array([*ids[:-9], *(single[x] for i in ids[-9:] for x in codec.bytes_of[i])], np.uint32)
        return ids, np.cumsum(codec.length[ids])

    def watched(raw, borders, held, new):
        got = repair(raw, borders, held, new)
        wide.append(0 if held is None else held[5] - borders.index(got[0]))
        return got

    codec.chunks.clear()
    monkeypatch.setattr(codec, "_ids", spoilt)
    monkeypatch.setattr(codec, "_repair", watched)
    assert codec._by_chunk(text).tolist() == want
    assert len(wide) > 20 and max(wide) > 1  # some joins grew
    codec.chunks.clear()


def test_short_texts_are_cut_as_well(codec):
    texts = [mixed(n, 100 + n).encode() for n in range(1, 60)]
    assert any(len(codec._cuts(np.frombuffer(t, np.uint8))) for t in texts if 0 < len(t) < 1 << bpe.CHUNK_BITS)
    for t in texts:
        assert codec._by_chunk(t).tolist() == reference(codec, t.decode())


def test_invalid_utf8_does_not_crash(codec):
    raw = b"ab \xff\xfe cd " * 600
    assert codec.encode(raw).tolist() == codec.whole(raw).tolist()


def test_round_trip_and_shared_chunks(codec):
    passage = mixed(4000, 3)
    codec.chunks.clear()
    codec.encode(passage.encode())
    n = len(codec.chunks)
    codec.encode(("other start " + passage + " other end").encode())
    assert n > 5 and len(codec.chunks) <= n + 4  # chunks of the shared passage were not encoded again
    assert codec.decode(codec.encode(passage.encode()).tolist()) == passage


def test_query_on_whole_table(spark, sf, codec):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op1_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference(codec, rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(codec.slow.decode(ids, skip_special_tokens=False))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int")


def test_encode_edges(spark, codec):
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark, TEXTS)).collect()}
    assert got == {i: reference(codec, t) for i, t in enumerate(TEXTS)}
    assert bpe.decode(bpe.encode(docs(spark, TEXTS).limit(0))).count() == 0
    null = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert bpe.encode(null).count() == 3


def check_packing(rows, ids_of, top=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    waste = total = 0
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)])[:-1].tolist()
        n = sum(r["length"] for r in s)
        assert 0 < n <= top and all(r["length"] > 0 for r in s)
        total += n
        waste += 0 if n & (n - 1) == 0 else top - n
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        ps.sort(key=lambda r: r["start"])
        ids, at = ids_of[d], 0
        for r in ps:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc_ids(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    return waste / total


def test_packing_query(spark, sf, codec):
    ids = {r["doc_id"]: [*reference(codec, r["text"]), 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packing(queries.op3_packing(spark, sf).collect(), ids) == 0


def test_packing_edges_and_small_buffers(spark, codec):
    want = {i: [*reference(codec, t), 1] for i, t in enumerate(TEXTS)}
    for buffer in (1000, 1 << 21):
        got = packing.pack(docs(spark, TEXTS).coalesce(1), buffer_tokens=buffer).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_packing(got, want)
    assert packing.pack(docs(spark, TEXTS).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=80), st.booleans())
def test_windows_are_full(lengths, last):
    runs = [(i, 0, n) for i, n in enumerate(lengths)]
    windows, rest = packing.pack_lengths(runs, packing.TIERS, last)
    covered = sorted([p for _, ps in windows for p in ps] + rest)
    at = {}
    for d, s, n in covered:
        assert n > 0 and at.get(d, 0) == s
        at[d] = s + n
    assert at == dict(enumerate(lengths))
    assert all(sum(p[2] for p in ps) == t for t, ps in windows)
    assert not (last and rest)
    steps = packing.step_groups(windows, packing.STEP_TOKENS)
    for g in set(steps):
        own = [windows[i][0] for i in range(len(windows)) if steps[i] == g]
        assert len(set(own)) == 1 and sum(own) <= packing.STEP_TOKENS
