import random

import numpy as np
import pytest
from brute import components, repeats, sha, simhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import _shared, queries
from tidemark.llm import simhash as op2
from tidemark.llm import substring as op9


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, fp string, _key int")


def table(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_simhash_query(spark, size):
    rows = table(spark, f"/root/testdata/{size}")
    fp, comp = simhash(rows)
    got = queries.op2_simhash(spark, f"/root/testdata/{size}").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fp[d]:016x}", comp[d]) for d, _ in rows}


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "one"), (2, "ONE"), (7, "a b c"), (8, "a b c d e"), (4, "É x É x É x"), (6, "w " * 50000)]
    fp, comp = simhash(rows)
    got = op2.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in got} == {d: (fp[d], comp[d]) for d, _ in rows}
    assert op2.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    twice = [(1, "same text here now"), (1, "same text here now"), (None, "same text here now"), (None, "another one of them")]
    got = op2.near_duplicates(frame(spark, twice)).collect()
    assert sorted((r["doc_id"] or 0, r["component"] or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_links_of_a_dense_ball_are_complete(spark):
    """Many fingerprints within a few bits of each other, and chains of single links."""
    rng = random.Random(4)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        weak = rng.sample(range(64), 14)
        for _ in range(250):
            fps.add(centre ^ sum(1 << b for b in rng.sample(weak, rng.randint(0, 6))))
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
    ids = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    f = np.array(ids, np.int64).view(np.uint64)
    pairs = set()
    for i in range(len(ids)):
        pairs.update((ids[i], ids[i + 1 + int(j)]) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4))
    from brute import components

    want = components(ids, pairs)
    got = op2.link(spark.createDataFrame([(x,) for x in ids], "fp long"), _shared.Scratch(spark)).collect()
    assert {r["fp"]: r["component"] for r in got} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = _shared.connected_components(_shared.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_substring_query(spark, size):
    rows = table(spark, f"/root/testdata/{size}")
    want = repeats(rows)
    got = queries.op9_substring(spark, f"/root/testdata/{size}").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {d: (n, g, sha(k)) for d, (n, g, k) in want.items()}


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 40):
        parts = [rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    return [*rows, (2000, None), (2001, ""), (2002, "a " * 30000), (2003, "b " * 25), (2004, " ".join(vocabulary) + " x" * 19)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_against_brute_force(spark, seed, monkeypatch):
    rows = passages(seed)
    if seed > 1:
        monkeypatch.setattr(op9, "SLICE", 500)
    want = repeats(rows)
    got = op9.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    for r in got:
        spans = r["spans"] or []
        assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))  # maximal


def test_substring_runs_and_buckets(spark):
    """The same marks whatever the runs and buckets."""
    rows = passages(9)
    want = repeats(rows)
    run = op9._Run(20, 3)
    marked = {}
    for d, t in rows:
        run.add([(d, 0, (t or "").encode().split(), 0)])
    for b in run.flush():
        assert b.num_rows
    assert run.n == 0
    assert want


def test_substring_edges(spark):
    line = " ".join(f"t{i}" for i in range(25))
    twice = [(1, line), (1, line), (2, line), (None, line)]
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in op9.remove_repeats(frame(spark, twice)).collect())
    assert got == [(1, 0), (1, 0), (2, 25), (99, 25)]
    assert op9.remove_repeats(frame(spark, twice).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "c"]), max_size=60), st.integers(1, 6))
def test_equal_hashes_are_equal_windows(ws, size):
    h = op9.window_hashes([w.encode() for w in ws], size)
    text = [tuple(ws[i : i + size]) for i in range(max(0, len(ws) - size + 1))]
    assert len(h) == len(text) and len(set(h.tolist())) == len(set(text))
    assert all((h[i] == h[j]) == (text[i] == text[j]) for i in range(len(text)) for j in range(i))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(_shared, "FEW", 10)
    monkeypatch.setattr(_shared, "HOT", 20)
    rng = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 700)] + [(700 + i, 701 + i) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (250, 2))] + [(699, 730)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in _shared.connected_components(_shared.Scratch(spark), df).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    rows = spark.range(1000).selectExpr("if(id < 700, 1, id % 50) AS k", "id")
    small = rows.groupBy("k").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    plan = _shared.join_hot(rows, small, "k", 1000)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString() and sorted(map(tuple, plan.collect())) == sorted(map(tuple, rows.join(small.drop("n"), "k").collect()))
