import gzip
import hashlib
import math

import numpy as np
import pytest
from brute import components

from tidemark.llm import _shared, embed_dedup, queries, warc


def brute(rows, cosine=0.98):
    """{id: (n_links, component)} of (id, vector, label)."""

    def fine(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if fine(v, lab)]
    n, links = {i: 0 for i, _, _ in rows}, set()
    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[a + 1 :]:
            if p == q and len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= cosine:
                n[i] += 1
                n[j] += 1
                links.add((i, j))
    comp = components([r[0] for r in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def planted(seed, n=300, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, label = rng.normal(size=dim), int(rng.integers(0, 3))
        rows.append((x, label))
        for _ in range(int(rng.integers(0, 5))):
            rows.append((x + rng.normal(size=dim) * rng.uniform(0.0, 0.3), label))
        if i % 10 == 0:
            rows += [(x, label)] * 3
    order = rng.permutation(len(rows))
    return [(int(order[k]), x.astype(np.float32).tolist(), lab) for k, (x, lab) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    rows = planted(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in queries.op5_embed_dedup(spark, sf).collect()} == brute(rows)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (11, v, 2), (12, [1.0, 2.0], 1), (13, [1e30, 2e30, 3e30], 1), (14, [-1.0, -2.0, -3.0], 1), (15, [5.0], 7), (16, [9.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df).collect()} == brute(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r)[1:] for r in embed_dedup.near_duplicates(twice).collect() if r["vec_id"]) == [(2, 1, True)] * 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_find_all_pairs_of_enough_collisions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(700, 24)), rng.normal(size=(300, 24))
    b[:150] = a[:150] + rng.normal(size=(150, 24)) * 0.2
    b[5], a[9] = a[3], b[7]
    count = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.5).sum(axis=2)
    for t in (24, embed_dedup.calibrated_count(), 12, 1):
        i, j = embed_dedup.candidates(a, b, 0.5, t)
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(count >= t))))
    assert len(embed_dedup.candidates(a[:0], b, 0.5, 19)[0]) == len(embed_dedup.candidates(a, b[:0], 0.5, 19)[0]) == 0


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z  # exactly at the threshold
    half, cell = embed_dedup._spread(64, 0.98)
    lines = embed_dedup.directions(64)
    hits = (np.abs((x - y) @ lines[:, 1:]) <= half).sum(1)
    assert (hits >= embed_dedup.calibrated_count()).mean() >= 0.999
    assert np.abs((x - y) @ lines[:, 0]).max() < cell
    far = rng.permutation(4000)
    assert (((np.abs((x - x[far]) @ lines[:, 1:]) <= half).sum(1)) >= embed_dedup.calibrated_count()).mean() < 0.01


HTML = "<p>" + "a" * 200
PAGES = [
    (5, "http://a", HTML), (2, "http://b", HTML), (9, None, HTML), (1, "x\r\nWARC-Type: evil", "short"), (3, "http://c", "short"), (4, "", None), (6, "u", ""),
    (7, "u", "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\n\r\n" + "y" * 100),
    (8, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", "é" * 49), (12, "u", "é" * 49), (13, "u", "z\r\n\r\n" * 50000), (14, "u", "WARC/1.0\r\n" * 30),
]


def expected(pages):
    first = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        f = first.get(h, i) if raw else i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out)


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash", 3) for p in PAGES], "page_id long, url string, html string, digest string, first int")
    for n in (1, 3):
        path = _shared.Scratch(spark).path("warc")
        warc.write(df.repartition(n), path)
        got = warc.read(spark, path)
        assert sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(PAGES)
        urls = {r["page_id"]: r["url"] for r in got.collect()}
        assert urls[5] == "http://a" and urls[9] is None and urls[1] == "x%0D%0AWARC-Type: evil"
    path = _shared.Scratch(spark).path("warc")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0
    odd = spark.createDataFrame([(None, "u", HTML), (3, "u", HTML), (3, "u", HTML)], "page_id long, url string, html string")
    path = _shared.Scratch(spark).path("warc")
    warc.write(odd, path)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect()) == [(0, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_warc_long_urls(spark):
    pages = [(1, "u" * 200_000, HTML), (2, "v", "short"), (3, "w" * 65_536, HTML), (4, "x", "WARC/1.0\r\n" * 100_000), (5, "y" * 1_000_000, None)]
    path = _shared.Scratch(spark).path("warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read(spark, path).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(pages)
    assert {r["page_id"]: r["url"] for r in got} == {i: u for i, u, _ in pages}


def test_archives_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    monkeypatch.setattr(warc, "SIZES", (8 << 10, 64 << 10, 1 << 20))
    df = spark.range(900).selectExpr("id AS page_id", "'u' AS url", "repeat(concat(id, 'x'), cast(if(id % 300 = 0, 700000, if(id % 9 = 0, 9000, 900)) AS int)) AS html")
    path = _shared.Scratch(spark).path("warc")
    warc.write(df.coalesce(1), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    records = [warc.gzip.decompress(f["content"]) for f in files]
    assert all(len(r) <= 1 << 20 or r.count(warc.MAGIC) == 1 for r in records) and max(map(len, records)) > 1 << 20
    got = warc.read(spark, path)
    assert got.count() == 900 and got.select("page_id").distinct().count() == 900


def test_warc_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in queries.op6_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(pages)


def test_damaged_archive_is_refused(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.warc.gz").write_bytes(gzip.compress(record * 1000))
    assert warc.read(spark, f"file://{good}").count() == 1000
    for name, data in {"cut": record * 5 + record[:-6], "gap": record + b"junk" + record}.items():
        d = tmp_path / name
        d.mkdir()
        (d / "a.warc.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="do not lead to its end"):
            warc.read(spark, f"file://{d}").count()
