import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10_langid(spark, sf).collect()}
    assert set(got) == set(rows)
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in rows)
    scored = [d for d in held if rows[d]["lang"] and any(c.isalpha() for c in rows[d]["text"] or "")]
    right = sum(got[d]["lang_pred"] == rows[d]["lang"] for d in scored)
    assert right / len(scored) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark):
    rows = [(3 * i, ("the and of with this " if i % 2 else "der und das nicht mit ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    rows += [(1001, None, "en"), (1002, "", None), (1003, "123 ... \n", "de"), (None, "der und das nicht", None), (1004, "the and of " * 60000, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001]["score"] == 0
    assert (got[None]["lang_pred"], got[1004]["lang_pred"]) == ("de", "en")
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null and doc_id is not null")).collect()} <= {"und"}


def test_pair_tables_equal_plain_convolution():
    net = langid.train([b"abc def" * 20, b"xyz uvw" * 20], ["a", "b"], steps=5)
    net.tables()
    w = langid.windows_of(b"abc xyz def uvw" * 30)
    tops = []
    for width, f in net.filters.items():
        tops.append(sum(f[j][w[:, j : j + langid.WINDOW]] for j in range(width)).max(axis=1))
    want = langid.softmax(np.maximum(np.concatenate(tops, axis=1) + net.bias, 0) @ net.dense + net.dense_bias)
    np.testing.assert_allclose(net.probabilities(w), want, rtol=1e-4, atol=1e-5)


def test_copies_do_not_starve_a_sample(spark):
    copy = spark.range(20000).selectExpr("'der und das nicht mit' AS text", "'de' AS lang")
    rest = spark.range(400).selectExpr("concat('wort', id, ' und der') AS text", "'de' AS lang")
    few = spark.range(5000).selectExpr("concat('the of ', id % 3) AS text", "'en' AS lang")
    texts, langs = langid.training_sample(copy.unionByName(rest).unionByName(few), "text", "lang")
    assert (langs.count("de"), langs.count("en")) == (300, 3)
    assert len(set(texts)) == 303
    # the 300 of 401 smallest hashes, whatever the copies
    once = copy.limit(1).unionByName(rest)
    smallest = [r["text"].encode() for r in once.orderBy(F.xxhash64("text")).limit(300).collect()]
    assert [t for t, x in zip(texts, langs) if x == "de"] == smallest


def test_only_letters_count_as_text(spark):
    df = spark.createDataFrame([(1, "½ ① Ⅷ ²", None), (2, "٣ 12 ‿ _", None), (3, "ß", None), (4, "日本", None), (None, "the of", "xx"), *((3 * i + 5, "the of and", "en") for i in range(6))], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "en", "en"]
    # a row without id is neither held out nor learned from
    assert got[None]["held_out"] is False and got[None]["lang_pred"] == "en"


def test_noise_is_rejected_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    net = langid.train(*langid.training_sample(rows.where("crc32(cast(doc_id as string)) % 3 != 1"), "text", "lang"), noise=True)
    rng = np.random.default_rng(99)
    base64 = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 700)) for _ in range(20)]
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 300)) for _ in range(20)]
    junk = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(base64 + hexes)], rows.schema)
    kept = {r["doc_id"] for r in langid.with_language(rows.unionByName(junk), net).collect()}
    lettered = {r["doc_id"] for r in rows.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert kept == lettered
