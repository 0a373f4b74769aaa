import numpy as np
import pytest
from brute import components, crc_ids, fingerprint, repeats

import corpus_pipeline
from tidemark.llm import bpe
from tidemark.llm._shared import Scratch


def expected(rows):
    """{doc_id: text before packing}"""
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    fp = {d: fingerprint(t) for d, t in rows}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    links = {(ids[i], ids[i + 1 + int(j)]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4)}
    comp = components(ids, links)
    kept = {d: t for d, t in rows if comp[d] == d}
    cut = repeats(list(kept.items()))
    return {d: (cut[d][2] if cut[d][1] else t) for d, t in kept.items()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pipeline_against_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    want = expected([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    c = bpe.codec(bpe.default_vocabulary())
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for d, pieces in got.items():
        ids = [*c.slow.encode(want[d], add_special_tokens=False).ids, 1]
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in pieces) == np.array(ids, "<u4").tobytes()
        assert crc_ids(ids[: pieces[0]["length"]]) is not None


def test_stages_keep_odd_columns_and_rows(spark):
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "der und die das " * 9 + line, "de", "s", 5, 1), (2, "der und die das " * 9 + line, "de", "s", 5, 2), (3, "the of and " * 30 + line, "en", None, 0, 3), (3, "the of and " * 30 + line, "en", None, 0, 3), (4, None, None, None, None, 4), (None, "and so the story of it goes on " * 3, "en", "s", 1, 5), (6, "", "en", "s", 0, 6), (7, "x " * 60000, "en", "s", 0, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = Scratch(spark).keep(stage(spark, docs, ""), name)
            assert out.columns == df.columns and out.dtypes == df.dtypes
            docs = out
        left = {r["doc_id"]: r for r in docs.collect()}
        assert sorted(left, key=str) == ([1, 3, 7, None] if docs.count() else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("length > 0").count() >= len(left)
    assert left == {}


def test_language_keeps_documents_without_labels(spark):
    rows = [(i, "der und das nicht mit" if i % 2 else "the and of with", None) for i in range(20)] + [(20, None, None), (21, "", None), (22, "12 34", None)]
    for lang in (None, "und"):
        df = spark.createDataFrame([(i, t, lang) for i, t, _ in rows], "doc_id long, text string, lang string")
        assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()) == list(range(20))


def test_unlike_texts_with_one_id_both_stay(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(1, words("a"), "x"), (1, words("b"), "y"), (1, words("a"), "w"), (2, words("a") + " end", "z"), (None, words("c"), "u"), (None, words("d"), "v"), (None, words("b"), "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got >= {(1, words("a")), (1, words("b")), (None, words("c")), (None, words("d"))} and len(got) in (4, 5)
    assert corpus_pipeline.near_dedup(spark, df, "").where("source = 't'").count() == 0


def test_columns_with_names_of_the_operators_come_back(spark):
    names = ["__key", "__lost", "__cut", "__sum", "__spans", "key", "row", "id", "nth", "words", "fp", "component", "_text", "a.b"]
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"text {i} of " * 9 + line, *[f"{n}-{i}" for n in names]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark).keep(stage(spark, df, ""), name)
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}-{r['doc_id']}" for n in names]
        df = out
    assert df.count() == 5
