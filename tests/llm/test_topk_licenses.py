import math
import random
import re
import sys
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses, queries, topk


def brute(docs, asked, k=10, terms=None):
    """{query: [(id, score)]} with scores added in the order of document frequency and term; ``terms``: the rarest of df >= 2."""
    counts = [(d, Counter((t or "").encode().lower().split())) for d, t in docs]
    df = Counter(t for _, c in counts for t in c)
    mean = max(sum(sum(c.values()) for _, c in counts) / max(len(counts), 1), 1e-9)
    out = {}
    for q, text in asked:
        own = sorted((df[t], t) for t in set((text or "").encode().lower().split()))
        own = own if terms is None else [x for x in own if x[0] >= 2][:terms]
        scored = []
        for d, c in counts:
            n, s, hit = sum(c.values()), 0.0, False
            for f, t in own:
                if c[t]:
                    w = float(np.log(1 + (len(docs) - f + 0.5) / (f + 0.5)))
                    s += w * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean))
                    hit = True
            if hit:
                scored.append((-s, d))
        if scored:
            out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def ranked(rows, query="query", doc="id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[query], r["rank"])):
        out.setdefault(r[query], []).append((r[doc], r["score"]))
    return out


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]], q
        # a posting weighs a multiple of 1 / UNIT: of the up to 300 postings of a score each is off by half of that
        assert all(math.isclose(a[1], b[1], rel_tol=1e-9, abs_tol=150 / topk.UNIT) for a, b in zip(got[q], want[q]))


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(ranked(queries.op7_topk(spark, sf).collect(), "query_id", "doc_id"), brute(docs, [x for x in docs if x[0] % 100 == 0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_common_terms_and_many_shards(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in rng.sample(range(5000), 600)]
    docs += [(6000, None), (6001, ""), (6002, docs[0][1]), (6003, "W1 w1 w2 " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(5)
    asked = [d for d in docs if d[0] % 7 == 0]
    got = topk.more_like_these(df, df.where("doc_id % 7 = 0"), terms=40)
    same(ranked(got.collect()), brute(docs, asked, terms=40))
    assert topk.more_like_these(df.limit(0), df.where("doc_id % 7 = 0")).count() == 0
    assert topk.more_like_these(df, df.limit(0)).count() == 0


def test_whole_texts_are_queries(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    # a word of document 900 alone, and more than 16 words, of which only the commonest are shared
    docs += [(900, "soledad"), (100000, " ".join(f"own{i}" for i in range(20)) + " common"), (100002, "common"), *((100004 + 2 * i, f"common own{i} own{i}") for i in range(20))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    counts = [(d, Counter((t or "").encode().lower().split())) for d, t in docs]
    dfs = Counter(t for _, c in counts for t in c)
    mean = sum(sum(c.values()) for _, c in counts) / len(counts)
    want = {}
    for q, own in counts:
        if q % 100 == 0 and own:
            scores = []
            for d, c in counts:
                hits = sorted(set(own) & set(c))
                if hits:
                    n = sum(c.values())
                    scores.append((-sum(float(np.log(1 + (len(docs) - dfs[t] + 0.5) / (dfs[t] + 0.5))) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in hits), d))
            want[q] = [(d, -x) for x, d in sorted(scores)[:10]]
    assert max(len(c) for q, c in counts if q in want) > 16 and 900 in want
    same(ranked(topk.more_like_these(df, df.where("doc_id % 100 = 0")).collect()), want)


def postings(weight, docs, tfs, lengths, stats=None, mean=100.0):
    docs, tfs = np.asarray(docs, "<u2"), np.asarray(tfs, "<u4")
    bounds, _ = topk._bounds(docs, tfs, lengths, np.array([0, len(docs)]))
    norm = topk.K1 * (1 - topk.B + topk.B * lengths / mean)
    return topk.Postings(weight, docs, tfs, bounds, norm, mean, stats)


def made_lists(rng, n, n_lists, stats, shares=(0.002, 0.05, 0.6), weights=(0.1, 1.0, 5.0)):
    lengths = rng.choice(np.array([40, 100, 300], "<u4"), n)
    lists = []
    for _ in range(n_lists):
        docs = np.flatnonzero(rng.random(n) < rng.choice(shares))
        if len(docs):
            lists.append((float(rng.choice(weights)), docs, rng.integers(1, 4, len(docs))))
    lists.sort(key=lambda x: len(x[1]))
    total = np.zeros(n)
    for w, d, t in lists:
        total[d] += np.rint(w * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * lengths[d] / 100.0)) * topk.UNIT)
    return [postings(w, d, t, lengths, stats) for w, d, t in lists], total


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 12))
def test_wand_is_exact_and_prunes(seed, n_lists, k):
    stats = Counter()
    lists, total = made_lists(np.random.default_rng(seed), 3000, n_lists, stats)
    want = sorted(((-total[d], int(d)) for d in np.flatnonzero(total)))[:k]
    got = topk.wand(lists, k, stats)
    assert [(d, -s) for s, d in want] == [(d, s) for s, d in got]
    assert stats["documents"] <= (total > 0).sum()
    floor = -want[-1][0] if want else 0.0  # a floor drops nothing that reaches it
    assert topk.wand(lists, k, floor=floor) == got


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 12), st.sampled_from([0, 0.5, 1, 1.1]))
def test_wand_by_list_is_exact(seed, n_lists, k, floored):
    rng = np.random.default_rng(seed)
    lists, total = made_lists(rng, 3000, n_lists, None, shares=(0.0005, 0.01, 0.6))
    before = np.where(rng.random(3000) < 0.3, np.rint(rng.random(3000) * topk.UNIT), 0.0)
    total = total + before
    want = sorted(((-total[d], int(d)) for d in np.flatnonzero(total)))[:k]
    floor = np.rint(floored * -want[-1][0]) if want else 0.0
    assert topk.wand_by_list(lists, before, k, floor) == [(-s, d) for s, d in want if -s >= floor]


def made_shard(rng, n, n_terms):
    """A shard of ``n`` documents in order of length, with lists of all sizes, and the exact units of each list's postings."""
    lengths = np.sort(rng.choice(np.array([40, 100, 300], "<u4"), n))
    docs = np.empty(n, topk._DOCS)
    docs["id"], docs["n"] = rng.permutation(n), lengths
    lists = [np.flatnonzero(rng.random(n) < share) for share in rng.choice([0.002, 0.02, 0.1, 0.6], n_terms)]
    lists = [x if len(x) else np.array([0]) for x in lists]
    tfs = [rng.integers(1, 4, len(x)).astype(np.uint8) for x in lists]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    doc, tf = np.concatenate(lists).astype(np.uint16), np.concatenate(tfs)
    bounds, where = topk._bounds(doc, tf.astype(np.uint32), lengths, ends)
    df = np.diff(ends) * 3
    shard = topk.Shard(docs, np.arange(n_terms) * 2, df, [topk._blobs(doc, ends), topk._blobs(tf, ends), topk._blobs(bounds, where)], 3 * n, 100.0)
    norm = topk.K1 * (1 - topk.B + topk.B * lengths / 100.0)
    return shard, docs, [(d, topk.weigh(topk.idf(3 * n, f), t.astype(float), norm[d])) for d, t, f in zip(lists, tfs, df)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 12), st.sampled_from([0, 0.5, 1, 1.1]), st.sampled_from([64, 70, 900]))
def test_shard_search_is_exact(seed, n_terms, k, floored, n):
    rng = np.random.default_rng(seed)
    shard, docs, lists = made_shard(rng, n, 60)
    for _ in range(3):
        own = np.sort(rng.choice(60, n_terms, replace=False))
        total = np.zeros(n)
        for i in own:
            total[lists[i][0]] += lists[i][1]
        want = sorted((-total[d], int(docs["id"][d])) for d in np.flatnonzero(total))[:k]
        floor = np.rint(floored * -want[-1][0])
        got = shard.best(np.append(own * 2, 999), k, floor)
        assert [(-s, int(docs["id"][d])) for s, d in got] == [x for x in want if -x[0] >= floor]


def test_a_task_holds_one_shard_at_a_time():
    """The rows of a unit of many shards are not gathered: what a task takes does not grow with the shards of its unit."""
    rng = np.random.default_rng(11)
    n, n_terms, n_shards, k = 6000, 60, 12, 10
    schema = pa.schema([("unit", pa.int64()), ("slice", pa.int32()), ("shard", pa.int64()), ("t", pa.int64()), ("df", pa.int64()), *((c, pa.binary()) for c in ("docs", "tfs", "bounds")), ("query", pa.int64()), ("terms", pa.list_(pa.int64())), ("floor", pa.float64())])
    asked = {7: [0, 3, 9], 8: [1, 59, 1000], 9: list(range(0, 60, 2)), 10: [1000]}
    docs_of = [np.sort(rng.choice(n * n_shards, n, replace=False)) for _ in range(n_shards)]
    lengths, total, seen, most = np.sort(rng.choice(np.array([40, 100, 300], "<u4"), n)), {q: {} for q in asked}, 0, 0

    def rows(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

    def batches():
        nonlocal seen, most
        for unit in (4, 5):
            yield rows(unit=[unit] * 4, slice=[0] * 4, query=list(asked), terms=list(asked.values()), floor=[0.0] * 4)
            yield rows(unit=[unit] * 0)
            for i in range(unit - 4, n_shards, 2):
                docs = np.empty(n, topk._DOCS)
                docs["id"], docs["n"] = docs_of[i], lengths
                lists = [np.flatnonzero(rng.random(n) < share) for share in rng.choice([0.002, 0.1, 0.6], n_terms)]
                tfs = [rng.integers(1, 4, len(x)).astype(np.uint8) for x in lists]
                bounds = [topk._bounds(x.astype("<u2"), t.astype("<u4"), lengths, np.array([0, len(x)]))[0] for x, t in zip(lists, tfs)]
                for q, terms in asked.items():
                    for t in terms:
                        if t < n_terms:
                            add = topk.weigh(topk.idf(n * n_shards, 900), tfs[t].astype(float), topk.K1 * (1 - topk.B + topk.B * lengths[lists[t]] / 100.0))
                            for d, x in zip(docs["id"][lists[t]].tolist(), add.tolist()):
                                total[q][i, d] = total[q].get((i, d), 0) + x
                made = rows(unit=[unit] * (n_terms + 1), slice=[0] * (n_terms + 1), shard=[i] * (n_terms + 1), t=[None, *range(n_terms)], df=[None, *[900] * n_terms], docs=[docs.tobytes(), *(x.astype("<u2").tobytes() for x in lists)], tfs=[None, *(t.tobytes() for t in tfs)], bounds=[None, *(b.tobytes() for b in bounds)])
                seen += made.nbytes
                for lo in range(0, made.num_rows, 25):  # a batch ends anywhere
                    yield made.slice(lo, 25)
                del made
                most = max(most, pa.total_allocated_bytes() - before)

    before, got = pa.total_allocated_bytes(), {}
    for b in topk.search_sorted(batches(), n * n_shards, 100.0, k):
        for r in b.to_pylist():
            got.setdefault(r["query"], []).append((-r["score"], r["id"]))
    for q in asked:
        want = sorted((-x / topk.UNIT, d) for (_, d), x in total[q].items())[:k]
        assert sorted(got.get(q, []))[:k] == want
    assert most < seen / 3


def test_work_of_a_short_query_is_bounded():
    """Searching a shard makes few calls whatever its size: a walk document by document makes some for each."""
    rng = np.random.default_rng(5)
    shard, _, _ = made_shard(rng, 8000, 40)
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        for i in range(10):
            shard.best(np.sort(rng.choice(40, 8, replace=False)) * 2, 10, 0.0)
    finally:
        sys.setprofile(None)
    assert sum(calls.values()) < 10 * 1500


def test_units_of_shards():
    shards = [(i, w) for i, w in enumerate([topk.SHARD] * 40 + [100] * 60 + [10 * topk.SHARD] * 2)]
    of, unions = topk.unite(shards)
    assert [s for s, _, _ in of] == list(range(102)) and [len(x) > 0 for x in unions] == [True] * 3
    assert {u: t for _, u, t in of} == {u: t for t, us in enumerate(unions) for u in us}
    words = Counter()
    for s, u, _ in of:
        words[u] += shards[s][1]
    assert all(w <= topk.UNION or sum(u == v for _, v, _ in of) == 1 for u, w in words.items())
    assert len(words) < 30
    assert topk.unite([]) == ([], [[], [], []])


def test_wand_skips_blocks():
    rng = np.random.default_rng(1)
    n = 50000
    lengths = np.full(n, 100, "<u4")
    tfs = np.where(np.arange(n) < 200, 50, rng.integers(1, 3, n))
    stats = Counter()
    lists = [postings(1.0, np.arange(n), tfs, lengths, stats), postings(0.5, np.arange(n)[::7], tfs[::7], lengths, stats)]
    topk.wand(lists, 10, stats)
    assert stats["documents"] < 500 and stats["scored"] < 1000
    # a rare term decides: of the common list only the blocks of its documents are scored
    stats.clear()
    lists = [postings(9.0, np.arange(0, n, 2500), np.full(20, 3), lengths, stats), postings(0.3, np.arange(n), tfs, lengths, stats)]
    got = topk.wand_by_list(lists, np.zeros(n), 10, floor=5.0 * topk.UNIT)
    assert len(got) == 10 and stats["scored"] <= 20 + 20 * topk.BLOCK


def test_searches_leave_postings_unscored(spark):
    """Over all queries of a table, search by search: how many postings are scored of those that the lists hold."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    counts = [Counter((t or "").encode().lower().split()) for _, t in docs]
    lengths = np.array([sum(c.values()) for c in counts], "<u4")
    mean, inverted = float(lengths.mean()), {}
    for d, c in enumerate(counts):
        for t, f in c.items():
            inverted.setdefault(t, []).append((d, f))
    held = scored = 0
    for (i, _), c in zip(docs, counts):
        if i % 100 == 0 and len(c) > topk.FEW:
            own = sorted(c, key=lambda t: len(inverted[t]))
            made = lambda seen: [postings(topk.idf(len(docs), len(inverted[t])), *zip(*inverted[t]), lengths, seen, mean) for t in own]
            # the k-th score that earlier shards have found, as in the second and third round
            want = topk.wand_by_list(made(None), np.zeros(len(docs)), 10)
            seen = Counter()
            assert topk.wand_by_list(made(seen), np.zeros(len(docs)), 10, want[-1][0]) == want
            held += sum(len(inverted[t]) for t in own)
            scored += seen["scored"]
    print("scored", scored, "of", held)
    assert scored < 0.75 * held


def test_licence_lines(spark):
    lines = {
        1: ("Licensed under the Apache License, Version 2.0.", "apache"), 2: ("Released under the MIT License.", "mit"), 3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 5: ("LICENSED UNDER THE GNU LESSER GENERAL PUBLIC LICENSE, VERSION 2.1", "lgpl"), 6: ("Released under the BSD 3-Clause License.", "bsd"), 7: ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), 8: ("Licensed under CC BY 4.0.", "cc-by"),
        9: ("Nothing here is about any terms at all, they went to the sea.", "none"), 10: (None, "none"), 11: ("", "none"), 12: ("He studied at MIT for a year.", "none"), 13: ("The driver had no license with them.", "none"), 14: ("Licensed under the Mozilla Public License 2.0.", "mpl"),
    }
    rows = [(i, t if t is None else f"some words before\n{t}\nand some after " + "x " * (20000 if i == 2 else 1), "c") for i, (t, _) in lines.items()] + [(None, "Released under the MIT License.", "c"), (1, rows_of(lines, 1), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["license"] for r in got if r["doc_id"]} == {i: f for i, (_, f) in lines.items()}
    assert [r["license"] for r in got if r["doc_id"] is None] == ["mit"]
    assert licenses.scan(df.limit(0)).count() == 0
    odd = licenses.scan(spark.createDataFrame([(1, "Licensed under the Foobar Public License, version 7.")], "doc_id long, text string")).collect()[0]
    assert odd["license"] in ("unknown", "none")


def test_wrapped_headers(spark):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights"
    bsd = " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"
    apart = "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this sea and of no other"
    rows = [(1, mit), (2, bsd), (3, gpl), (4, f"{mit}\n\n{bsd}\n{gpl}"), (5, apart), (6, f"{gpl}\n\nReleased under the MIT License.\n")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "gpl", 4: "bsd,gpl,mit", 5: "", 6: "gpl,mit"}


def rows_of(lines, i):
    return f"some words before\n{lines[i][0]}\nand some after x "


def test_licences_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    notice = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "all-rights-reserved"}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: ",".join(sorted({f for n, f in notice.items() if n in t})) for d, t in docs.items()}
    got = {r["doc_id"]: r for r in queries.op8_licenses(spark, sf).collect()}
    assert {d: r["licenses"] for d, r in got.items()} == want
    plan = queries.op8_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_scan(text, m):
    """(license, licenses, n_paragraphs, score) of one text, piece by piece."""
    notices = [(n, licenses.pairs_of(licenses.tokens_of(s))) for n, ns in licenses.NOTICES.items() for s in ns]
    known, found = set(m.anchors), []

    def windows(words):
        return [words[i : i + licenses.WIDTH] for i in range(0, max(len(words) - licenses.WIDTH + licenses.STEP - 1, 0) + 1, licenses.STEP)]

    for block, paragraph in enumerate(re.split(licenses._BLANK, text or "")):
        lines = [licenses.tokens_of(x) for x in re.split(r"[\r\n]+", paragraph)]
        pieces = [w for x in lines if known & set(x) for w in windows(x)]
        if pieces and len(lines) > 1:
            pieces += windows([w for x in lines for w in x])
        for words in pieces:
            if not known & set(words):
                continue
            p = m.probabilities(" ".join(words))
            c = m.classes[p.argmax()]
            if c != "none":
                own = licenses.pairs_of(words)
                agree = max((len(own & q) / len(q) for n, q in notices if n == c), default=0)
                fine = p.max() >= m.threshold and agree >= licenses.AGREEMENT
                found.append((fine, p.max(), c if fine else "unknown", block))
    best = max(found, default=(False, 0.0, "none", 0))
    return best[2], ",".join(sorted({f[2] for f in found if f[0]})), len({f[3] for f in found}), best[1]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_wrapped_notices_unseen_licences_and_prose(spark):
    texts = {}
    for name, notice in (("mit", MIT), ("gpl", GPL), ("bsd", BSD), ("apache", APACHE)):
        for width in (40, 75, 100):
            for lead in ("", "# ", " * ", "// "):
                for end in ("\n", "\r\n"):
                    texts[f"some prose before\n\n{end.join(lead + x for x in textwrap.wrap(notice, width))}\n\nand after"] = name
    unseen = [ISC, "\n".join(textwrap.wrap(ISC, 75)), "Licensed under the Microsoft Public License.", "This file is licensed under the Foobar Public License, version 7."]
    prose = [x for x in licenses.HELD_OUT["none"]] + ["The general was free to go.\n\nThe public waited in the snow."]
    rows = [(i, t, "c") for i, t in enumerate([*texts, *unseen, *prose])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert [got[i]["licenses"] for i in range(len(texts))] == list(texts.values())
    assert [got[len(texts) + i]["license"] for i in range(len(unseen))] == ["unknown"] * len(unseen)
    # no sentence is taken for a family; at most one, about an Apache that is licensed, for an unknown licence
    rest = [got[len(texts) + len(unseen) + i]["license"] for i in range(len(prose))]
    assert set(rest) <= {"none", "unknown"} and rest.count("unknown") <= 1


def test_scan_against_brute_force(spark, sf):
    m = licenses.train()
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    stock = [s for ns in licenses.HELD_OUT.values() for s in ns] + [MIT, GPL, BSD, APACHE, ISC]
    for _ in range(150):
        parts = [stock[i] for i in rng.integers(0, len(stock), int(rng.integers(1, 6)))]
        gaps = ["\n", "\n\n", " ", "\r\n", "\r\n \t\r\n", "\n-- *\n", " word" * 70 + " "]
        text = "".join(p + gaps[i] for p, i in zip(parts, rng.integers(0, len(gaps), len(parts))))
        texts.append("\n".join(textwrap.wrap(text, 60)) if rng.random() < 0.3 else text)
    texts += [None, "", "\n\n", "MIT " * 30000, "Released under the MIT License. " + "word " * 200 + "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df, model=m).collect():
        want = plain_scan(texts[r["doc_id"]], m)
        assert (r["license"], r["licenses"], r["n_paragraphs"]) == want[:3], texts[r["doc_id"]]
        assert math.isclose(r["score"], want[3], rel_tol=1e-9)


def test_held_out_texts_are_not_trained_on():
    seen = {" ".join(licenses.tokens_of(s)) for ns in (licenses.OTHERS, licenses.UNLISTED, *licenses.NOTICES.values()) for s in ns}
    assert not seen & {" ".join(licenses.tokens_of(s)) for ns in licenses.HELD_OUT.values() for s in ns}
    assert max(len(licenses.tokens_of(s)) for ns in licenses.NOTICES.values() for s in ns) <= licenses.WIDTH - licenses.STEP
