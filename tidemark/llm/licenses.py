"""Licence scan: sparse n-gram logistic regression over paragraphs, in DataFrame functions alone.

A paragraph is what lies between lines without words: blank lines, or lines of comment signs. White space, case and
punctuation don't count. The classifier reads pieces of a paragraph: each line, and windows of ``WIDTH`` words over the
paragraph where it has several lines, each ``STEP`` words after the one before, so that any notice lies whole in a
window, however it is wrapped. It is a multinomial logistic regression with an L1 penalty, trained in numpy on the
notices below, on texts of other licences (class ``unknown``) and on sentences that only sound like notices (``none``),
with words dropped and prose around them. It weighs words and word pairs; an n-gram of common words alone has no weight,
and a piece without any weighted n-gram is ``none`` by the bias alone (checked after training).

Class scores are divided by a temperature fitted on notices that training has not seen. A piece gets a family only if
the probability reaches a threshold, fitted on unseen licences and unseen notices, and if template comparison agrees:
``AGREEMENT`` of the word pairs of one notice of the family occur in the piece. A piece that is not ``none`` but fails
either is ``unknown``.

Null and empty texts have no paragraphs. Lines and texts have any length. Equal probabilities go to the class that
sorts first, equal scores of families to the name that sorts last. Rows with equal ids and equal texts get the same
answer; rows without id are answered like others. Empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = "GNU {0}General Public License"
_GNU_LINES = [
    "This work is licensed under the {gnu}, version {v}.",
    "{sub} is free software: you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "{sub} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {gnu} for more details.",
    "You should have received a copy of the {gnu} along with {sub}. If not, see <https://www.gnu.org/licenses/>.",
    "SPDX-License-Identifier: {spdx}-{v}.0-or-later",
    "Released under the {spdx} v{v} license.",
    "Licensed under the {gnu} v{v}.0",
]


def _gnu(kind: str, sub: str, spdx: str, v: str) -> list[str]:
    return [s.format(gnu=_GNU.format(kind), sub=sub, spdx=spdx, v=v) for s in _GNU_LINES]


def _creative(name: str, code: str) -> list[str]:
    return [
        f"This work is licensed under a Creative Commons {name} 4.0 International License.",
        f"Licensed under {code} 4.0.",
        f"Creative Commons {name} 4.0 License",
        f"To view a copy of this license, visit https://creativecommons.org/licenses/{code[3:].lower()}/4.0/",
        f"SPDX-License-Identifier: {code.replace(' ', '-')}-4.0",
    ]


#: Notices by family, as files and licence texts have them; templates of at most WIDTH - STEP words.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "gpl": [*_gnu("", "This program", "GPL", "3"), "Distributed under the GNU GPL v3 or later."],
    "lgpl": [*_gnu("Lesser ", "This library", "LGPL", "3"), "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License"],
    "agpl": _gnu("Affero ", "This program", "AGPL", "3"),
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": _creative("Attribution", "CC BY"),
    "cc-by-sa": _creative("Attribution-ShareAlike", "CC BY-SA"),
    "cc-by-nc": _creative("Attribution-NonCommercial", "CC BY-NC"),
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Dedicated to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is the confidential and proprietary information of the company and may not be disclosed.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright (c) the authors. All rights reserved."],
}
#: Texts of licences that are no family here; what resembles them is unknown.
UNLISTED = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Boost Software License - Version 1.0. Distributed under the Boost Software License, Version 1.0.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Licensed under the Eclipse Public License - v 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "Licensed under the EUPL, Version 1.2 or later, you may not use this work except in compliance with the Licence.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "You may distribute this package under the terms of the Artistic License 2.0.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "By installing this software you agree to be bound by the terms of this end user license agreement.",
    "This is a limited license; the licensee may not sublicense, rent or lease the product.",
    "Released under the terms of the Sleepycat Public License, version 4.",
]
#: Sentences that share words with notices without being any.
OTHERS = ["The driver had no license with them that day.", "Permission to enter the building was granted at noon.", "The software is free of charge for the whole week.", "Please read the documentation files before you copy the source.", "A general rule of the public library, version after version.", "All people reserved a table under the terms of the house.", "The work of the foundation is known in public.", "Common words of the creative author are in the code.", "They may use this form without conditions.", "The following file is subject to change.", "Many rights and conditions are permitted by law.", "This project is about birds and their international routes.", "Commercial ships are distributed over the sea.", "An apache helicopter flew over the town.", "They studied at MIT for a year.", "The Apache tribe has lived in the south, version 2.0 of its history says.", "The helicopter is licensed to fly at night.", "The rights of the people were reserved for later.", "The company made a public version of the program available.", "Attribution of the picture to the painter is under dispute.", "The domain of the king was public land.", "The clause in the contract was released to the press.", "The affero of music and the mozilla of film met.", "A confidential letter was strictly prohibited reading.", "Notice that a copy of the file was distributed to all persons."]
#: Notices, licences and sentences that training does not see: temperature and threshold are fitted on these.
HELD_OUT = {
    "mit": ["This project is licensed under the MIT License - see the LICENSE file for details.", "Distributed under the MIT license."],
    "apache": ["Licensed under the Apache License, Version 2.0; see the file LICENSE for the terms.", "This project is released under the Apache License 2.0."],
    "gpl": ["This file is part of a program licensed under the GNU General Public License, version 2 or later.", "License: GNU General Public License v3.0"],
    "lgpl": ["This file is licensed under the GNU Lesser General Public License v2.1 or later."],
    "agpl": ["The server is licensed under the GNU Affero General Public License v3."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."],
    "mpl": ["This file is licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["This article is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike 4.0 License."],
    "cc-by-nc": ["Published under the Creative Commons Attribution-NonCommercial 4.0 License."],
    "cc0": ["The data are dedicated to the public domain under CC0 1.0."],
    "proprietary": ["Unauthorized copying of this document is strictly prohibited. Proprietary and confidential."],
    "all-rights-reserved": ["Copyright 2020 Someone. All rights reserved."],
    "unknown": ["Licensed under the Microsoft Public License.", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "This is free and unencumbered software released into the public domain.", "Licensed under the Academic Free License version 3.0.", "This software is licensed under the Foobar Public License, version 7.", "This product is subject to the Zope Public License, Version 2.1."],
    "none": ["The license plate of the car was hidden under the snow.", "The Apache attack helicopter version 2.0 is licensed.", "Public transport in the city is free for children.", "They had the permission of the general to copy the map.", "A source of the river is subject to floods, with or without rain.", "The university press published a work about common law.", "All seats are reserved for members of the foundation."],
}
#: Common words: an n-gram of these alone has no weight.
COMMON = set("a an and or of the to in on by as at be is are this that it its you your any all may no not with without under from for see file files work use used can will has have had he she they him her them their than then there these those which who what source code people day time way after before over about into out up down one two more most other some such only own same so too very was were been being do does did but if because until while each few both through during between again once here when where why how we our us i me my".split())
#: Words of a window and of the step to the next.
WIDTH, STEP = 128, 48
GRAMS, EPOCHS, RATE, PENALTY, VARIATIONS = 2, 400, 4.0, 0.0003, 40
#: Share of a notice's word pairs that a piece of its family has at least.
AGREEMENT = 0.6
_WORD = r"[^a-z0-9]+"
_LINE = r"[\r\n]+"
#: A line without words, with the line ends around it.
_BLANK = r"(?>\r\n|\r|\n)[^a-zA-Z0-9\r\n]*(?>\r\n|\r|\n)"


def tokens_of(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}


@dataclass
class Model:
    classes: list[str]  # the first is "none", the second "unknown"
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float
    anchors: list[str]

    def probabilities(self, text: str) -> np.ndarray:
        x = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams_of(tokens_of(text)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp((x - x.max()) / self.temperature)
        return e / e.sum()


def _variations(rng: np.random.Generator, stock: dict[str, list[str]], filler: list[str]) -> tuple[list[list[str]], list[int]]:
    """Each text of ``stock`` as it is, and variations of it: words dropped, prose around."""
    xs, ys = [], []
    for c, name in enumerate(["none", "unknown", *NOTICES]):
        texts = [tokens_of(s) for s in stock[name]]
        for k in range(max(VARIATIONS, 3 * len(texts)) * (5 if name == "none" else 1)):
            words = list(texts[k % len(texts)])
            if k >= len(texts):
                words = [w for w in words if rng.random() > 0.04]
                if name == "none" and rng.random() < 0.6:
                    words = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(4, 40)))]
                around = [[filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)))] for _ in range(2)]
                words = around[0] + words + around[1]
            xs.append(words)
            ys.append(c)
    return xs, ys


def train(seed: int = 5) -> Model:
    """Proximal gradient descent with an L1 penalty; temperature and threshold from texts that training does not see."""
    classes = ["none", "unknown", *NOTICES]
    stock = {"none": OTHERS, "unknown": UNLISTED, **NOTICES}
    xs, ys = _variations(np.random.default_rng(seed), stock, [w for s in OTHERS for w in tokens_of(s)])
    anchors = sorted({w for n in ("unknown", *NOTICES) for s in stock[n] for w in tokens_of(s)} - COMMON)
    known = set(anchors)
    vocabulary = sorted({g for n in ("unknown", *NOTICES) for s in stock[n] for g in grams_of(tokens_of(s)) if set(g.split()) & known})
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        m = np.zeros((len(rows), len(vocabulary)))
        for i, r in enumerate(rows):
            m[i, [place[g] for g in grams_of(r) if g in place]] = 1
        return m

    x, y = matrix(xs), np.array(ys)
    share = (len(y) / len(classes) / np.bincount(y))[y]  # all classes weigh alike
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[y]
    for _ in range(EPOCHS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) * share[:, None] / len(y)
        w -= RATE * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * PENALTY, 0)
        b -= RATE * d.sum(0)
    unseen = [w for s in HELD_OUT["none"] for w in tokens_of(s)]
    hx, hy = _variations(np.random.default_rng(seed + 1), HELD_OUT, unseen)
    z, hy = matrix(hx) @ w + b, np.array(hy)

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(soft(t)[np.arange(len(hy)), hy] + 1e-12).mean())
    p = soft(temperature)
    best, named = p.argmax(1), p.max(1)
    family, right = best > 1, best == hy
    # the threshold that gets most pieces right: notices above it, all else below
    threshold = float(max(np.linspace(0.3, 0.95, 66), key=lambda t: (family & right & (named >= t)).sum() - 2 * (family & ~right & (named >= t)).sum()))
    used = np.abs(w).max(1) > 1e-6
    model = Model(classes, {g: w[i].tolist() for g, i in place.items() if used[i]}, b.tolist(), float(temperature), threshold, anchors)
    if int(np.argmax(model.bias)) != 0:
        raise AssertionError("a piece without features must be none")
    return model


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


def grams_column(words: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def _anchored(words: Column, model: Model) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, model.anchors)))


def windows_column(words: Column) -> Column:
    """The windows of an array of words; one for a short array."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - WIDTH) / STEP), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.slice(words, i * STEP + 1, F.lit(WIDTH)))


def pieces(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _hash, block, piece, words) of every piece with an anchor: windows of the lines, and of paragraphs of several lines."""
    blocks = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.posexplode(F.split(F.col(text).cast("string"), _BLANK)).alias("block", "paragraph"))
    # words of a paragraph are split once; most paragraphs have no anchor and end here
    split = blocks.select("_id", "_hash", "block", F.transform(F.split("paragraph", _LINE), words_column).alias("lines"))
    split = split.select("_id", "_hash", "block", F.filter("lines", lambda w: _anchored(w, model)).alias("lines"), F.flatten("lines").alias("all"), F.size("lines").alias("n")).where(F.size("lines") > 0)
    own = F.flatten(F.transform("lines", windows_column))
    over = F.when(F.col("n") > 1, windows_column(F.col("all"))).otherwise(F.array().cast("array<array<string>>"))
    found = split.select("_id", "_hash", "block", F.posexplode(F.concat(own, over)).alias("piece", "words"))
    return found.where(_anchored(F.col("words"), model))


def classify(words: DataFrame, model: Model) -> DataFrame:
    """(_id, _hash, block, piece, label, score) of the rows of ``words(_id, _hash, block, piece, words)`` that are not ``none``."""
    spark = words.sparkSession
    place = ["_id", "_hash", "block", "piece"]
    grams = words.select(*place, F.explode(grams_column(F.col("words"))).alias("gram"))

    # weights and notices are one small table, as long as the model: its size does not depend on the input
    table = {g: (ws, []) for g, ws in model.weights.items()}
    notices = [(name, pairs_of(tokens_of(s))) for name, ns in NOTICES.items() for s in ns]
    zero = [0.0] * len(model.classes)
    for i, (_, pairs) in enumerate(notices):
        for g in pairs:
            table.setdefault(g, (zero, []))[1].append(i)
    learned = spark.createDataFrame([(g, ws, at) for g, (ws, at) in sorted(table.items())], "gram string, w array<double>, notices array<int>")
    # only grams that count are dealt out, each once
    hits = grams.join(F.broadcast(learned.select("gram")), "gram", "left_semi").distinct().join(F.broadcast(learned), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(model.classes))]
    shares = [(F.sum(F.array_contains("notices", i).cast("int")) / len(pairs)).alias(f"n{i}") for i, (_, pairs) in enumerate(notices)]
    scored = hits.groupBy(*place).agg(*sums, *shares)
    z = F.array(*[(F.col(f"z{i}") + b) / model.temperature for i, b in enumerate(model.bias)])
    agree = [F.greatest(*[F.col(f"n{i}") for i, (own, _) in enumerate(notices) if own == name], F.lit(0.0), F.lit(0.0)) for name in model.classes]
    scored = scored.select(*place, z.alias("z"), F.array(*agree).alias("agree"))
    top = F.array_max("z")
    best = F.array_position("z", top)
    score = 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    confirmed = (score >= model.threshold) & (F.element_at("agree", best.cast("int")) >= AGREEMENT)
    label = F.when(confirmed, F.element_at(F.array(*map(F.lit, model.classes)), best.cast("int"))).otherwise("unknown")
    return scored.where(best != 1).select(*place, label.alias("label"), score.alias("score"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(key, license, licenses, n_paragraphs, score) per row of ``docs``.

    license: the family of the piece with the highest score, else ``unknown`` if a piece is, else ``none``;
    licenses: all families, sorted, comma-joined; n_paragraphs: how many paragraphs have a piece that is not ``none``;
    score: the probability of the piece that gave the license, 0 for ``none``.
    """
    model = model or train()
    found = classify(pieces(docs, model, text, key), model)
    family = F.col("label") != "unknown"
    per = found.groupBy("_id", "_hash").agg(
        F.max_by("label", F.struct(family, "score", "label")).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(family, F.col("label")))), ",").alias("licenses"),
        F.count_distinct("block").alias("n_paragraphs"),
        F.max(F.struct(family.alias("f"), "score"))["score"].alias("score"),
    )
    rows = docs.select(F.col(key).alias("_doc"), F.xxhash64(F.col(text).cast("string")).alias("_text"))
    out = rows.join(per, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    return out.select(F.col("_doc").alias(key), F.coalesce("license", F.lit("none")).alias("license"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("score", F.lit(0.0)).alias("score"))
