"""Inputs on which the corpus operators once did less than their whole job."""

import hashlib
import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

import brute
import corpus_pipeline
from pagemill.llm import licenses, mixing, near


@pytest.mark.parametrize("rate", [0.5, 700, 800, 5000])
def test_large_rates_are_drawn(spark, rate):
    docs = spark.createDataFrame([(i, "rare", "x") for i in range(30)], "doc_id long, source string, text string")
    found = Counter(r["doc_id"] for r in mixing.mix(docs, {"rare": 1.0}, budget=float(rate)).collect())
    for i in range(30):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        cdf, k = math.exp(-rate), 0
        while cdf <= u:
            k += 1
            cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert found[i] == k


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD2 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
STANDARD = [
    (APACHE, ["Apache-2.0", "Apache-2.0-header"]), (MIT, ["MIT"]), ("MIT License\n\nCopyright 2020", ["MIT"]), (BSD2, ["BSD-2-Clause"]), (BSD3, ["BSD-2-Clause", "BSD-3-Clause"]),
    (GPL3, ["GPL", "GPL-3.0"]), (GPL2, ["GPL", "GPL-2.0"]), (LGPL, ["LGPL-2.1"]), (AGPL, ["AGPL-3.0"]), (MPL, ["MPL-2.0"]), (ISC, ["ISC"]),
]


def test_standard_licence_texts(spark):
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint x;",
             lambda t: "\n".join(f"# {x}" for x in t.split("\n")), lambda t: t if t.startswith(("MIT", "Copyright")) else " ".join(t.split())]
    rows = [(i * 10 + j, form(text), names) for i, (text, names) in enumerate(STANDARD) for j, form in enumerate(forms)]
    rows.append((-1, " ".join(BSD3[BSD3.index("Redistribution"):].split()), ["BSD-2-Clause", "BSD-3-Clause"]))
    rows.append((-2, GPL2 + "\n\n" + LGPL, ["GPL", "GPL-2.0", "LGPL-2.1"]))
    rows.append((-3, "Nobody licensed under\nthe MIT License would\nsay so.", []))
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert found == {i: names for i, _, names in rows}


def test_near_copies_by_jaccard_share(spark):
    rng = random.Random(3)
    rows, number = [], 0
    for size in (3, 8, 40, 120, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 9):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
                rows.append((number, " ".join(own)))
                number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, "  ")]
    firsts = brute.jaccard_groups([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert found == sorted(set(firsts))
    assert len(found) < len(rows)


def template_rows(n, own, copies):
    """Pages of one template with ``own`` words each, and near copies of some of them."""
    rng = random.Random(n)
    base = [f"t{i}" for i in range(92)]
    rows = [(i, " ".join(base[:40] + [f"o{i}x{j}" for j in range(own)] + base[40:])) for i in range(n)]
    for i in range(copies):
        w = rows[rng.randrange(n)][1].split()
        w[rng.choice([5, 60, 80])] = f"changed{i}"
        rows.append((n + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("own,meet", [(14, 1024), (30, 1024), (6, 40), (14, 40)])
def test_near_copies_among_pages_of_a_template(spark, monkeypatch, own, meet):
    monkeypatch.setattr(near, "MEET", meet)
    rows = template_rows(90, own, 25)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, root int").repartition(3)
    found = near.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(brute.jaccard_groups([t for _, t in rows])))


def test_template_pages_meet_by_what_is_their_own(spark):
    met = {}
    for n in (100, 400):
        rows = spark.createDataFrame(template_rows(n, 14, 0), "node long, text string").select("node", F.col("text").alias("body"))
        sets = rows.mapInArrow(near._sets(5), "node long, shingles binary")
        crowded = sets.select("node", (F.octet_length("shingles") / 4).cast("long").alias("n"), F.col("node").alias("root"))
        met[n] = near._rest(crowded, sets, 0.8).count()
    assert met == {100: 0, 400: 0}


def test_small_recall_of_the_keys():
    """Pairs of a share of just 0.8 are found by some key nearly always, and their fingerprints are let through."""
    import numpy as np
    from pagemill.llm.common import mixed
    rng = np.random.default_rng(1)
    met = let = 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])  # 400 of 500
        least = [[mixed(z, 100 + i).min() for i in range(near.TABLES * near.ROWS)] for z in (x, y)]
        met += any(least[0][i : i + near.ROWS] == least[1][i : i + near.ROWS] for i in range(0, near.TABLES * near.ROWS, near.ROWS))
        bits = [np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(z) for z in (x, y)]
        let += int((bits[0] != bits[1]).sum()) <= near.LIMIT
    assert met >= 298 and let >= 298
