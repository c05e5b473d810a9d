"""Registered corpus queries: against DuckDB where SQL can say it, against plain versions, and on odd and empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import brute
import compare
from odd import SMALL, empty, odd, odd_rows, small_rows  # noqa: F401  fixtures
from pagemill.llm import queries

NAMES = [n for n in queries.QUERIES if n.startswith("op")]


def run(spark, name, where):
    return [tuple(r) for r in queries.QUERIES[name](spark, where).collect()]


def texts(odd_rows):
    return [(r[0], r[1]) for r in odd_rows]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    problem, n = compare.differences(spark, compare.connect(SMALL), SMALL, queries.QUERIES[name], queries.ORACLE[name])
    assert problem is None and n


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_empty_table(spark, empty, name):
    frame = queries.QUERIES[name](spark, empty)
    assert frame.columns and frame.collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op3_packing", "op6_mixing", "op11_prefix_trie", "op13_spelling")])
def test_a_row_for_each_row(spark, odd, odd_rows, name):
    found = run(spark, name, odd)
    assert Counter(r[0] for r in found) == Counter(r[0] for r in odd_rows)


def test_lines_of_odd_rows(spark, odd, odd_rows):
    expected = Counter((i, n, d, brute.sha(t)) for i, n, d, t in brute.lines(texts(odd_rows)))
    assert Counter(run(spark, "op1_line_dedup", odd)) == expected


def test_windows_of_odd_rows(spark, odd, odd_rows):
    assert Counter(run(spark, "op4_substring_dedup", odd)) == Counter(brute.windows(texts(odd_rows)))


@pytest.mark.parametrize("which", ["odd", "small"])
def test_components(spark, odd, odd_rows, small_rows, which):
    where, rows = (odd, texts(odd_rows)) if which == "odd" else (SMALL, small_rows)
    assert Counter(run(spark, "op7_simhash", where)) == Counter(brute.components(rows))


@pytest.mark.parametrize("which", ["odd", "small"])
def test_fingerprints(spark, odd, odd_rows, small_rows, which):
    where, rows = (odd, texts(odd_rows)) if which == "odd" else (SMALL, small_rows)
    found = queries.QUERIES["op2_fingerprints"](spark, where).collect()
    if which == "odd":  # rows of one id follow each other in an order of their own; the rest is fixed
        assert len(found) == len(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
        return
    order = sorted(rows, key=lambda r: -r[0])
    by = {r["doc_id"]: r for r in found}
    same = defaultdict(set)
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = by[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(changed))
        assert r["near_edited"] == pytest.approx(brute.likeness(text, changed), abs=1e-12)
        assert r["near_next"] == pytest.approx(brute.likeness(text, following), abs=1e-12)
        same[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_do_not_depend_on_ranges(spark):
    from pagemill.llm import fingerprints
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, many = (Counter(map(tuple, fingerprints.fingerprint_pairs(docs, n, piece=p).collect())) for n, p in ((1, 1 << 20), (17, 3000)))
    assert one == many


@pytest.mark.parametrize("which", ["odd", "small"])
def test_packing(spark, odd, odd_rows, small_rows, which):
    where, rows = (odd, texts(odd_rows)) if which == "odd" else (SMALL, small_rows)
    found = queries.QUERIES["op3_packing"](spark, where).collect()
    expected = Counter()
    for doc_id, text in rows:
        ids = brute.tokens(text)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[doc_id, piece, start, len(part), brute.crc(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r["length"] for r in found)
    assert -(-tokens // 2048) <= len(sequences) <= -(-tokens // 2048) * 1.02 + 1


def test_mixing_of_odd_rows(spark, odd, odd_rows):
    found = run(spark, "op6_mixing", odd)
    copies = Counter((r[0], r[1], r[2]) for r in found)
    assert {k[0] for k in copies} <= {r[0] for r in odd_rows}
    numbers = defaultdict(list)
    for r in found:
        numbers[r[0], r[1], r[2]].append(r[3])
    rows = Counter((r[0], r[3], r[1]) for r in odd_rows)
    for key, n in copies.items():
        each = n // rows[key]
        assert sorted(numbers[key]) == sorted(list(range(1, each + 1)) * rows[key])


def test_mixing_meets_its_weights(spark):
    from pagemill.llm import mixing
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'rare' END AS source", "repeat('x', 10) AS text")
    got = {r["source"]: r["n"] for r in mixing.mix(docs, {"big": 1, "mid": 1, "rare": 2}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(got.values())
    assert total == pytest.approx(400_000, rel=0.02)
    assert got["big"] / total == pytest.approx(0.25, abs=0.01) and got["rare"] / total == pytest.approx(0.5, abs=0.01)


def test_licences_in_order(spark):
    from pagemill.llm import licenses
    header = "Licensed under the Apache License, Version 2.0 (x).\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nwhatever\nYou may obtain a copy of the License at\nYOU MAY OBTAIN A COPY OF THE LICENSE AT http://www.apache.org/licenses/LICENSE-2.0"
    swapped = "This program is distributed in the hope that it will be useful, but without any warranty.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
    rows = licenses.scan(spark.createDataFrame([(1, header), (2, swapped), (3, None), (4, "Released under the MIT license. All rights reserved.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [["Apache-2.0", "Apache-2.0-header"], [], [], ["MIT"]]
    assert rows[0]["sentence_ids"] == ["apache-notice", "apache-compliance", "apache-copy"]
    assert rows[1]["sentence_ids"] == ["gpl-warranty", "gpl-redistribute"]


def test_languages_held_out(spark):
    found = queries.QUERIES["op5_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_languages_of_odd_rows(spark, odd):
    found = defaultdict(set)
    for r in queries.QUERIES["op5_language_id"](spark, odd).collect():
        found[r["doc_id"]].add((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1
    for doc_id in (1, 2, 9, 12):
        assert found[doc_id] == {("und", 0.0)}
    assert next(iter(found[10]))[0] != "und"


def test_language_scores_are_the_words_sums(spark):
    import math
    from pagemill.llm import language
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat sat the", "en"), ("die katze sass", "de"), ("the dog", "en")])], "doc_id long, text string, lang string")
    model = language.fit(docs)
    scorer = language.Scorer(model)
    en, de = model.languages.index("en"), model.languages.index("de")
    at = {w: i for i, w in enumerate(model.words)}
    sums = [sum(float(model.word_logs[at[w], i]) for w in ("the", "katze")) for i in range(2)]
    best, score = scorer.predict("The katze")
    assert best == model.languages[max(range(2), key=lambda i: sums[i])]
    assert score == pytest.approx(math.exp(max(sums)) / sum(map(math.exp, sums)), rel=1e-4)
    grams = {g: i for i, g in enumerate(model.grams)}
    known = [g for g in language.grams_of("katz", 4) if g in grams]
    assert scorer.backed_off("katz")[de] == pytest.approx(sum(float(model.gram_logs[grams[g], de]) for g in known) / len(known), rel=1e-5)
    assert scorer.backed_off("katz")[de] > scorer.backed_off("katz")[en]


def test_quality_against_labels_it_never_read(spark):
    where = "/root/testdata/sf0.01"
    found = queries.QUERIES["op9_quality"](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in found if r["quality"] == 1], [r for r in found if r["quality"] == 0]
    assert sum(r["keep"] for r in good) >= 0.99 * len(good)
    assert sum(not r["keep"] for r in bad) >= 0.9 * len(bad)


def test_weak_labels_find_the_accuracies():
    import numpy as np
    from pagemill.llm import quality
    rng = np.random.default_rng(5)
    n, k = 60_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.9
    hit = np.array([0.3, 0.4, 0.5, 0.6, 0.7, 0.35])
    votes = np.where(~good[:, None] & (rng.random((n, k)) < hit), quality.BAD, quality.GOOD)
    votes[rng.random((n, k)) < 0.1] = quality.NOTHING
    patterns, counts = np.unique(quality.patterns_of(votes), return_counts=True)
    labels = quality.Labels(patterns, counts.astype(float))
    assert labels.good == pytest.approx(0.9, abs=0.01)
    assert np.allclose(labels.shares[quality.BAD, :, quality.BAD], hit, atol=0.03)
    assert np.array_equal(quality.votes_in(quality.patterns_of(votes[:50])), votes[:50])


def test_media_of_odd_rows(spark, odd, odd_rows):
    import hashlib
    import zlib
    found = queries.QUERIES["op10_media"](spark, odd).collect()
    expected = Counter()
    for doc_id, text, *_ in odd_rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        expected[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == expected
    same = defaultdict(set)
    for r in found:
        same[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())
