"""Parts of the corpus operators: plans, sketches, crowded buckets, JPEG scans, and the pipeline stage by stage."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import compare
import corpus_pipeline
from odd import SMALL, empty, odd, odd_rows, small_rows  # noqa: F401  fixtures
from pagemill.llm import fingerprints, jpeg, line_dedup, media, mixing, packing, simhash, substrings


def test_bitmaps_keep_first_lines(spark):
    docs = spark.createDataFrame([(1, "a long first line\nunique text here"), (2, "x\nA LONG FIRST LINE \ny"), (3, None)], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(docs).collect()
    assert [(r["did"], r["n_lines"], r["n_dropped"]) for r in rows] == [(2, 3, 1)]
    assert np.unpackbits(np.frombuffer(zlib.decompress(rows[0]["keep"]), np.uint8), count=3).tolist() == [1, 0, 1]


def test_a_hot_line_spreads_over_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('the very same hot line\nown line number ', id) AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = line_dedup.dedup_lines(docs).select("doc_id", "n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["doc_id"], r["n_dropped"]) for r in found} == {(i, int(i > 0)) for i in range(3000)}


def test_clashing_columns_pass_through(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert mixing.mix(docs).columns == [*docs.columns, "_copy", "shuffle_key"]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_plan_of_packing_places_every_piece():
    rng = random.Random(3)
    for capacity in (16, 100, 2048):
        for _ in range(30):
            counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400)))
            plan = packing.Plan(counts, capacity)
            rows = np.array(sorted(plan.rows), np.int64)
            used = defaultdict(list)
            for length, n in counts.items():
                own = rows[rows[:, 0] == length]
                for rank in range(n):
                    _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                    step = rank - first
                    used[sequence + step // each].append((offset + step % each * length, length))
            assert len(used) == plan.sequences
            for parts in used.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity
                assert sum(n > capacity / 3 for _, n in parts) <= 2


def test_sequences_hold_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    packed = packing.pack(docs, capacity=64)
    rows, whole = packed.collect(), {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    by = defaultdict(dict)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = bytes(whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])])
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.frombuffer(b"".join(by[doc_id][i] for i in range(len(by[doc_id]))), "<u4").tolist()
        assert ids == brute.tokens(text)


def test_sketches_never_lose_a_window(spark, small_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = Counter(brute.windows(small_rows, 10))
    for kwargs in ({}, {"cells_per_window": 1, "depth": 1, "block_bytes": 20_000, "slice_cells": 5000, "slice_digests": 2000}, {"cells_per_window": 0, "block_bytes": 50_000}):
        found = substrings.dedup_windows(docs, width=10, **kwargs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert Counter(map(tuple, found)) == expected


def test_likeness_is_the_exact_jaccard_share():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(200):
        parts = [f"paragraph {rng.randint(0, 300)}." for _ in range(rng.randint(0, 400))]
        left.append("\n".join(parts))
        right.append("\n".join(p for p in [*parts, *(f"new {rng.randint(0, 50)}" for _ in range(rng.randint(0, 60)))] if rng.random() < 0.9))
    left.append(" ".join(["a."] * 3000)), right.append(" ".join(["b."] * 10))
    got = fingerprints.likeness([fingerprints.paragraph_digests(t) for t in left], [fingerprints.paragraph_digests(t) for t in right])
    assert got.tolist() == pytest.approx([brute.likeness(a, b) for a, b in zip(left, right)], abs=1e-12)
    twin = [np.array([5, 5, 9], np.uint64)], [np.array([9], np.uint64)]  # equal digests cannot be peeled
    assert fingerprints.likeness(*twin)[0] == pytest.approx(1 / 3)


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    expected = {(min(a, b), max(a, b)) for a in near for b in near if a != b and (a ^ b).bit_count() <= 2}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in near], "fp long")
    for crowd in (2, 10_000):
        found = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.links(nodes, crowd=crowd).collect()}
        assert found == expected


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(i, i + 1) for i in range(100, 103)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.stars(edges).collect()}
    assert roots == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 104), 100)}


# --- JPEG: a plain encoder of any scan script, to test the decoder's general paths -------------------


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def raw(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


CODES = 8  # every symbol below 255 has the eight-bit code of its number, so no code is all ones


def segment(marker, part):
    return bytes([0xFF, marker]) + (len(part) + 2).to_bytes(2, "big") + part


def coded(w, size, value):
    w.put(value if value >= 0 else value + (1 << size) - 1, size)


def write_scan(w, blocks, first, last, high, low, runs):
    """One component's AC band, or DC, of (n, 64) zigzag coefficients."""
    shifted = lambda v: (abs(v) >> low) * (1 if v >= 0 else -1)
    if first == 0:
        before = 0
        for b in blocks:
            if high:
                w.put(int(b[0]) >> low & 1, 1)
                continue
            value = int(b[0]) >> low
            diff, before = value - before, value
            w.put(abs(diff).bit_length(), CODES)
            coded(w, abs(diff).bit_length(), diff)
        return
    waiting, later = 0, []

    def flush():
        nonlocal waiting, later
        if waiting:
            r = waiting.bit_length() - 1
            w.put(r << 4, CODES)
            w.put(waiting - (1 << r), r)
            w.bits += later
        waiting, later = 0, []

    for b in blocks:
        values = [shifted(int(v)) for v in b[first : last + 1]]
        if not high:
            ends = max([i for i, v in enumerate(values) if v], default=-1)
            if ends >= 0:
                flush()
            run = 0
            for v in values[: ends + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.put(0xF0, CODES)
                    run -= 16
                size = abs(v).bit_length()
                w.put(run << 4 | size, CODES)
                coded(w, size, v)
                run = 0
            if ends < len(values) - 1:
                waiting += 1
                if not runs or waiting == 32767:
                    flush()
            continue
        ends = max([i for i, v in enumerate(values) if abs(v) == 1], default=-1)
        if ends >= 0:
            flush()
        run, own = 0, []
        for i, v in enumerate(values):
            if i > ends:
                if abs(v) > 1:
                    own.append(abs(v) & 1)
            elif abs(v) > 1:
                own.append(abs(v) & 1)
            elif v:
                w.put(run << 4 | 1, CODES)
                w.put(int(v > 0), 1)
                w.bits += own
                run, own = 0, []
            else:
                run += 1
                if run == 16:  # not needed if all known: a run of sixteen zeros
                    w.put(0xF0, CODES)
                    w.bits += own
                    run, own = 0, []
        if ends < len(values) - 1 or run:
            waiting += 1
            later += own
            if not runs or waiting == 32767:
                flush()
    flush()


SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def write_grey(blocks, rows, columns, script=SCRIPT, runs=True, quantiser=1):
    table = bytes(255 if n == 8 else 0 for n in range(1, 17)) + bytes(range(255))
    out = [b"\xff\xd8", segment(0xDB, b"\x00" + bytes([quantiser]) * 64), segment(0xC2, b"\x08" + (rows * 8 - 3).to_bytes(2, "big") + (columns * 8 - 5).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
           segment(0xC4, b"\x00" + table), segment(0xC4, b"\x10" + table)]
    for first, last, high, low in script:
        w = Writer()
        write_scan(w, blocks, first, last, high, low, runs)
        out += [segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])), w.raw()]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("runs", [True, False])
def test_progressive_scans_rebuild_any_coefficients(runs):
    rng = np.random.default_rng(4)
    blocks = rng.integers(-40, 40, (12, 64)) * (rng.random((12, 64)) < 0.3)
    blocks[3] = 0
    blocks[5, 40:] = 0
    blocks[:, 0] = rng.integers(-500, 500, 12)
    image = jpeg.Image(write_grey(blocks, 3, 4, runs=runs))
    assert np.array_equal(image.components[0].blocks.reshape(-1, 64), blocks)
    assert image.rgb().shape == (21, 27, 3)


def test_inverse_transform_and_chroma():
    blocks = np.zeros((1, 64), np.int64)
    blocks[0, 0], blocks[0, 1] = 80, 40
    plane = jpeg.Image(write_grey(blocks, 1, 1, quantiser=2)).planes()[0]
    x = np.arange(8)
    expected = 128 + 160 / 8 + 80 / 4 * np.cos((2 * x + 1) * np.pi / 16) / np.sqrt(2)
    assert np.array_equal(plane[0], np.rint(expected)) and (plane == plane[0]).all()
    image = jpeg.Image(jpeg.store(b"x" * 576))
    assert [p.shape for p in image.planes()] == [(image.down * 16, image.across * 16)] + [(image.down * 8, image.across * 8)] * 2
    assert image.rgb().shape == (image.height, image.width, 3)


def test_bytes_survive_storing():
    rng = np.random.default_rng(8)
    for n in (1, 575, 576, 577, 6 * 63, 40_000):
        raw = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert jpeg.stored(jpeg.Image(jpeg.store(raw))) == raw


def test_unreadable_files_are_rows(spark):
    files = spark.createDataFrame([(1, bytearray(b"no jpeg")), (2, None), (3, bytearray(jpeg.store(b"abc"))), (4, bytearray(jpeg.store(b"abc")[:200]))], "id long, media binary")
    rows = {r["id"]: r for r in media.read_media(files).collect()}
    assert rows[1]["problem"] and rows[2]["problem"] and rows[4]["problem"] and rows[1]["rgb"] is None
    assert rows[3]["problem"] is None and len(rows[3]["rgb"]) == rows[3]["height"] * rows[3]["width"] * 3


# --- pipeline ---------------------------------------------------------------------------------------


def stages(spark, where, tmp):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], where).write.parquet(f"{tmp}/{i}")
        out.append(spark.read.parquet(f"{tmp}/{i}"))
    return out


@pytest.mark.parametrize("which", ["odd", "small"])
def test_pipeline_stages(spark, odd, tmp_path, which):
    where = odd if which == "odd" else SMALL
    docs, good, lined, single, mixed, packed = stages(spark, where, tmp_path)
    assert good.columns == lined.columns == single.columns == mixed.columns == docs.columns
    pairs = lambda frame: [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    # quality: only rows of the input, the labelled good ones all there
    assert not Counter(pairs(good)) - Counter(pairs(docs))
    if which == "small":
        labels = spark.read.parquet(f"{where}/labels.parquet").where("quality = 1")
        assert labels.join(good, "doc_id", "left_anti").count() == 0
    # lines
    assert Counter(pairs(lined)) == Counter((i, t) for i, _, _, t in brute.lines(pairs(good)))
    # near-copies: one row of each group by Jaccard share, of the smallest id
    rows = pairs(lined)
    groups = defaultdict(list)
    for (doc_id, _), root in zip(rows, brute.jaccard_groups([t for _, t in rows])):
        groups[root].append(brute.number(doc_id))
    assert Counter(brute.number(i) for i, _ in pairs(single)) == Counter(min(ids) for ids in groups.values())
    # copies: the operator's SQL on the stage's input
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    expected = Counter((r[0], r[1]) for r in con.execute(f"SELECT doc_id, text FROM ({mixing.ORACLE})").fetchall())
    assert Counter(pairs(mixed)) == expected
    # sequences: every token of every copy once
    tokens = Counter()
    for i, t in pairs(mixed):
        tokens[i] += len(brute.tokens(t))
    got = Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == tokens


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
