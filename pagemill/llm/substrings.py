"""Substring dedup: a count-min sketch finds windows that may repeat, a second pass groups just those exactly.

Documents are dealt into blocks of a few MB. In a first pass each block sketches its windows: the cells it hits in
every row of a count-min sketch, as compressed sorted gaps, with a mark where the block itself hits a cell twice. The
sketch is cut into slices of cells; a slice merges what the blocks say (counts end at two) and answers each block with
one bit per cell it named. A cell never counts fewer windows than fall into it, so no repeated window is lost, and no
task or driver ever holds the whole sketch. In a second pass each block sends the digests of the windows whose cells
all count two or more, once each; slices of the digest space group them exactly and answer with one bit per digest.
A window that occurs in thousands of places is one digest per block, so no key makes a task large.

The width of the sketch follows the bytes of the input (``CELLS_PER_WINDOW``), so its share of false alarms is the
same at every size. Digests have 96 bits. Texts are shuffled once; all passes read the same exchange.

Defined cases: a null or empty text has no words. Rows of one doc_id are separate documents, so the windows of a
repeated row repeat. A null doc_id stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import CHUNK_BYTES, body, bytes_of, documents, mixed, partitions, powers, span_hashes, word_spans

WIDTH = 35
BLOCK_BYTES = 8 << 20
DEPTH = 2
CELLS_PER_WINDOW = 4
SLICE_CELLS = 1 << 22
#: Windows a slice of the digest space is laid out for.
SLICE_DIGESTS = 1 << 20
BYTES_PER_WORD = 6

_U = np.uint64
_Q = 0xD6E8FEB86659FD93
_Q_INVERSE = pow(_Q, -1, 2**64)


class Windows:
    """The windows of the documents of a block: two hashes each, the word they start at, and the words of each document."""

    def __init__(self, column: pa.Array, width: int):
        data, offsets = bytes_of(column)
        one, two, at, self.words, base, a, n = [], [], [], np.zeros(len(offsets) - 1, np.int64), 0, 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
            b = min(b, n)
            own = offsets[a : b + 1] - offsets[a]
            part = data[offsets[a] : offsets[b]]
            starts, ends, rows, inside = word_spans(part, own)
            self.words[a:b] = np.bincount(rows, minlength=b - a)
            if len(starts) >= width:
                first = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
                values, sizes = part[inside], ends - starts
                one.append(self._rolled(span_hashes(values, sizes, 1), first, width, 1))
                two.append(self._rolled(span_hashes(values, sizes, 2), first, width, 2).astype(np.uint32))
                at.append(first + base)
            base += len(starts)
            a = b
        self.one = np.concatenate(one) if one else np.zeros(0, np.uint64)
        self.two = np.concatenate(two) if two else np.zeros(0, np.uint32)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)

    @staticmethod
    def _rolled(words: np.ndarray, first: np.ndarray, width: int, seed: int) -> np.ndarray:
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_Q, len(words)), out=total[1:])
        return mixed((total[first + width] - total[first]) * powers(_Q_INVERSE, len(words))[first], seed)


def packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 and a bit each: gaps by byte planes, compressed."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(cells).to_bytes(4, "little") + zstandard.compress(planes + np.packbits(twice).tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    plain = np.frombuffer(zstandard.decompress(raw[4:]), np.uint8)
    gaps = np.ascontiguousarray(plain[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.int64), np.unpackbits(plain[4 * n :], count=n).astype(bool)


class Layout:
    """Sizes that follow from the bytes of the input."""

    def __init__(self, size: int, width: int, block_bytes: int, depth: int, cells_per_window: int, slice_cells: int, slice_digests: int):
        windows = max(size // BYTES_PER_WORD, 1)
        self.width, self.depth, self.slice_cells = width, depth, slice_cells
        self.blocks = max(1, -(-size // block_bytes))
        self.cells = max(64, cells_per_window * windows)
        self.digest_bits = max(0, (-(-windows // slice_digests) - 1).bit_length())

    def cells_of(self, own: Windows, row: int) -> np.ndarray:
        return (mixed(own.one, 10 + row) % _U(self.cells)).astype(np.int64)

    def cell_slices(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(slice, from, to) of sorted cells."""
        return _runs(cells // self.slice_cells)

    def digest_slices(self, one: np.ndarray) -> list[tuple[int, int, int]]:
        return _runs((one >> _U(64 - self.digest_bits)).astype(np.int64) if self.digest_bits else np.zeros(len(one), np.int64))


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_values):
        return []
    edges = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
    return [(int(sorted_values[a]), a, b) for a, b in zip(edges, edges[1:])]


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(raw), np.uint8), count=n).astype(bool)


_SKETCH = "row int, slice long, block int, cells binary"
_ANSWER = "block int, row int, slice long, bits binary"
_DIGESTS = "slice long, block int, one binary, two binary, twice binary"
#: The row of an answer about digests.
_EXACT = -1


def _sketch(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        own = Windows(table["body"].combine_chunks(), layout.width)
        rows, slices, cells = [], [], []
        for row in range(layout.depth):
            hit, times = np.unique(layout.cells_of(own, row), return_counts=True)
            for at, a, b in layout.cell_slices(hit):
                rows.append(row)
                slices.append(at)
                cells.append(packed(hit[a:b] - at * layout.slice_cells, times[a:b] > 1))
        return pa.table({"row": pa.array(rows, pa.int32()), "slice": pa.array(slices, pa.int64()), "block": pa.array([block] * len(rows), pa.int32()),
                         "cells": pa.array(cells, pa.binary())})
    return run


def _merge(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(layout.slice_cells, np.uint8)
        parts = [unpacked(raw) for raw in table["cells"].to_pylist()]
        for cells, twice in parts:
            count[cells] = np.minimum(count[cells] + 1 + twice, 2)
        return pa.table({"block": table["block"], "row": table["row"], "slice": table["slice"],
                         "bits": pa.array([_bits(count[cells] > 1) for cells, _ in parts], pa.binary())})
    return run


def _suspects(layout: Layout, own: Windows, answers: dict) -> np.ndarray:
    """Whether each window's cells all count two or more."""
    out = np.ones(len(own.one), bool)
    for row in range(layout.depth):
        cells = layout.cells_of(own, row)
        order = np.argsort(cells)
        cells = cells[order]
        fresh = np.ones(len(cells), bool)
        fresh[1:] = cells[1:] != cells[:-1]
        hit = cells[fresh]
        full = np.zeros(len(hit), bool)
        for at, a, b in layout.cell_slices(hit):
            full[a:b] = _flags(answers[row, at], b - a)
        out[order] &= full[np.cumsum(fresh) - 1]
    return out


def _distinct(own: Windows, suspects: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suspect windows by digest: their order, the number of the digest each has, and where each digest first stands."""
    which = np.flatnonzero(suspects)
    order = which[np.lexsort((own.two[which], own.one[which]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (own.one[order[1:]] != own.one[order[:-1]]) | (own.two[order[1:]] != own.two[order[:-1]])
    return order, np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def _answers(table: pa.Table) -> dict:
    return {(row, at): bits for row, at, bits in zip(*(table[c].to_pylist() for c in ("row", "slice", "bits")))}


def _digests(layout: Layout):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        slices, one, two, twice = [], [], [], []
        block = None
        if docs.num_rows:
            block = docs["block"][0].as_py()
            own = Windows(docs["body"].combine_chunks(), layout.width)
            order, number, first = _distinct(own, _suspects(layout, own, _answers(said)))
            h1, h2, more = own.one[order[first]], own.two[order[first]], np.bincount(number, minlength=len(first)) > 1
            for at, a, b in layout.digest_slices(h1):
                slices.append(at)
                one.append(h1[a:b].tobytes())
                two.append(h2[a:b].tobytes())
                twice.append(np.packbits(more[a:b]).tobytes())
        return pa.table({"slice": pa.array(slices, pa.int64()), "block": pa.array([block] * len(slices), pa.int32()),
                         "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary()), "twice": pa.array(twice, pa.binary())})
    return run


def _group(table: pa.Table) -> pa.Table:
    """Count every digest of a slice; a bit for each digest of each block."""
    parts = [np.frombuffer(raw, np.uint64) for raw in table["one"].to_pylist()]
    one, two = np.concatenate(parts), np.concatenate([np.frombuffer(raw, np.uint32) for raw in table["two"].to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(raw, np.uint8), count=len(p)) for raw, p in zip(table["twice"].to_pylist(), parts)])
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    number = np.cumsum(fresh) - 1
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(number, weights=1 + twice[order]) > 1)[number]
    edges = np.cumsum([0, *map(len, parts)])
    return pa.table({"block": table["block"], "row": pa.array([_EXACT] * len(parts), pa.int32()), "slice": table["slice"],
                     "bits": pa.array([_bits(repeated[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())})


def covered(starts: np.ndarray, words: int, width: int) -> np.ndarray:
    """Whether each of ``words`` words lies in a window that starts at one of ``starts`` (distinct)."""
    step = np.zeros(words + 1, np.int64)
    step[starts] += 1
    step[starts + width] -= 1
    return np.cumsum(step[:-1]) > 0


def _remove(layout: Layout):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        kept, removed, words = [], [], np.zeros(0, np.int64)
        if docs.num_rows:
            own, answers = Windows(docs["body"].combine_chunks(), layout.width), _answers(said)
            words = own.words
            order, number, first = _distinct(own, _suspects(layout, own, answers))
            full = np.zeros(len(first), bool)
            for at, a, b in layout.digest_slices(own.one[order[first]]):
                full[a:b] = _flags(answers[_EXACT, at], b - a)
            gone = covered(own.at[order[full[number]]], int(words.sum()), layout.width)
            edges = np.cumsum([0, *words.tolist()])
            for text, a, b in zip(docs["body"].to_pylist(), edges, edges[1:]):
                parts, mask = text.encode("utf-8", "replace").split(), gone[a:b]
                lost = int(mask.sum())
                kept.append(b" ".join(compress(parts, ~mask) if lost else parts).decode("utf-8"))
                removed.append(lost)
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    return run


def dedup_windows(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH, cells_per_window: int = CELLS_PER_WINDOW,
                  slice_cells: int = SLICE_CELLS, slice_digests: int = SLICE_DIGESTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text's words without those in windows that start elsewhere, too, joined by spaces."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(body()))).first()[0] or 0
    layout = Layout(size, width, block_bytes, depth, cells_per_window, slice_cells, slice_digests)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "body"), F.lit(layout.blocks)).cast("int"))
    blocks = rows.repartition(partitions(spark), "block")  # every pass reads this one exchange
    sketch = blocks.groupBy("block").applyInArrow(_sketch(layout), _SKETCH)
    said = sketch.groupBy("row", "slice").applyInArrow(_merge(layout), _ANSWER).repartition(partitions(spark), "block")
    digests = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_digests(layout), _DIGESTS)
    exact = digests.groupBy("slice").applyInArrow(_group, _ANSWER)
    both = said.unionByName(exact)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_remove(layout), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WIDTH - 1}], ' ')) AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM split)),
repeated AS (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE seq IN (SELECT seq FROM repeated)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
judged AS (
  SELECT w.doc_id, w.i, w.word,
         coalesce(max(s.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.i = s.i),
done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS lost, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
         FROM judged GROUP BY doc_id)
SELECT s.doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN done d ON s.doc_id = d.doc_id"""
