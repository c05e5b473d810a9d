"""Document fingerprints: invertible Bloom lookup sketches over paragraphs.

A paragraph is a line, or a sentence of one (it ends at a line end, or at a stop mark that a blank follows). The k-th
repetition of a paragraph counts as a paragraph of its own, so a sketch holds a multiset. A sketch has three rows of
cells; each paragraph digest goes to one cell of every row, and a cell keeps a count, the XOR of its digests and the
XOR of their check values. Two sketches of one size are subtracted cell by cell, and the difference is peeled: a cell
with count 1 or -1 and a fitting check value gives up its digest, which then leaves its other cells. If cells remain,
both sketches are made again, larger and with other hashes, until the peeling ends with none. The recovered digests
give the exact differing paragraphs; likeness is the Jaccard share of the two multisets.

All documents of a piece of a batch are built, subtracted and peeled together in numpy. A document and its neighbour
in order of doc_id meet by range: quantiles of the ids cut the table, each range gets a copy of the next one's first
document, and a sorted range is streamed with one document held back. Texts move once.

Defined cases: a null text is empty; an empty text has no paragraphs, and two of them are alike (1.0). A null doc_id
comes last in descending order; rows of one doc_id are ordered by their text. A single document is its own
neighbour. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, documents, mixed, partitions

ROWS = 3
#: Cells a row of a stored fingerprint, and of the first try at a difference.
WIDTH = 8

_PARTS = re.compile(r"\n|(?<=[.!?])[ \t]+")
_U = np.uint64


def paragraph_digests(text: str) -> np.ndarray:
    """A digest for each paragraph; repetitions get digests of their own."""
    seen: dict[str, int] = {}
    digests, times = [], []
    for part in _PARTS.split(text):
        if part:
            seen[part] = again = seen.get(part, 0) + 1
            digests.append(xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace")))
            times.append(again)
    return mixed(np.array(digests, np.uint64) ^ mixed(np.array(times, np.uint64), 7), 8)


def _places(digests: np.ndarray, widths: np.ndarray, begins: np.ndarray, seed: int) -> np.ndarray:
    """(ROWS, n) cell numbers; ``widths`` and ``begins`` are those of each digest's sketch."""
    return np.stack([begins + widths * row + (mixed(digests, seed * ROWS + row + 1) % widths.astype(np.uint64)).astype(np.int64) for row in range(ROWS)])


class Sketches:
    """Sketches of many documents, end to end: ``widths`` cells a row each."""

    def __init__(self, digests: np.ndarray, owner: np.ndarray, widths: np.ndarray, seed: int = 0):
        self.widths, self.seed = widths, seed
        self.begins = np.cumsum(widths * ROWS) - widths * ROWS
        cells = int((widths * ROWS).sum())
        self.count, self.key, self.check = np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint32)
        self._put(digests, owner, np.ones(len(digests), np.int32))

    def _put(self, digests: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        if not len(digests):
            return
        at = _places(digests, self.widths[owner], self.begins[owner], self.seed).ravel()
        np.add.at(self.count, at, np.tile(sign, ROWS))
        np.bitwise_xor.at(self.key, at, np.tile(digests, ROWS))
        np.bitwise_xor.at(self.check, at, np.tile(check_values(digests), ROWS))

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.widths, out.seed, out.begins = self.widths, self.seed, self.begins
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, owners, signs) recovered, and whether each sketch came out empty."""
        cell_owner = np.repeat(np.arange(len(self.widths)), self.widths * ROWS)
        found, owners, signs = [], [], []
        look = np.flatnonzero(self.count != 0)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (check_values(self.key[look]) == self.check[look])]
            if not len(pure):
                break
            owner, key, sign = cell_owner[pure], self.key[pure], self.count[pure].copy()
            order = np.lexsort((key, owner))  # a digest may show in several cells at once
            owner, key, sign = owner[order], key[order], sign[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            owner, key, sign = owner[fresh], key[fresh], sign[fresh]
            self._put(key, owner, -sign)
            found.append(key)
            owners.append(owner)
            signs.append(sign)
            look = np.unique(_places(key, self.widths[owner], self.begins[owner], self.seed).ravel())
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = np.ones(len(self.widths), bool)
        done[cell_owner[left]] = False
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(found, np.uint64), join(owners, np.int64), join(signs, np.int32), done

    def text(self, i: int) -> str:
        a = int(self.begins[i])
        b = a + int(self.widths[i]) * ROWS
        return base64.b64encode(self.count[a:b].astype("<i4").tobytes() + self.key[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()).decode()


def check_values(digests: np.ndarray) -> np.ndarray:
    return (mixed(digests, 99) >> _U(32)).astype(np.uint32)


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.repeat(np.arange(len(parts)), sizes)


def differences(left: list[np.ndarray], right: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """How many paragraphs each left document has more than its right one, and fewer; sketches grow until all are recovered."""
    n = len(left)
    more, fewer = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size_l, size_r = (np.fromiter(map(len, x), np.int64, n) for x in (left, right))
    # the difference is at least that of the counts, so smaller sketches than for that cannot succeed
    widths = np.maximum(width, (np.abs(size_l - size_r) + ROWS - 1) // ROWS)
    todo, attempt = np.arange(n), 0
    while len(todo):
        own = widths[todo]
        sketch = [Sketches(*flat([side[i] for i in todo]), own, attempt) for side in (left, right)]
        _, owner, sign, done = sketch[0].minus(sketch[1]).peel()
        plus, minus = (np.bincount(owner[sign == s], minlength=len(todo)) for s in (1, -1))
        more[todo[done]], fewer[todo[done]] = plus[done], minus[done]
        todo, attempt = todo[~done], attempt + 1
        widths[todo] *= 3
        for i in todo[widths[todo] > 16 * (size_l + size_r)[todo] + 64 * width]:  # two paragraphs of one text with one digest: count without peeling
            kinds, signs = np.unique(np.concatenate([left[i], right[i]]), return_inverse=True)
            balance = np.bincount(signs, weights=np.repeat([1, -1], [size_l[i], size_r[i]]), minlength=len(kinds))
            more[i], fewer[i] = balance[balance > 0].sum(), -balance[balance < 0].sum()
            todo = todo[todo != i]
    return more, fewer


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard share of the paragraph multisets; 1 for two without paragraphs."""
    more, fewer = differences(left, right)
    total = np.fromiter(map(len, left), np.int64, len(left)) + fewer  # paragraphs of either
    common = total - more - fewer
    return np.where(total == 0, 1.0, common / np.maximum(total, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """All of ``texts`` but the last, each with the one behind it; ``ids`` has one less."""
    n = len(ids)
    digests = [paragraph_digests(t) for t in texts]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    changed_digests = [paragraph_digests(t) for t in changed]
    base = np.full(n, WIDTH, np.int64)
    own, other = Sketches(*flat(digests[:n]), base), Sketches(*flat(changed_digests), base)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
        pa.array([own.text(i) for i in range(n)]), pa.array([other.text(i) for i in range(n)]),
        pa.array(likeness(digests[:n], changed_digests)), pa.array(likeness(digests[:n], digests[1:]))], schema=_OUT)


def _stream(piece: int):
    """Sorted by (range, edge, ...): each document with the one behind it, within a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, closed, ids, texts, size = None, False, [], [], 0
        for batch in batches:
            for at, edge, did, text in zip(*(batch[c].to_pylist() for c in ("part", "edge", "doc_id", "body"))):
                if at != where:  # a new range: what is held back belonged to one without an edge row
                    where, closed, ids, texts, size = at, False, [], [], 0
                if closed:
                    continue
                texts.append(text)
                size += len(text)
                if edge:  # the first document of the next range: only the first such row counts
                    if ids:
                        yield _compare(ids, texts)
                    closed, ids, texts, size = True, [], [], 0
                    continue
                if size > piece and ids:
                    yield _compare(ids, texts)
                    ids, texts, size = [], texts[-1:], len(text)
                ids.append(did)
    return run


def neighbours_by_range(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, edge, doc_id, row_hash, body): the documents in ranges of descending doc_id, each range followed by the first document of the next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
                       F.xxhash64(body()).alias("row_hash"), body().alias("body"))
    spots = [i / ranges for i in range(1, ranges)]
    stats = rows.agg(F.max("did").alias("top"), F.percentile_approx("did", spots, 100 * ranges).alias("cuts") if spots else F.array().alias("cuts")).first()
    heads = sorted({stats["top"], *(stats["cuts"] or [])} - {None}, reverse=True)  # first ids of the ranges; quantiles are ids of the table
    up = F.array(*[F.lit(x).cast("long") for x in reversed(heads)]) if heads else F.array(F.lit(0).cast("long"))
    # the number of heads that are larger or equal, less one
    part = (F.size(F.filter(up, lambda h: h >= F.col("did"))) - 1).cast("int")
    n = max(len(heads), 1)
    homes = F.when(F.array_contains(up, F.col("did")), F.array(F.struct(part.alias("part"), F.lit(False).alias("edge")), F.struct(F.pmod(part - 1, F.lit(n)).alias("part"), F.lit(True).alias("edge")))
                   ).otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("edge"))))
    dealt = rows.select("*", F.inline(homes))
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "edge", F.col("did").desc(), "row_hash").select("part", "edge", "doc_id", "body")


def fingerprint_pairs(docs: DataFrame, ranges: int | None = None, piece: int = 1 << 20) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next document's."""
    return neighbours_by_range(docs, ranges or partitions(docs.sparkSession)).mapInArrow(_stream(piece), _OUT_SQL)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir).select("doc_id", "text"))


#: Sketches are not for SQL; the query is tested against brute force.
ORACLE = None
