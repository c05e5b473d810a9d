"""Best-fit packing of token sequences: large pieces are matched in pairs, smaller ones fill the gaps.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers, however large the corpus):
pieces above a third of the capacity go alone or in pairs, greedily from the longest with the longest partner that
fits; then smaller pieces, from the longest, go to the sequence with the smallest gap that holds them. Sequences with
equal contents are planned as one run, so the plan is short intervals "pieces r to s of length l go to sequences from
q on, k in each, at offset o". Each piece gets its rank among the pieces of its length without a sort: a count within
its partition, plus the counts of earlier partitions. The plan's size is bounded by the capacity, not by the pieces.

Token ids are made per word (the tokenizer's rules never look across white space), with a bounded cache of words, and
whole texts are read. Strings of special tokens in a text are ordinary text.

Defined cases: a null or empty text is one piece with the closing id. Rows of one doc_id are packed one by one. A null
doc_id stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, documents, slices

CAPACITY = 2048
CLOSING = 0
#: Words a worker remembers before it starts anew.
REMEMBERED = 1_000_000


#: The tokenizer's own pattern of pieces within a word.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of visible characters below U+0250 are in normal form, but for U+0130 lower case keeps their number of characters.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


def _byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Token ids of texts, word by word; words are runs of bytes other than ASCII blanks.

    Words of plain characters are cut into pieces here and only the merging is the tokenizer's, piece by piece;
    any other word goes through the whole tokenizer. Both give the ids of the whole text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered = remembered
        self.characters = _byte_characters()
        self._forget()

    def _forget(self) -> None:
        self.marks: dict[str, list[int]] = {}  # pieces of one or two characters
        self.fresh: list[bytes] = []
        self.numbers = _Numbers(self.fresh)
        self.ids, self.begins, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _learn(self) -> None:
        words = b"\n".join(self.fresh).decode("utf-8")
        if _PLAIN.fullmatch(words.replace("\n", "")):
            found = list(map(self._plain, words.lower().split("\n")))
        else:
            found = list(map(self._word, words.split("\n")))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.begins = np.concatenate([self.begins, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += total
        self.fresh.clear()

    def _word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return self._plain(word.lower())

    def _plain(self, word: str) -> list[int]:
        if word.isalpha():
            return self._merged(word)
        out: list[int] = []
        for piece in _SPLIT.findall(word):
            ids = self.marks.get(piece)
            if ids is None:
                ids = self._merged(piece)
                if len(piece) < 3:
                    self.marks[piece] = ids
            out += ids
        return out

    def _merged(self, piece: str) -> list[int]:
        plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.tokenizer.model.tokenize(plain)]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.numbers) > self.remembered:
            self._forget()
        words = [t.encode("utf-8", "replace").split() for t in texts]
        numbers = [np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own)) for own in words]
        if self.fresh:
            self._learn()
        for own in numbers:
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out = np.empty(total + 1, "<u4")
            out[:total] = self.ids[np.repeat(self.begins[own] - ends + sizes, sizes) + np.arange(total)]
            out[total] = CLOSING
            yield out


class _Numbers(dict):
    """Numbers for words; a new word gets the next one and is noted."""

    def __init__(self, fresh: list[bytes]):
        super().__init__()
        self.fresh = fresh

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


_WORKER: dict[str, WordIds] = {}

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _WORKER.get(path) or _WORKER.setdefault(path, WordIds(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in slices(batches, "body"):
            docs, pieces, starts, lengths, sums, ids, places = [], [], [], [], [], [], []
            for doc_id, own in zip(rows["doc_id"].to_pylist(), ids_of.of(rows["body"].to_pylist())):
                for i, start in enumerate(range(0, len(own), capacity)):
                    raw = own[start : start + capacity].tobytes()
                    length = len(raw) // 4
                    docs.append(doc_id)
                    pieces.append(i)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(raw))
                    ids.append(raw if with_ids else None)
                    places.append(int(seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                pa.array(ids, pa.binary()), pa.array([part] * len(docs), pa.int32()), pa.array(places, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"])
    return run


class Plan:
    """Intervals of pieces by length; see the module's text."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.ranks = dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
        self.order: list[int] = []
        left = {n: c for n, c in counts.items() if c}
        third = capacity / 3
        self._match(sorted((n for n in left if n > third), reverse=True), left)
        for length in sorted((n for n in left if n <= third), reverse=True):
            self._fill(length, left[length])

    def _put(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.ranks[length], sequence, each, offset))
        self.ranks[length] += pieces

    def _open(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                insort(self.order, gap)
            self.gaps.setdefault(gap, []).append((sequence, n))

    def _match(self, large: list[int], left: dict[int, int]) -> None:
        rising = large[::-1]
        for length in large:
            while left[length]:
                at = bisect_left(rising, self.capacity - length + 1) - 1  # the longest that fits beside it
                while at >= 0 and not left[rising[at]]:
                    at -= 1
                mate = rising[at] if at >= 0 else None
                if mate == length:
                    pairs, single = divmod(left[length], 2)
                    if pairs:
                        self._put(length, 2 * pairs, self.sequences, 2, 0)
                        self._open(self.capacity - 2 * length, self.sequences, pairs)
                        self.sequences += pairs
                        left[length] = single
                        continue
                    while at >= 0 and (rising[at] == length or not left[rising[at]]):
                        at -= 1
                    mate = rising[at] if at >= 0 else None
                n = min(left[length], left[mate]) if mate is not None else left[length]
                self._put(length, n, self.sequences, 1, 0)
                if mate is not None:
                    self._put(mate, n, self.sequences, 1, length)
                    left[mate] -= n
                self._open(self.capacity - length - (mate or 0), self.sequences, n)
                self.sequences += n
                left[length] -= n

    def _fill(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.order, length)
            if at == len(self.order):
                n = -(-count // (self.capacity // length))
                self._open(self.capacity, self.sequences, n)
                self.sequences += n
                continue
            gap = self.order[at]
            runs = self.gaps[gap]
            sequence, n = runs.pop()
            if not runs:
                del self.gaps[gap]
                self.order.pop(at)
            each = gap // length  # the fullest sequence stays the best fit until it holds no more
            whole, offset = min(n, count // each), self.capacity - gap
            if whole:
                self._put(length, whole * each, sequence, each, offset)
                self._open(gap - each * length, sequence, whole)
                count -= whole * each
            rest = n - whole
            if rest and count and count < each:
                self._put(length, count, sequence + whole, count, offset)
                self._open(gap - count * length, sequence + whole, 1)
                whole, rest, count = whole + 1, rest - 1, 0
            self._open(gap, sequence + whole, rest)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


def _place(rows: np.ndarray):
    keys = (rows[:, 0] << 44) | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            step = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")),
                                              pa.array(row[:, 2] + step // row[:, 3]), pa.array(row[:, 4] + step % row[:, 3] * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece: where it starts in its document, its ids (little-endian unsigned 32-bit) and where it was put."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"))
    pieces = cut(rows.mapInArrow(_pieces(path, capacity, with_ids), _PIECE))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = np.array(sorted(Plan(found, capacity).rows), np.int64).reshape(-1, 5)
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.mapInArrow(_place(plan), _PLACED)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; a group is at most the capacity."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"), with_ids=False).drop("ids")


#: Tokens are not for SQL; the query is tested against brute force.
ORACLE = None
