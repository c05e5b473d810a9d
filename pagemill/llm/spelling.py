"""Spelling variant grouping: words one edit apart, found by dynamic programming over sorted lists.

Two words one edit apart, the shorter of m code points, share their first or their last floor(m / 2) of them. So each
word goes into the lists of its halves, forwards and backwards, for m its length and one less. A list is sorted, and
all its words are looked up in it together: each holds, for the range of words that share a prefix, the three cells of
the edit matrix's last row that lie on the band. Ranges are read off the common prefixes of neighbours: a row is
computed once for a range, its words reuse it, and a range whose row exceeds one edit is skipped as a whole. A pair
that shares both halves counts in the forward list only, so each pair is found once.

A list of more than ``CROWD`` words is not brought together: there, words meet by equality of what is left when the
code point at a place behind the shared half is taken out, and each such meeting is a pair of near words. Occurrences
are summed in tasks before anything is shuffled, and the roots are reached by doubling steps over the forms.

Defined cases: a null or empty text has no words. A null doc_id is the empty text in the hash that damages words; rows
of one doc_id are separate texts. Repeated rows count again. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, documents, partitions, slices

DAMAGE = 199
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Lists of more words than this are met by equality instead.
CROWD = 100_000
#: Words that are looked up together, and distinct words a task sums before it sends them.
CHUNK, SUMMED = 20_000, 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def damaged(word: str, start: int, every: int = DAMAGE) -> str:
    """The word as it counts in a text: one code point is lost where the hash says so; ``start`` is the CRC of ``<doc_id>:``."""
    if every:
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            return word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def _counted(every: int, min_chars: int):
    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for whole in batches:
            for part in slices([whole], "body"):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["body"].to_pylist()):
                    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                    own = Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode()))  # bytes lose A-Z only
                    for word, n in own.items():
                        if len(word) >= min_chars and len(word := damaged(word, start, every)) >= min_chars:
                            total[word] += n
                if len(total) > SUMMED:
                    yield batch(total)
                    total = Counter()
        yield batch(total)
    return run


def vocabulary(docs: DataFrame, every: int = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` code points that occur ``min_count`` times in all texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"))
    counts = texts.mapInArrow(_counted(every, min_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class SortedList:
    """Sorted distinct words of several groups, one behind the other; the words of a group share ``half`` code points."""

    def __init__(self, words: list[str], groups: np.ndarray, half: np.ndarray):
        raw = [w.encode("latin-1") for w in words]  # a byte for each code point
        self.length = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
        self.rows, self.groups, self.half = len(words), groups, half
        edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.begin = edges[np.cumsum(np.bincount(edges, minlength=self.rows)) - 1]
        self.end = np.concatenate([edges[1:], [self.rows]])[np.cumsum(np.bincount(edges, minlength=self.rows)) - 1]
        self._ranges()

    def _ranges(self) -> None:
        """``starts``: depth * rows + row for each row that differs from the one before it within its first ``depth`` code points."""
        same = np.zeros(self.rows, np.int64)  # common prefix with the row before
        alive = np.flatnonzero(np.concatenate([[False], self.groups[1:] == self.groups[:-1]]))
        while len(alive):
            d = same[alive]
            fits = (d < self.length[alive]) & (d < self.length[alive - 1])
            alive, d = alive[fits], d[fits]
            alive = alive[self.flat[self.at[alive] + d] == self.flat[self.at[alive - 1] + d]]
            same[alive] += 1
        count = self.length - same
        row = np.repeat(np.arange(self.rows), count)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(same, count) + 1
        self.starts = np.sort(depth * self.rows + row)

    def char(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < self.length[row])
        return np.where(inside, self.flat[np.minimum(self.at[row] + np.maximum(place, 0), len(self.flat) - 1)], 0)  # no word holds 0

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): rows of one group at exactly one edit."""
        query = np.arange(self.rows)
        low, high, t = self.begin.copy(), self.end.copy(), self.half.copy()
        # cells of the row for a prefix of t code points: against t - 1, t and t + 1 of the query's; 2 stands for more
        left, mid = np.ones(self.rows, np.int8), np.zeros(self.rows, np.int8)
        right = np.where(t < self.length, 1, 2).astype(np.int8)
        queries, words = [], []
        while len(query):
            gap = self.length[query] - t
            ends = self.length[low] == t
            cell = np.select([gap == -1, gap == 0, gap == 1], [left, mid, right], 2)
            hit = ends & (cell == 1)
            queries.append(query[hit])
            words.append(low[hit])
            a = np.searchsorted(self.starts, (t + 1) * self.rows + low)
            b = np.searchsorted(self.starts, (t + 1) * self.rows + high)
            count = b - a
            item = np.repeat(np.arange(len(query)), count)
            child = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + a[item]
            first = self.starts[child] - (t[item] + 1) * self.rows
            last = np.concatenate([first[1:], [0]])
            final = child + 1 == b[item]
            last[final] = high[item][final]
            query, t = query[item], t[item]
            c = self.char(first, t)
            up_left, up_mid, up_right = left[item], mid[item], right[item]
            left = np.minimum(up_left + (c != self.char(query, t - 1)), up_mid + 1)
            mid = np.minimum(np.minimum(up_mid + (c != self.char(query, t)), up_right + 1), left + 1)
            right = np.minimum(up_right + (c != self.char(query, t + 1)), mid + 1)
            n = self.length[query]
            mid, right = np.where(t + 1 > n, 2, mid), np.where(t + 2 > n, 2, right)
            left = np.where(t > n, 2, left)
            alive = np.minimum(np.minimum(left, mid), right) <= 1
            query, low, high, t = query[alive], first[alive], last[alive], t[alive] + 1
            left, mid, right = (np.minimum(x[alive], 2).astype(np.int8) for x in (left, mid, right))
        return np.concatenate(queries), np.concatenate(words)


def _look_up(rows: list[tuple]) -> tuple[list, list, list, list]:
    """Whole groups of sorted (back, m, word as it is read, n): per word its near words' number, and the first by (n, word)."""
    back, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    half, words, n = m // 2, [r[2] for r in rows], np.array([r[3] for r in rows])
    keys = [(b, k, w[:h]) for b, k, w, h in zip(back.tolist(), m.tolist(), words, half.tolist())]
    groups = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])
    query, other = SortedList(words, groups, half).near()
    plain = [w[::-1] if b else w for w, b in zip(words, back.tolist())]
    keep = np.minimum(np.array([len(w) for w in words])[query], np.array([len(w) for w in words])[other]) == m[query]
    query, other = query[keep], other[keep]
    keep = [not back[q] or plain[q][: half[q]] != plain[w][: half[w]] for q, w in zip(query.tolist(), other.tolist())]
    query, other = query[keep], other[keep]
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=plain.__getitem__)] = np.arange(len(rows))
    order = np.lexsort((rank[other], -n[other], query))
    query, other = query[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    found = np.diff([*first.tolist(), len(query)])
    return [plain[q] for q in query[first].tolist()], found.tolist(), n[other[first]].tolist(), [plain[w] for w in other[first].tolist()]


_FOUND = "word string, n_near long, near_n long, near string"


def _scan(chunk: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = _look_up(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        group = lambda r: (r[0], r[1], r[2][: r[1] // 2])
        for rows in batches:
            for row in zip(rows["back"].to_pylist(), rows["m"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist()):
                if len(waiting) >= chunk and group(row) != group(waiting[-1]):
                    yield batch(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield batch(waiting)
    return run


def _met(crowded: DataFrame) -> DataFrame:
    """The near words of crowded lists, by equality behind one deletion; rows as ``_FOUND``, one for each pair."""
    crowded = crowded.withColumn("size", F.char_length("word"))
    without = crowded.withColumn("place", F.explode(F.sequence(F.char_length("half"), F.col("size") - 1)))
    without = without.withColumn("rest", F.concat(F.expr("left(word, place)"), F.expr("substr(word, place + 2)")))
    own = ["back", "m", "half"]
    same = without.where("size = m").select(*own, "place", "rest", "word", "n")
    other = same.select(*own, "place", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = same.join(other, [*own, "place", "rest"]).where("word <> near").select(*own, "word", "n", "near", "near_n")
    longer = without.where("size = m + 1").select(*own, F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("rest").alias("word")).distinct()
    shorter = crowded.where("size = m").select(*own, "word", "n")
    grown = shorter.join(longer, [*own, "word"]).select(*own, "word", "n", "near", "near_n")
    pairs = replaced.unionByName(grown).unionByName(grown.select(*own, F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    plain = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")]
    plainly = pairs.select("back", F.char_length("half").alias("k"), *plain, "near_n")
    return plainly.where("NOT back OR left(word, k) <> left(near, k)").select("word", F.lit(1).cast("long").alias("n_near"), "near_n", "near")


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, near_n, near) of each of the distinct ``words`` (word, n) that has near words; ``near`` is the one of largest n, then the first."""
    size = F.char_length("word")
    ways = F.array(*[F.struct(F.lit(back).alias("back"), (size - less).cast("int").alias("m")) for back in (False, True) for less in (0, 1)])
    listed = words.select("word", "n", F.inline(ways)).where(F.col("m") >= min_chars)
    listed = listed.withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    listed = cut(listed.withColumn("half", F.expr("left(word, m div 2)")).select("back", "m", "half", "word", "n"))
    own = ["back", "m", "half"]
    crowds = cut(listed.groupBy(*own).count().where(F.col("count") > crowd).select(*own))
    some = not crowds.isEmpty()
    loose = listed.join(crowds, own, "left_anti") if some else listed
    found = loose.repartition(partitions(words.sparkSession), *own).sortWithinPartitions(*own, "word").select("back", "m", "word", "n").mapInArrow(_scan(chunk), _FOUND)
    if some:
        found = found.unionByName(_met(listed.join(crowds, own, "left_semi")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each step doubles how far a word has come, and n grows along the way."""
    now = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moves")))
        if moved.where("moves").isEmpty():
            return now
        now = moved.select("word", "root")


def variants(docs: DataFrame, every: int = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the texts, the frequent word it may be a variant of, and where forms lead."""
    words = cut(vocabulary(docs, every, min_chars, min_count))
    known = words.join(near_words(words, min_chars, crowd, chunk), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = cut(known.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")))
    return known.join(roots(known), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS crc FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
coded AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS code FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
                                 lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crcs),
kept AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
without AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
grown AS (SELECT DISTINCT s.word, s.n, w.word AS near, w.n AS near_n FROM words s JOIN without w ON w.rest = s.word),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, near, near_n FROM grown UNION ALL SELECT near, word, n FROM grown),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
known AS (
  SELECT w.word, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (SELECT word, word AS root, form AS ahead FROM known UNION ALL SELECT f.word, f.ahead, k.form FROM follow f JOIN known k ON k.word = f.ahead)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n FROM known k JOIN follow f ON f.word = k.word AND f.ahead IS NULL"""
