"""Quality classifier by weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote
patterns (of all documents) estimates how often each labeller votes each way on good and on bad documents, and the
share of bad ones; no true label is used. The posterior of a pattern is the weak label of its documents. A logistic
scorer is then fitted to the weak labels, on hashed features: the shape of every word, and bins of the document's
statistics. It scores every whole text, and documents of a score under ``KEEP`` are rejected.

The patterns are at most 3 to the number of labellers, so their counts fit the driver at any size. The scorer's fit is
bounded by a documented parameter: about ``FIT_ROWS`` different texts, chosen by a hash over the whole table.

Defined cases: a null or empty text, or one without words, gets no votes; its score is the share of good documents,
so it is kept unless most are bad. Rows of one doc_id are judged one by one; a null doc_id stays null. An empty table
gives an empty result. Other columns are ignored by ``judge`` and passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, bytes_of, cut, documents, free_name, mixed, slices, span_hashes, word_spans

FIT_ROWS = 8_000
BUCKETS = 1024
#: Documents that score less are rejected: the odds against them are four to one.
KEEP = 0.2
MIN_WORDS = 5

#: Statistic, bad from, good up to; a labeller votes nothing in between.
LABELLERS = [
    ("marked_words", 0.20, 0.02),
    ("symbols", 0.06, 0.02),
    ("upper", 0.60, 0.30),
    ("bare_words", 0.15, 0.04),
    ("echoes", 0.30, 0.05),
    ("triples", 0.25, 0.04),
]
#: What is expected of a labeller before any vote is seen: the share of bad and of good documents it blames, and how much
#: that counts, as a share of the votes of the class. Both are estimated; a labeller that blames good documents is found out.
EXPECTED, PRIOR = (0.4, 0.002), 0.02
BAD, GOOD, NOTHING = 0, 1, 2

_LOWER, _UPPER, _DIGIT = ord("a"), ord("A"), ord("0")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _LOWER
_SHAPE[128:] = _LOWER  # letters beyond ASCII, byte by byte
_SHAPE[ord("A") : ord("Z") + 1] = _UPPER
_SHAPE[ord("0") : ord("9") + 1] = _DIGIT
_PROSE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r.,;:'\"()-?!", np.uint8)) | np.isin(_SHAPE, [_LOWER, _UPPER, _DIGIT])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measured(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, with_features: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of each text: its number of words, its statistics (a column each, in order of the labellers), its hashed features."""
    n = len(offsets) - 1
    starts, ends, rows, inside = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n)
    shapes = _SHAPE[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    lower, upper = per_text(shapes == _LOWER), per_text(shapes == _UPPER)
    odd = per_text(~_PROSE[data])
    sizes, begins = ends - starts, np.cumsum(ends - starts) - (ends - starts)
    plain = np.isin(shapes, [_LOWER, _UPPER, _DIGIT])
    stats = np.zeros((n, len(LABELLERS)))
    if len(starts):
        hashes = span_hashes(data[inside], sizes, 3)
        bare = np.add.reduceat(plain[inside].astype(np.int64), begins) == 0
        last = np.maximum(ends - 2, starts)
        marked = (sizes > 2) & (data[ends - 1] == data[last]) & ~plain[ends - 1] & (data[ends - 1] != ord("."))
        echo = np.zeros(len(starts), bool)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        triple = np.zeros(len(starts), bool)
        triple[2:] = echo[2:] & echo[1:-1]
        stats[:, 0] = _share(np.bincount(rows, weights=marked, minlength=n), words)
        stats[:, 3] = _share(np.bincount(rows, weights=bare, minlength=n), words)
        stats[:, 4] = _share(np.bincount(rows, weights=echo, minlength=n), words)
        stats[:, 5] = _share(np.bincount(rows, weights=triple, minlength=n), words)
    stats[:, 1] = _share(odd, np.diff(offsets))
    stats[:, 2] = _share(upper, lower + upper)
    if not with_features:
        return words, stats, None
    found = np.zeros((n, buckets), np.float32)
    if len(starts):
        shape = (span_hashes(shapes[inside], sizes, 4) % np.uint64(buckets)).astype(np.int64)
        flat = np.bincount(rows * buckets + shape, minlength=n * buckets).reshape(n, buckets)
        found += (flat / np.maximum(words, 1)[:, None]).astype(np.float32)
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * 10).astype(np.uint64), 9)
    for j in range(stats.shape[1]):
        at = (mixed(bins[:, j] + np.uint64(100 * (j + 1)), 5) % np.uint64(buckets)).astype(np.int64)
        found[np.arange(n), at] += 1
    found[words == 0] = 0
    return words, stats, found


def votes_of(words: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """A digit for each labeller."""
    out = np.full(stats.shape, NOTHING, np.int64)
    for j, (_, bad, good) in enumerate(LABELLERS):
        out[stats[:, j] >= bad, j] = BAD
        out[stats[:, j] <= good, j] = GOOD
    out[words < MIN_WORDS] = NOTHING
    return out


_BASE = 3 ** np.arange(len(LABELLERS))


def patterns_of(votes: np.ndarray) -> np.ndarray:
    return votes @ _BASE


def votes_in(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // _BASE % 3


class Labels:
    """What expectation-maximisation found: the share of good documents, and per labeller and class the shares of votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        votes = votes_in(patterns)
        self.good = 0.9
        expected = np.empty((2, len(LABELLERS), 2))
        expected[BAD], expected[GOOD] = ((x, 1 - x) for x in EXPECTED)
        self.shares = expected.copy()  # no vote says nothing
        for _ in range(rounds):
            good = self._posterior(votes)
            weight = np.stack([counts * (1 - good), counts * good])
            self.good = float((weight[GOOD].sum() + 1) / (counts.sum() + 2))
            for vote in (BAD, GOOD):
                self.shares[:, :, vote] = weight @ (votes == vote)
            self.shares += expected * (PRIOR * weight.sum(axis=1)[:, None, None] + 0.1)
            self.shares /= self.shares.sum(axis=2, keepdims=True)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(len(LABELLERS))
        logs = np.concatenate([np.log(self.shares), np.zeros((2, len(LABELLERS), 1))], axis=2)
        bad = np.log(1 - self.good) + logs[BAD][j, votes].sum(axis=1)
        good = np.log(self.good) + logs[GOOD][j, votes].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that documents of a pattern are good; without any vote, the share of good documents."""
        votes = votes_in(patterns)
        return np.where((votes == NOTHING).all(axis=1), self.good, self._posterior(votes))


class Scorer:
    """Logistic regression over hashed features, fitted to probabilities."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 1000, rate: float = 4.0, decay: float = 1e-6):
        self.weights = np.zeros(features.shape[1], np.float32)
        self.bias = float(np.log(prior / (1 - prior)))
        if not len(features):
            return
        # the two classes weigh alike, so that rare bad documents count
        weight = np.where(labels > 0.5, 0.5 / max((labels > 0.5).sum(), 1), 0.5 / max((labels <= 0.5).sum(), 1))
        speed = np.zeros_like(self.weights)
        for _ in range(rounds):
            error = (self(features) - labels) * weight
            speed = 0.9 * speed - rate * ((error @ features).astype(np.float32) + decay * self.weights)
            self.weights += speed

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -60, 60)))


def _observe(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            chosen = np.asarray(part["chosen"].to_numpy(zero_copy_only=False), bool)
            data, offsets = bytes_of(part["body"])
            words, stats, _ = measured(data, offsets, buckets, False)
            features: list[bytes | None] = [None] * len(chosen)
            if chosen.any():
                own, at = bytes_of(part["body"].filter(pa.array(chosen)))
                for i, row in zip(np.flatnonzero(chosen), measured(own, at, buckets)[2]):
                    features[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(patterns_of(votes_of(words, stats)), pa.int64()), pa.array(features, pa.binary())], names=["pattern", "features"])
    return run


def fit(docs: DataFrame, rows: int = FIT_ROWS, buckets: int = BUCKETS) -> tuple[Labels, Scorer]:
    """Weak labels from the vote patterns of all documents, and a scorer fitted to them on about ``rows`` documents."""
    n = docs.count()
    share = min(1.0, rows / max(n, 1))
    texts = docs.select(body().alias("body"), (F.pmod(F.xxhash64("doc_id", body(), F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * share)).alias("chosen"))
    seen = cut(texts.mapInArrow(_observe(buckets), "pattern long, features binary"))
    counted = seen.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** labellers at most
    labels = Labels(np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], np.float64))
    # about ``rows``: equal rows are chosen together, so each kind counts once
    sample = sorted(seen.where(F.col("features").isNotNull()).distinct().collect(), key=lambda r: (r["pattern"], bytes(r["features"])))
    features = np.array([np.frombuffer(r["features"], np.float32) for r in sample], np.float32).reshape(-1, buckets)
    patterns = np.array([r["pattern"] for r in sample], np.int64)
    return labels, Scorer(features, labels.posterior(patterns), labels.good)


def _judge(labels: Labels, scorer: Scorer, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            words, stats, features = measured(*bytes_of(part["body"]), len(scorer.weights))
            votes = votes_of(words, stats)
            score = np.where(words == 0, labels.good, scorer(features))
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array(score.astype(np.float64)), pa.array(score >= keep), pa.array(labels.posterior(patterns_of(votes))),
                pa.array(["".join("bg-"[v] for v in row) for row in votes])], names=["doc_id", "score", "keep", "weak_label", "votes"])
    return run


def judge(docs: DataFrame, labels: Labels, scorer: Scorer, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, keep, weak_label, votes) of every text: b, g or - for each labeller."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"))
    return rows.mapInArrow(_judge(labels, scorer, keep), "doc_id long, score double, keep boolean, weak_label double, votes string")


def keep_good(docs: DataFrame, labels: Labels, scorer: Scorer, keep: float = KEEP) -> DataFrame:
    """The documents that are not rejected, with all their columns as they are."""
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = []
            for part in slices([pa.RecordBatch.from_arrays([column], names=["body"])], "body"):
                words, _, features = measured(*bytes_of(part["body"]), len(scorer.weights))
                out.append(np.where(words == 0, labels.good, scorer(features)))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    scores.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(scores, "double")
    name = free_name("score", docs.columns)
    return docs.withColumn(name, score(body())).where(F.col(name) >= keep).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, *fit(docs))


#: The model is fitted, so the query is tested by accuracy on the labels, which it never reads.
ORACLE = None
