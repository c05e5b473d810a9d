"""Language ID with word-first backoff.

Spark counts words and character n-grams per language over the labelled documents. A document's words are then
scored: a known word by its log frequency in each language; an unseen one by the longest n-grams of it (marked at
both ends) of which any is known, from ``LONGEST`` characters down to one, by the mean of their log frequencies. The
language with the largest sum wins; the score is its share of the likelihood.

The fit is bounded by a documented parameter: about ``FIT_ROWS`` labelled documents, chosen by a hash of the id over the
whole table. All their words and n-grams are kept, so the model is as large as so many documents make it. Words are what
lies between blanks (0x20, 0x09 to 0x0D), in the fit and in predictions. Every whole text is predicted.

Defined cases: a null text or one without a letter is ``und`` with score 0. Without any labelled document every
prediction is ``und``. Ties go to the language that sorts first. A text none of whose words says anything gets equal
shares. Rows of one doc_id are predicted one by one; a null doc_id hashes as the text ``null``.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import cut, documents, slices

FIT_ROWS = 20_000
LONGEST = 4
#: Unseen words a worker remembers before it starts anew.
REMEMBERED = 300_000
UNDETERMINED = "und"


def bucket(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % n


def fold(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()  # bytes split at 0x20 and 0x09-0x0D only


def grams_of(word: str, n: int) -> list[str]:
    """Runs of n characters of the word between its marks; the whole marked word if it is shorter."""
    marked = f" {word} "
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


class Model:
    """Log frequencies by language: a row for each known word, and for each known n-gram."""

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], longest: int = LONGEST):
        self.languages, self.longest = languages, longest
        self.words, self.word_logs = words
        self.grams, self.gram_logs = grams


def _logs(rows: DataFrame, key: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """All entries in their order, and their log frequencies in each language."""
    counts = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    found = rows.groupBy(key).agg(*counts).orderBy(key).toArrow()  # what the bounded fit holds
    table = np.stack([found[f"n{i}"].to_numpy() for i in range(len(languages))], axis=1).astype(np.float64) + 0.5
    return found[key].to_pylist(), np.log(table / table.sum(axis=0)).astype(np.float32)


def fit(labelled: DataFrame, rows: int = FIT_ROWS, longest: int = LONGEST) -> Model | None:
    """A model from (doc_id, text, lang); None if no row has a text and a language."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = known.count()
    if not n:
        return None
    if n > rows:  # a share of the hash range, not of the order
        known = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    counts = cut(known.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # at most ``rows``
    if not languages:
        return None
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (k - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(k)))

    pieces = counts.select("lang", "n", F.explode(F.concat(*map(runs, range(1, longest + 1)))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, _logs(counts, "word", languages), _logs(pieces, "gram", languages), longest)


class Scorer(dict):
    """Row numbers by word; an unseen word gets a row of its own from its n-grams."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.room = model, len(model.words) + remembered
        self.table = np.zeros((self.room, len(model.languages)), np.float32)
        self.table[: len(model.words)] = model.word_logs
        self.grams = dict(zip(model.grams, model.gram_logs))
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.update(zip((w.encode() for w in self.model.words), range(len(self.model.words))))

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[number] = self.backed_off(word.decode())
        return number

    def backed_off(self, word: str) -> np.ndarray:
        grams = self.grams
        for n in range(min(self.model.longest, len(word) + 2), 0, -1):
            found = [grams[g] for g in grams_of(word, n) if g in grams]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.model.languages), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        if len(self) > self.room:
            self._begin()
        numbers = [self[w] for w in fold(text)]
        total = self.table[numbers].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _WORKER.get(shared.id)
        if scorer is None and model is not None:
            _WORKER.clear()
            scorer = _WORKER[shared.id] = Scorer(model)
        for part in slices(batches, "text"):
            found = [scorer.predict(t) if scorer else (UNDETERMINED, 0.0) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    return run


_WORKER: dict = {}


class _Shared:
    """A broadcast model and a name for it, so that a worker builds its tables once."""

    def __init__(self, spark: SparkSession, model: Model | None):
        self.held = spark.sparkContext.broadcast(model)
        self.id = f"{spark.sparkContext.applicationId}-{self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(self.held)}"

    def __getstate__(self) -> dict:
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> Model | None:
        return self.held.value


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text; the model is bounded by its numbers of words and n-grams."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(_Shared(docs.sparkSession, model)), _OUT)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang").where(bucket(4) != 2)))


#: The model is fitted, so the query is tested by held-out accuracy and against brute-force scoring.
ORACLE = None
