"""What the corpus operators share: reading documents, row keys, hashes over byte columns, cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_dir, ship

#: A missing doc_id counts as the largest possible id.
NO_ID = 2**63 - 1
CHUNK_BYTES = 1 << 20

_U = np.uint64


#: Rows a batch between Spark and Python, where the session sets none: texts are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep batches of texts small."""
    ship(spark)
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(rows: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder: computed once and independent of any executor."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def order_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(name: str, *taken: list[str]) -> str:
    """``name``, with underscores in front until no given column is called so (names compare without case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches whose ``column`` holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(at)) + 1
        edges = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (a null is empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A full-avalanche 64-bit permutation of each value."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D inside each row: starts, ends, row of each, and the mask of their bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, inside


def span_hashes(values: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each of the spans that lie end to end in ``values`` (bytes)."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(begins, lengths)
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0xD1B54A32D192ED03) & (2**64 - 1) | 1
    table = mixed(powers(base, int(lengths.max())), seed) | _U(1)
    total = np.add.reduceat((values.astype(np.uint64) + _U(1)) * table[place], begins)
    return mixed(total ^ (lengths.astype(np.uint64) << _U(40)), seed)
