"""Media columns: progressive JPEG files as a binary column, read back into coefficients, RGB tensors and features.

Texts become files (``store_texts``) and any progressive JPEG becomes tensors and features (``read_media``). Each file
is a row of its own, so work spreads over rows and nothing is shuffled.

Defined cases: a null text is empty; an empty one is stored as one unit of padding. A null file, or one that cannot be
read, gives null columns and the reason in ``problem``. Repeated rows get equal results. A null doc_id stays null. An
empty table gives an empty result. Other columns are ignored by the query and passed through by ``read_media``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import jpeg
from pagemill.llm.common import body, documents, free_name, slices

UNIT = 576


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """The bytes with bytes 255 behind them, up to a positive multiple of ``unit``."""
    return raw + b"\xff" * ((-len(raw)) % unit or (0 if raw else unit))


def features(rgb: np.ndarray) -> str:
    """Size, and mean and standard deviation of each channel, from exact sums."""
    n = rgb.shape[0] * rgb.shape[1]
    flat = rgb.reshape(-1, 3).astype(np.int64)
    one, two = flat.sum(axis=0).tolist(), (flat * flat).sum(axis=0).tolist()
    parts = [f"{a / n:.4f}~{(max(b * n - a * a, 0) ** 0.5) / n:.4f}" for a, b in zip(one, two)]
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ";".join(parts)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "body"):
        raw = [t.encode("utf-8", "replace") for t in part["body"].to_pylist()]
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array([jpeg.store(padded(r)) for r in raw], pa.binary())],
                                         names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a progressive JPEG."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_MADE = {"height": "int", "width": "int", "rgb": "binary", "feature": "string", "payload": "binary", "problem": "string"}


def _read_one(raw: bytes | None, with_rgb: bool, with_payload: bool) -> tuple:
    if raw is None:
        return None, None, None, None, None, "no file"
    try:
        image = jpeg.Image(raw)
        rgb = image.rgb()
        return rgb.shape[0], rgb.shape[1], rgb.tobytes() if with_rgb else None, features(rgb), jpeg.stored(image) if with_payload else None, None
    except Exception as problem:  # whatever is wrong with a file is said in its own row
        return None, None, None, None, None, f"{type(problem).__name__}: {problem}"


def _read(names: list[str], at: int, with_rgb: bool, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string()]
        for part in slices(batches, names[at]):
            rows = [_read_one(raw, with_rgb, with_payload) for raw in part.column(at).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *_MADE])
    return run


def read_media(files: DataFrame, media: str = "media", with_rgb: bool = True, with_payload: bool = False) -> DataFrame:
    """The rows with height, width, the RGB tensor (rows, columns, channels; bytes), features, ``problem`` and, if asked for, the stored payload.

    All columns stay; where one is called like a new one, the new one gets an underscore in front.
    """
    own, added = files.columns, [free_name(c, files.columns) for c in _MADE]
    # inner names are positional, so that odd or clashing names never matter
    inner = [f"c{i}" for i in range(len(own))]
    kinds = [f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, files.schema.fields)] + [f"{c} {k}" for c, k in _MADE.items()]
    return files.toDF(*inner).mapInArrow(_read(inner, own.index(media), with_rgb, with_payload), ", ".join(kinds)).toDF(*own, *added)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        payloads, files = part["payload"].to_pylist(), part["media"].to_pylist()
        yield pa.RecordBatch.from_arrays([
            part["doc_id"], part["n_bytes"], pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(m) for m in files], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in files]), part["feature"]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_texts(documents(spark, sf_dir).select("doc_id", "text")), with_rgb=False, with_payload=True)
    return read.select("doc_id", "n_bytes", "media", "payload", "feature").mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


#: JPEG is not for SQL; the query is tested by exact round trips.
ORACLE = None
