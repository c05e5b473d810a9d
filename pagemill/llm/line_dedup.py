"""Line dedup: sorted line hashes, the first document of each streamed, compressed keep bitmaps per document.

The hashes of all lines are range-partitioned and sorted by (hash, document, position), so a hash with very many
lines spreads over as many partitions as it needs. Each sorted partition is streamed once: the first document of a
run keeps its lines, later documents lose theirs. A run that began in an earlier partition takes its first document
from the partition edges, two rows a partition. Texts move once, when the bitmaps are applied.

Defined cases: a null or empty text is one empty line. A null doc_id counts as the largest id, and rows of one doc_id
are one document. Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored
by ``keep_bitmaps`` and passed through by ``dedup_lines``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, documents, free_name, order_id, slices

BLANK = " \t\n\v\f\r"
MIN_CHARS = 10

_KEYS = "digest binary, did long, row_hash long, n_lines int, at array<int>"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without blanks at its ends and with A-Z in lower case; None if it is too short to count."""
    key = line.strip(BLANK)
    return key.encode("utf-8", "replace").lower() if len(key) >= min_chars else None


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            digests, ids, hashes, sizes, places = [], [], [], [], []
            for did, row_hash, text in zip(part["did"].to_pylist(), part["row_hash"].to_pylist(), part["body"].to_pylist()):
                lines, own = text.split("\n"), {}
                for i, line in enumerate(lines):
                    key = line_key(line, min_chars)
                    if key is not None:
                        own.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                digests += own.keys()
                places += own.values()
                ids += [did] * len(own)
                hashes += [row_hash] * len(own)
                sizes += [len(lines)] * len(own)
            yield pa.RecordBatch.from_arrays([
                pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()),
                pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["digest", "did", "row_hash", "n_lines", "at"])
    return run


def _later_lines(firsts: dict[bytes, int]):
    """Stream a sorted partition; emit the lines of every document but the first of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = first = seen = None
        for batch in batches:
            take, columns = [], [batch["digest"].to_pylist(), batch["did"].to_pylist(), batch["row_hash"].to_pylist()]
            for i, (now, did, row_hash) in enumerate(zip(*columns)):
                if now != digest:
                    digest, first, seen = now, firsts.get(now, did), None
                if did != first and (did, row_hash) != seen:
                    take.append(i)
                seen = (did, row_hash)
            yield batch.select(["did", "row_hash", "n_lines", "at"]).take(pa.array(take, pa.int64()))
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, at in zip(batch["n_lines"].to_pylist(), batch["at"].to_pylist()):
            keep = np.ones(n, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([batch["did"], batch["row_hash"], batch["n_lines"], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
                                         names=["did", "row_hash", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, row_hash, n_lines, n_dropped, keep) of every document that loses a line; ``keep`` is a zlib-packed bit per line.

    ``did`` is the doc_id (a null one: the largest long) and ``row_hash`` the XXH64 of the text.
    """
    texts = docs.select(order_id().alias("did"), F.xxhash64(body()).alias("row_hash"), body().alias("body"))
    lines = texts.mapInArrow(_line_rows(min_chars), _KEYS)
    lines = cut(lines.repartitionByRange("digest", "did", "row_hash").sortWithinPartitions("digest", "did", "row_hash"))
    edges = lines.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.struct("digest", "did")).alias("low"), F.max(F.struct("digest", (-F.col("did")).alias("back"))).alias("high"))
    runs = edges.select(F.inline(F.array(F.struct("low.digest", "low.did"), F.struct(F.col("high.digest"), (-F.col("high.back")).alias("did")))))
    firsts = {bytes(r["digest"]): r["did"] for r in runs.groupBy("digest").agg(F.min("did").alias("did")).collect()}  # two a partition at most
    later = lines.mapInArrow(_later_lines(firsts), "did long, row_hash long, n_lines int, at array<int>")
    per_doc = later.groupBy("did", "row_hash").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))
    return per_doc.mapInArrow(_pack, "did long, row_hash long, n_lines int, n_dropped int, keep binary")


def _apply(body_at: int, names: list[str]):
    text, keep = names[body_at], names[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts, lines, dropped = [], [], []
            for value, packed in zip(part[text].to_pylist(), part[keep].to_pylist()):
                own = (value or "").split("\n")
                kept = own
                if packed is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(own)).astype(bool)
                    kept = [line for line, bit in zip(own, bits) if bit]
                texts.append("\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == body_at else part.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names[:-1], "n_lines", "n_dropped"])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """The documents with their kept lines as text (a null text becomes empty), and two counts per document.

    All columns stay as they are and where they are; a clashing count name gets an underscore in front.
    """
    own = docs.columns
    did, row_hash = free_name("did", own), free_name("row_hash", own)
    bitmaps = keep_bitmaps(docs, min_chars).select(F.col("did").alias(did), F.col("row_hash").alias(row_hash), F.col("keep").alias(free_name("keep", own)))
    keyed = docs.withColumns({did: order_id(), row_hash: F.xxhash64(body())})
    joined = keyed.join(bitmaps, [did, row_hash], "left").select(*own, bitmaps.columns[-1])
    at = [c.lower() for c in own].index("text")
    # inner names are positional, so that clashing or odd names of other columns never matter
    inner = [f"c{i}" for i in range(len(own))] + ["keep"]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    schema = ", ".join(f"{c} {'string' if i == at else kind}" for i, (c, kind) in enumerate(zip(inner, kinds))) + ", n_lines long, n_dropped long"
    return joined.toDF(*inner).mapInArrow(_apply(at, inner), schema).toDF(*own, free_name(lines, own), free_name(dropped, own))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
firsts AS (SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10 GROUP BY line_key),
judged AS (
  SELECT k.doc_id, k.line_no, k.line, f.first_id IS NULL OR f.first_id = k.doc_id AS kept
  FROM keyed k LEFT JOIN firsts f ON k.line_key = f.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
