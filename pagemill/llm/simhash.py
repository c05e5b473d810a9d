"""SimHash near-dedup with pigeonring filtering.

Fingerprints are collapsed first: equal ones are one node, however many documents share it. Two fingerprints within
``limit`` differing bits have, cut into limit + 1 segments on a ring, a segment from which every chain of l segments
holds at most floor(l * limit / (limit + 1)) differences. So some segment is equal and, together with the next one,
differs in at most one bit: the join key is the pair of segments (43 of 64 bits at limit 2), with the single-bit
variants of the second segment on the probing side. What survives the chain goes to the full Hamming check.

A bucket of one key may hold a dense cluster. Members of a bucket of more than ``CROWD`` never meet each other: each
looks up the 2,080 fingerprints within two bits of its own by equality instead, so work stays linear in the members
and no link is lost. Components come from alternating large and small stars.

Defined cases: a null or empty text, and one without words, has fingerprint zero and links like any other. A null
doc_id never names a component unless all of its documents lack one. Repeated rows get equal results. An empty table
gives an empty result. Other columns are ignored by ``components`` and passed through by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, documents, free_name, partitions, slices

BITS, SEED = 64, 42
SHINGLE, LIMIT = 3, 2
#: Buckets of more members than this are searched by neighbourhood, not by meeting.
CROWD = 256
#: Edges of a task in the search for components.
TASK_EDGES = 50_000


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z in lower case, joined by spaces; of all words if there are fewer."""
    own = text.encode("utf-8", "replace").lower().split()  # bytes split at 0x20 and 0x09-0x0D only
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), SEED)], np.uint64)
    runs = zip(*(own[i:] for i in range(words)))
    return np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in map(b" ".join, runs)), np.uint64, len(own) - words + 1)


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def hashable(docs: DataFrame) -> list[str]:
    """The columns that Spark can hash (maps are left out)."""
    return [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            own = np.array([fingerprint(t, words) for t in part["body"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_hash"], pa.array(own)], names=["doc_id", "row_hash", "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, fp): ``row_hash`` is over all columns, ``fp`` the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*hashable(docs)).alias("row_hash"), body().alias("body"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, row_hash long, fp long")


def segments(limit: int = LIMIT) -> list[tuple[int, int]]:
    """(first bit, bits) of limit + 1 segments of nearly equal size."""
    m = limit + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: str, at: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({fp}, {at[0]}) & {(1 << at[1]) - 1}L)"


def near_patterns(bits: int, most: int) -> list[int]:
    """Every pattern of ``bits`` bits with 1 to ``most`` of them set, as signed longs."""
    out, level = [], [(0, -1)]
    for _ in range(most):
        level = [(mask | 1 << j, j) for mask, last in level for j in range(last + 1, bits)]
        out += [mask for mask, _ in level]
    return [x - 2**64 if x >= 2**63 else x for x in out]


def links(nodes: DataFrame, limit: int = LIMIT, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: every pair of the distinct fingerprints ``nodes.fp`` with at most ``limit`` differing bits."""
    parts, chain = segments(limit), []
    for i in range(limit + 1):
        second = parts[(i + 1) % (limit + 1)]
        pair = f"(shiftleft({_segment('fp', parts[i])}, {second[1]}) | {_segment('fp', second)})"
        flips = "array(" + ", ".join(["0L", *(f"{1 << j}L" for j in range(second[1]))]) + ")"
        chain.append((f"struct({i} AS seg, {pair} AS pair)", f"struct({i} AS seg, {pair} AS pair, {flips} AS flips)"))
    index = nodes.selectExpr("fp", f"inline(array({', '.join(x for x, _ in chain)}))")
    probe = nodes.selectExpr("fp AS other", f"inline(array({', '.join(x for _, x in chain)}))")
    probe = probe.select("other", "seg", "pair", F.explode("flips").alias("flip")).selectExpr("other", "seg", "pair ^ flip AS pair")
    full = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= limit
    sizes = index.groupBy("seg", "pair").agg(F.count("*").alias("members"))
    sized = index.join(sizes, ["seg", "pair"])
    loose = sized.where(F.col("members") <= crowd).join(probe, ["seg", "pair"]).where((F.col("fp") != F.col("other")) & full)
    # members of a crowded bucket look up each fingerprint within reach instead of meeting each other
    crowded = sized.where(F.col("members") > crowd).select("fp").distinct()
    reach = crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in near_patterns(BITS, limit)])).alias("flip"))
    close = reach.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("other")).join(nodes.select(F.col("fp").alias("other")), "other")
    pairs = loose.select("fp", "other").unionByName(close.select("fp", "other"))
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def dealt(rows: DataFrame, edges: int, *keys: str) -> DataFrame:
    """The rows by their keys, in no more tasks than ``edges`` ask for; tables that fill the session's tasks are left to it."""
    few = -(-edges // TASK_EDGES)
    return rows.repartition(few or 1, *keys) if few < partitions(rows.sparkSession) else rows


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): of every node with an edge, the least node it is connected to (alternating large and small stars).

    Every round writes each shuffle once for each task and partition, so few edges stay in few tasks.
    """
    def digest(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    # an edge (a, b) says: b hangs on a, a < b
    now = cut(edges.select("a", "b"))
    state = digest(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = dealt(both, state[0], "u")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b"))
        large = dealt(large, state[0], "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(low, "b")
        small = joined.select(F.col("low").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(joined.select(F.col("low").alias("a"), "b"))
        now = cut(dealt(small, state[0], "a", "b").distinct())
        before, state = state, digest(now)
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``prints`` (doc_id, fp and more) with ``root``, the least fingerprint of the component, and ``component_id``, its least doc_id."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = stars(links(nodes.select("fp"), limit))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(lowest, "root"), "fp")


def _keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of the rows of each ``rooted.root`` the one of the smallest (doc_id, hash of the row); a null doc_id sorts last."""
    first = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first")).select("first.doc_id", "first.row_hash")
    own = docs.columns
    did, row = free_name("first_id", own), free_name("row_hash", own)
    first = first.select(F.col("doc_id").alias(did), F.col("row_hash").alias(row))
    this = F.xxhash64(*hashable(docs))
    kept = docs.withColumn(free_name("own_hash", own), this)
    kept = kept.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(did)) & (F.col(free_name("own_hash", own)) == F.col(row)))
    return kept.dropDuplicates([did, row]).select(*own)


def one_of_each(docs: DataFrame, limit: int = LIMIT, words: int = SHINGLE) -> DataFrame:
    """The documents without near-copies: of each component the row of the smallest (doc_id, hash of the row) stays."""
    return _keep_first(docs, components(cut(fingerprints(docs, words)), limit))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(documents(spark, sf_dir).select("doc_id", "text")))
    return components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: DuckDB has no XXH64, so the query is tested against brute force.
ORACLE = None
