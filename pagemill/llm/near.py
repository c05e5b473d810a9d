"""Near-dedup by the exact Jaccard share of word shingles, for stages of a pipeline.

Two texts are linked if their sets of five-word shingles have a Jaccard share of 0.8 or more; components of links are
groups. Sets of that share differ in about 10 of 64 SimHash bits, up to 20 of them; a search within so many bits has
segments of three or four bits as keys, which meet everything. So candidates come from ``TABLES`` keys of ``ROWS`` least
hashes each (a pair of share 0.8 is missed with a chance of 0.02 %, of 0.9 with 1e-7), and the SimHash fingerprint, as in
``simhash``, prunes them: first by a chain of segments within their share of the limit, then by the full Hamming check.
What is left is checked exactly, on the sets of shingle hashes. Sets travel once to each block of pairs, not to each pair.

Equal sets are one node. Members of a key of more than ``CROWD`` meet ``PIVOTS`` of them, which joins the groups of near
copies that make a key large. Where such a key holds several groups after the exact check, its members, if they are at most
``MEET``, are checked in one place until what links is joined; more are searched by the prefix filter: shingles in the order of their number among these members, the least frequent first, a smaller set
by its first n - ceil(2t / (1 + t) n) + 1 and a larger one by its first n - ceil(t n) + 1. So pages of one template, which
share much but not enough, meet by what is their own.

Defined cases: texts without words (null and empty ones too) are one group, a text of fewer than five words is one
shingle. Repeated rows are one group, of which one row stays; among rows of one doc_id that of the smallest hash of all
columns. A null doc_id sorts last. An empty table gives an empty result. Other columns are passed through, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, mixed, slices
from pagemill.llm.simhash import BITS, SEED, _keep_first, dealt, hashable, shingle_hashes, stars

WORDS, SHARE = 5, 0.8
TABLES, ROWS = 12, 3
#: Differing bits that a candidate may have, and the segments of the chain: 3.6 deviations above the mean at the share.
LIMIT, SEGMENTS = 20, 8
CROWD, PIVOTS = 32, 4
#: Members of a key that are compared by their sizes and fingerprints in one place.
MEET = 1024
#: Pairs of a block that is checked at once, about.
BLOCK_PAIRS = 2000


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def packed_set(text: str, words: int) -> np.ndarray:
    """The set by 32 bits of each hash, as it travels: two shingles of a text are taken for one with a chance of 1 in 4e9."""
    return np.unique((shingle_hashes(text, words) >> np.uint64(32)).astype(np.uint32))


def _prints(words: int):
    """Of each text: its node, the size of its set, its fingerprint and its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            nodes, sizes, prints, keys = [], [], [], []
            for text in part["body"].to_pylist():
                own = shingle_set(text, words)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if len(own) else np.zeros(BITS, np.int64)
                prints.append(int(np.packbits(bits * 2 > len(own), bitorder="little").view("<u8")[0]))
                least = np.array([mixed(own, 100 + i).min(initial=np.uint64(2**64 - 1)) for i in range(TABLES * ROWS)], np.uint64)
                keys.append([xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, len(least), ROWS)])
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.array(keys, np.uint64).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, TABLES, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_hash"], long(nodes), pa.array(sizes, pa.int64()), long(prints), lists],
                                             names=["doc_id", "row_hash", "node", "n", "fp", "keys"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([part["node"], pa.array([packed_set(t, words).tobytes() for t in part["body"].to_pylist()], pa.binary())], names=["node", "shingles"])
    return run


def _sizes_fit(a: Column, b: Column, share: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * share - 1e-9


def _prints_fit(a: str, b: str) -> Column:
    """Some chain of segments on the ring stays within its part of the limit from its start on (any within the limit do), and so does the whole."""
    width = BITS // SEGMENTS
    differs = F.col(a).bitwiseXOR(F.col(b))
    own = [F.bit_count(F.shiftrightunsigned(differs, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(SEGMENTS)]
    chains = [(own[i] * SEGMENTS <= LIMIT) & ((own[i] + own[(i + 1) % SEGMENTS]) * SEGMENTS <= 2 * LIMIT) for i in range(SEGMENTS)]
    some = chains[0]
    for c in chains[1:]:
        some = some | c
    return some & (F.bit_count(differs) <= LIMIT)


def _meet(share: float):
    """Of the members of one key, links that join groups: each pair of different groups whose sizes and fingerprints fit is checked until it is joined."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        nodes, n, prints, roots = (table[c].to_numpy()[order] for c in ("node", "n", "fp", "root"))
        prints, held = prints.view(np.uint64), table["shingles"].to_pylist()
        sets = [np.frombuffer(held[i], np.uint32) for i in order.tolist()]
        roots, one, two = roots.copy(), [], []
        for i in range(1, len(nodes)):
            low = int(np.searchsorted(n[:i], n[i] * share - 1e-9))
            fits = np.bitwise_count(prints[low:i] ^ prints[i]) <= LIMIT
            for j in (low + np.flatnonzero(fits)).tolist():
                if roots[j] != roots[i]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= share * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                        one.append(min(nodes[i], nodes[j]))
                        two.append(max(nodes[i], nodes[j]))
                        roots[roots == roots[j]] = roots[i]
        return pa.table({"a": pa.array(np.array(one, np.int64)), "b": pa.array(np.array(two, np.int64))})
    return run


def _judge(share: float):
    def run(key: tuple, pairs: pa.Table, held: pa.Table) -> pa.Table:
        sets = {node: np.frombuffer(raw, np.uint32) for node, raw in zip(held["node"].to_pylist(), held["shingles"].to_pylist())}
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= share * (len(x) + len(y) - both) - 1e-9)
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _checked(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets have the share, as (a, b) with a < b.

    Pairs that hang together are checked in one place, or, if they are many, in several by their first node: its set goes to
    one place, and what many nodes are compared with, to all.
    """
    pairs = cut(pairs)
    some = pairs.count()
    reached = stars(dealt(pairs.select(*_ordered_pair(F.col("a"), F.col("b"))), some, "a", "b").distinct())
    roots = dealt(reached.select(F.col("node").alias("a"), "root"), some, "a")
    placed = dealt(dealt(pairs, some, "a").join(roots, "a", "left").withColumn("root", F.coalesce("root", "a")), some, "root")
    sizes = placed.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_PAIRS).alias("tiles"))
    placed = cut(placed.join(sizes, "root").select("a", "b", "root", F.pmod(F.xxhash64("a"), "tiles").alias("tile")))
    needed = placed.select(F.col("root").alias("held_root"), F.col("tile").alias("held_tile"), F.explode(F.array("a", "b")).alias("node")).distinct()
    held = needed.join(sets, "node").groupBy("held_root", "held_tile")
    found = placed.groupBy("root", "tile").cogroup(held).applyInArrow(_judge(share), "a long, b long")
    return cut(found.select(*_ordered_pair(F.col("a"), F.col("b"))).distinct())


def _ordered_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rest(crowded: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Pairs of the nodes ``crowded`` (node, n, root), of different roots, that the prefix filter leaves."""
    shingles = F.transform(F.sequence(F.lit(1), F.octet_length("shingles"), F.lit(4)), lambda at: F.hex(F.substring("shingles", at, F.lit(4))))
    own = crowded.where("n > 0").join(sets, "node").select("node", "n", "root", F.explode(shingles).alias("shingle"))
    counted = own.join(own.groupBy("shingle").agg(F.count("*").alias("times")), "shingle")
    ordered = counted.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("order"))  # a set, as long as its text
    first = lambda part: (F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1).cast("int")

    def keyed(part: float, name: str) -> DataFrame:
        some = F.explode(F.slice("order", F.lit(1), F.least(F.size("order"), first(part)))).alias("k")
        return ordered.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("root").alias(f"root_{name}"), some).where("k.times > 1").select("*", "k.shingle").drop("k")

    small, large = keyed(2 * share / (1 + share), "x"), keyed(share, "y")
    met = small.join(large, "shingle").where((F.col("n_x") <= F.col("n_y")) & (F.col("root_x") != F.col("root_y")) & _sizes_fit(F.col("n_x"), F.col("n_y"), share))
    return met.select(*_ordered_pair(F.col("x"), F.col("y"))).distinct()


def groups(docs: DataFrame, words: int = WORDS, share: float = SHARE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, row_hash, node, root): ``root`` is the least node of the component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*hashable(docs)).alias("row_hash"), body().alias("body"))
    prints = cut(rows.mapInArrow(_prints(words), "doc_id long, row_hash long, node long, n long, fp long, keys array<long>"))
    nodes = prints.dropDuplicates(["node"]).select("node", "n", "fp", F.posexplode("keys").alias("part", "key"))
    turns = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"pivot{i}") for i in range(PIVOTS)]
    keys = nodes.groupBy("part", "key").agg(F.count("*").alias("members"), *turns).where("members > 1")
    shared = cut(nodes.join(keys, ["part", "key"]))
    x = shared.where(F.col("members") <= crowd).select("part", "key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("fp").alias("fp_a"))
    y = x.toDF("part", "key", "b", "n_b", "fp_b")
    met = x.join(y, ["part", "key"]).where((F.col("a") < F.col("b")) & _sizes_fit(F.col("n_a"), F.col("n_b"), share) & _prints_fit("fp_a", "fp_b")).select("a", "b")
    many = shared.where(F.col("members") > crowd)
    to_pivot = many.select("node", "n", "fp", F.explode(F.array(*[f"pivot{i}" for i in range(PIVOTS)])).alias("pivot")).where("node <> pivot").distinct()
    pivots = many.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("fp").alias("pivot_fp"), F.array(*[f"pivot{i}" for i in range(PIVOTS)]).alias("all")).where("array_contains(all, pivot)").drop("all").distinct()
    to_pivot = to_pivot.join(pivots, "pivot").where(_sizes_fit(F.col("n"), F.col("pivot_n"), share) & _prints_fit("fp", "pivot_fp"))
    pairs = cut(met.unionByName(to_pivot.select(F.col("node").alias("a"), F.col("pivot").alias("b"))).distinct())
    # one text a node that any pair or crowd needs, by the hash of a row
    open_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")).distinct()
    named = prints.join(open_nodes, "node", "left_semi").groupBy("node").agg(F.min("row_hash").alias("row_hash"))
    texts = rows.select("row_hash", "body").join(named, "row_hash").dropDuplicates(["node"])
    sets = cut(texts.select("node", "body").mapInArrow(_sets(words), "node long, shingles binary"))
    edges = _checked(pairs, sets, share)
    roots = stars(edges)
    labelled = many.join(roots, "node", "left").select("part", "key", "members", "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("part", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("part", "key")
    left = cut(labelled.join(several, ["part", "key"], "left_semi"))
    few = left.where(F.col("members") <= MEET).select("part", "key", "node", "n", "fp", "root").join(sets, "node")
    joined = few.groupBy("part", "key").applyInArrow(_meet(share), "a long, b long").distinct()
    large = left.where(F.col("members") > MEET)
    if not large.isEmpty():
        joined = joined.unionByName(_checked(_rest(cut(large.select("node", "n", "root").distinct()), sets, share), sets, share))
    joined = cut(joined)
    if not joined.isEmpty():
        roots = stars(edges.unionByName(joined))
    roots = roots.withColumnRenamed("node", "near")
    return prints.join(roots, prints["node"] == roots["near"], "left").select("doc_id", "row_hash", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """The documents without near-copies: of each group the row of the smallest (doc_id, hash of the row) stays."""
    return _keep_first(docs, groups(docs, words, share))
