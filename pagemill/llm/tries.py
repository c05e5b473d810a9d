"""Conversation prefix trie: composable fingerprints of rebuilt conversations, of which no text is ever put together.

A turn is an affine map over the integers modulo 2^127 - 1, taken from the digest of its role and text; a sequence of
turns is the product of its maps, which form a group. The rebuilt conversation c takes the first h turns of its group's
base and then its own turns after its first h, so the fingerprint of its first d turns is the product of the base's head
and of the own suffix: head(base, h) * own(h)^-1 * own(i). Turns are hashed where they are read and only digests,
lengths and references (conversation, place) move.

Prefixes of equal fingerprints are a node. Its members must agree in the fingerprint of their parent and in the digest
of their last turn, and stored turns of one digest must agree in role and text: level by level this is equality of the
whole sequences. The job fails if it does not hold.

Products are scans in the order of (base, conversation, turn): partitions are summed first, the driver combines one
constant-size row a partition, and each partition is streamed again from the state before it. So a conversation may
be longer than a task can hold. Sums over subtrees need no loop over levels: the nodes whose smallest member is c are
one chain, summed by a second scan, and each conversation adds its chain's total to the nodes above the chain.

Defined cases: a null role or text is empty. Turns of one conversation are in the order of turn (null first), equal
ones in that of the SHA-256 of their role and text; a repeated row is one more turn. Rows without a conv_id belong to
no conversation and are left out. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, partitions, prepare

GROUP, HEADS = 100, 6
PRIME = 2**127 - 1
#: Conversations that one row of an end list names at most.
LISTED = 4096

Map = tuple[int, int]
NOTHING: Map = (1, 0)


def turn_map(digest: bytes) -> Map:
    """The multiplier (never 0) and the addend of a turn."""
    return int.from_bytes(digest[:16], "big") % (PRIME - 1) + 1, int.from_bytes(digest[16:], "big") % PRIME


def then(first: Map, second: Map) -> Map:
    return first[0] * second[0] % PRIME, (first[1] * second[0] + second[1]) % PRIME


def undone(x: Map) -> Map:
    inverse = pow(x[0], -1, PRIME)
    return inverse, -x[1] * inverse % PRIME


def key_of(x: Map) -> tuple[int, int]:
    """The addend as two signed longs."""
    return x[1] >> 64, (x[1] & (2**64 - 1)) - ((x[1] & 2**63) << 1)


def head_length(conv_id: int, heads: int = HEADS) -> int:
    return zlib.crc32(str(conv_id).encode()) % heads


def turns(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, base, turn, digest, chars): the stored turns without their texts."""
    conv = F.col("conv_id").cast("long")
    role, text = body("role"), body("text")
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(conv.isNotNull())
    return rows.select(conv.alias("conv_id"), (conv - conv % group).alias("base"), F.col("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Sorted ranges with the number of each, cut off: their partitions are fixed from here on. Equal rows may be split."""
    rows = rows.withColumns({"own": F.col("conv_id") != F.col("base"), "serial": F.monotonically_increasing_id()})
    order = ["base", "own", "conv_id", "turn", "digest", "serial"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.select(F.spark_partition_id().alias("part"), "conv_id", "base", "digest", "chars"))


class State:
    """Where the scan stands: the conversation, its turns and product so far, its first turns, and those of its base."""

    def __init__(self, heads: int):
        self.most = heads - 1
        self.conv = self.base = None
        self.count, self.product = 0, NOTHING
        self.opening: list = []
        self.base_opening: list = []

    def enter(self, conv: int, base: int) -> None:
        if conv != self.conv:
            self.conv, self.count, self.product, self.opening = conv, 0, NOTHING, []
        if base != self.base:
            self.base, self.base_opening = base, []

    def add(self, turn: Map, digest: bytes, chars: int) -> None:
        self.count += 1
        self.product = then(self.product, turn)
        if len(self.opening) < self.most:
            self.opening.append((turn, digest[:16], chars))
            if self.conv == self.base:
                self.base_opening.append((turn, digest[:16], chars))

    def after(self, part: "State") -> "State":
        """The state behind a partition that gave ``part`` when it was scanned from nothing."""
        out = State(self.most + 1)
        out.conv, out.base = part.conv, part.base
        same = part.conv == self.conv
        out.count = part.count + (self.count if same else 0)
        out.product = then(self.product, part.product) if same else part.product
        out.opening = ((self.opening if same else []) + part.opening)[: self.most]
        out.base_opening = ((self.base_opening if part.base == self.base else []) + part.base_opening)[: self.most]
        return out


def _turns_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch["conv_id"].to_pylist(), batch["base"].to_pylist(), batch["digest"].to_pylist(), batch["chars"].to_pylist())


def _edges(heads: int):
    """One row a partition: its number, its first conversation, and the state behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part, first = State(heads), None, None
        for batch in batches:
            if part is None and batch.num_rows:
                part, first = batch["part"][0].as_py(), batch["conv_id"][0].as_py()
            for conv, base, digest, chars in _turns_of(batch):
                state.enter(conv, base)
                state.add(turn_map(digest), digest, chars)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())],
                                             names=["part", "first", "state"])
    return run


_PREFIX = "k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, depth long, chars long, conv_id long, turn_conv long, turn_at long, ends boolean"


class Writer:
    """The prefixes of the rebuilt conversations of one partition."""

    def __init__(self, state: State, heads: int):
        self.state, self.heads, self.rows = state, heads, []
        self.prepared = None

    def prefix(self, now: Map, before: tuple | None, digest: bytes | None, depth: int, chars: int, ref: tuple) -> None:
        p1, p2 = before if before is not None else (None, None)
        t1, t2 = (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)) if digest else (None, None)
        self.rows.append((*key_of(now), p1, p2, t1, t2, depth, chars, self.state.conv, *ref, False))

    def prepare(self) -> None:
        """What the base gives to the conversation the state stands in; ``lift`` turns own products into fingerprints."""
        s = self.state
        self.prepared = s.conv
        self.skip = 0 if s.conv == s.base else head_length(s.conv, self.heads)
        self.head = list(accumulate((t for t, _, _ in s.base_opening[: self.skip]), then, initial=NOTHING)) if self.skip else [NOTHING]
        self.lift = None
        self.last = key_of(self.head[-1])
        if s.count >= self.skip:
            self._lifted(list(accumulate((t for t, _, _ in s.opening[: self.skip]), then, initial=NOTHING))[-1])
            if s.count > self.skip:
                self.last = key_of(then(self.lift, s.product))

    def _lifted(self, own: Map) -> None:
        self.lift = then(self.head[-1], undone(own)) if self.skip else NOTHING

    def turn(self, conv: int, base: int, digest: bytes, chars: int) -> None:
        s = self.state
        if conv != s.conv:
            self.finish()
            s.enter(conv, base)
            self.prepare()
            self.prefix(NOTHING, None, None, 0, 0, (None, None))
            for d, now in enumerate(self.head[1:], 1):
                _, own, n = s.base_opening[d - 1]
                self.prefix(now, key_of(self.head[d - 1]), own, d, n, (base, d - 1))
        elif self.prepared != conv:
            self.prepare()
        s.add(turn_map(digest), digest, chars)
        if s.count == self.skip:
            self._lifted(s.product)
        elif s.count > self.skip:
            now = then(self.lift, s.product)
            self.prefix(now, self.last, digest, len(self.head) - 1 + s.count - self.skip, chars, (conv, s.count - 1))
            self.last = key_of(now)

    def finish(self) -> None:
        """The conversation ends here."""
        if self.prepared is not None:
            self.rows.append((*self.last, None, None, None, None, None, None, self.state.conv, None, None, True))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 11 + [pa.bool_()]
        columns = list(zip(*self.rows)) or [[]] * 12
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PREFIX.split(", ")])


def _prefixes(before: dict[int, tuple[bytes, bool]], heads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, continues = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                raw, continues = before[batch["part"][0].as_py()]
                writer = Writer(pickle.loads(raw), heads)
            for row in _turns_of(batch):
                writer.turn(*row)
            yield writer.batch()
        if writer is not None and not continues:
            writer.finish()
            yield writer.batch()
    return run


def prefixes(stored: DataFrame, heads: int = HEADS) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, and one (``ends``) for the key each conversation ends at."""
    placed = _ordered(stored)
    edges = sorted(placed.mapInArrow(_edges(heads), "part int, first long, state binary").collect())  # one row a partition
    before, state = {}, State(heads)
    for (part, _, raw), following in zip(edges, [*edges[1:], None]):
        last = pickle.loads(raw).conv
        before[part] = (pickle.dumps(state), following is not None and following["first"] == last)
        state = state.after(pickle.loads(raw))
    return cut(placed.mapInArrow(_prefixes(before, heads), _PREFIX))


def _refuse(rows: DataFrame, why: str) -> None:
    if not rows.isEmpty():
        raise RuntimeError(why)


def verify_turns(conversations: DataFrame) -> None:
    """Stored turns of one digest have one role and text; only digests that several turns have are compared."""
    role, text = body("role"), body("text")
    named = conversations.where("conv_id IS NOT NULL").select(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).alias("content"))
    digest = F.substring(F.unhex(F.sha2("content", 256)), 1, 16)
    repeated = named.groupBy(digest.alias("digest")).count().where("count > 1").select("digest")
    same = named.withColumn("digest", digest).join(repeated, "digest").groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    _refuse(same.where("low <> high"), "two turns have one digest")


def _totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``leaves_below`` and ``saved_below``: sums over the node and the deeper ones of its chain."""
    order = [F.col("conv_id"), F.col("depth").desc()]
    placed = cut(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part", "conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    edges = sums.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "leaves", "saved")).alias("last")).collect()  # one row a partition
    before, carry, names = {}, (None, 0, 0), nodes.columns
    for part, first, last in sorted(edges):
        before[part] = carry
        goes_on = first == last["conv_id"] == carry[0]
        carry = (last["conv_id"], last["leaves"] + (carry[1] if goes_on else 0), last["saved"] + (carry[2] if goes_on else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if now is None:
                now = before[batch["part"][0].as_py()]
            conv = batch["conv_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[conv[0] != now[0]], conv[1:] != conv[:-1]]))
            own, columns = np.zeros(len(conv), np.int64), []
            own[starts] = 1
            for i, name in enumerate(("leaf", "saved"), 1):
                total = np.cumsum(batch[name].to_numpy())
                behind = np.concatenate([[-now[i]], total[starts - 1] * (starts > 0)])  # what was summed before the group of each row
                columns.append(total - behind[np.cumsum(own)])
            now = (int(conv[-1]), int(columns[0][-1]), int(columns[1][-1]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *map(pa.array, columns)], names=[*names, "leaves_below", "saved_below"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return placed.mapInArrow(run, f"{kinds}, leaves_below long, saved_below long")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) as lists of at most LISTED conversations of one key, each with its first one."""
    key, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        ids.clear()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "first", "ids"])

    for rows in batches:
        for k1, k2, conv in zip(rows["k1"].to_pylist(), rows["k2"].to_pylist(), rows["conv_id"].to_pylist()):
            if (k1, k2) != key or len(ids) >= LISTED:
                flush()
                key = (k1, k2)
            ids.append(conv)
        yield batch()
    flush()
    yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists of one key, one after the other, as one hash."""
    key, digest, out = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])

    for rows in batches:
        for k1, k2, ids in zip(rows["k1"].to_pylist(), rows["k2"].to_pylist(), rows["ids"].to_pylist()):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield batch()
    if key is not None:
        out.append((*key, digest.hexdigest()))
        yield batch()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the keys that conversations end at. A long list is written by many tasks and hashed as a stream."""
    order = ["k1", "k2", "conv_id"]
    lists = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "k1 long, k2 long, first long, ids string")
    lists = lists.repartition(partitions(ends.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return lists.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_at): the
    last two name the stored turn (from 0 in its conversation) that holds the node's last role and text.
    """
    verify_turns(conversations)
    rows = prefixes(turns(conversations, group), heads)
    members = rows.where("NOT ends")
    claim = F.xxhash64("p1", "p2", "t1", "t2", "depth", "chars")
    nodes = cut(members.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.min("turn_conv").alias("turn_conv"), F.min_by("turn_at", "turn_conv").alias("turn_at"), F.min(claim).alias("low"), F.max(claim).alias("high")))
    _refuse(nodes.where("low <> high"), "two prefixes have one fingerprint")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.drop("low", "high").join(children, ["k1", "k2"], "left").na.fill(0, ["n_children"])
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = cut(_totals(nodes))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("leaves_below").alias("leaves"), F.max("saved_below").alias("saved")).where("top > 0")
    above = members.select("conv_id", "depth", "k1", "k2").join(chains, "conv_id").where("depth < top")
    above = above.groupBy("k1", "k2").agg(F.sum("leaves").alias("leaves_beside"), F.sum("saved").alias("saved_beside"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["p1", "p2"], "left").join(above, ["k1", "k2"], "left").join(end_hashes(rows.where("ends").select("k1", "k2", "conv_id")), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_below") + F.coalesce("leaves_beside", F.lit(0))).alias("n_leaves"),
        (F.col("saved_below") + F.coalesce("saved_beside", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "turn_conv", "turn_at")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn_conv", "turn_at")


#: CRC-32 of a decimal: the table is made bit by bit, the digits are folded over it.
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),"
        " lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)")

ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS crc FROM steps WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, CASE WHEN conv_id % {GROUP} = 0 THEN 0 ELSE {_CRC} % {HEADS} END AS h
  FROM (SELECT DISTINCT conv_id FROM own), crcs),
pieces AS (
  SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place < c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
members AS (SELECT conv_id, depth, chars, path FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(chars) AS chars FROM members GROUP BY path),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN children c ON c.path = n.path),
sums AS (
  SELECT left(path, 32 * up) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN nodes p ON v.depth > 0 AND p.path = left(v.path, 32 * (v.depth - 1)) LEFT JOIN ends e ON e.path = v.path"""
