"""Multiclass gradient boosting by histograms, each pass one aggregation over the rows.

Features are cut into bins at quantiles. In a round every class gets a tree for the softmax loss. A pass sums gradients,
hessians and rows per (leaf, feature, bin) for the new leaves of all classes at once: tasks sum their own rows, the sums
are shuffled by leaf and block of features, and each key gives its best split. A leaf of at most ``LOCAL`` rows sends the
rows themselves instead, and one task grows all that may come below it. Only splits reach the driver. Trees grow best
first; the leaves that may come next are split ahead, so a round takes a pass for each level of large leaves and one
more, and the tree that counts is the one best-first growth gives. The rows' scores are held from round to round, so no
pass walks the trees of earlier rounds. Sums are of fixed-point numbers: they do not depend on how rows are dealt, so
neither does the model.

Rows are drawn anew every few rounds by a hash of their key, features for each tree. Training ends when the loss of the
training rows has not fallen for ``patience`` rounds, or no tree can split; the rounds up to the best one count.

Defined cases: a null or missing feature goes right. A null key is drawn like the key 0. An empty table or a single
class is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pagemill.session import shared_dir, ship

#: Fixed-point scale of gradients and hessians.
SCALE = float(1 << 24)
#: Bytes of sums that a task holds for one pass, features that one row of sums carries, and rounds between two written states.
PASS_BYTES, BLOCK, WRITTEN = 64 << 20, 16, 10
#: Rows of a leaf that one task may hold (80 bytes each with 64 features), and rows below which tasks over all rows are put together.
LOCAL, TASK_ROWS = 100_000, 20_000
#: Rows that are counted at once, and the unit of a row where it is counted together with its hessian (at most SCALE / 2): their sum has 53 bits.
CHUNK, UNIT = 4096, float(1 << 40)


@dataclass(frozen=True)
class Settings:
    # Training settings.
    rounds: int = 100
    leaves: int = 31
    rate: float = 0.05
    feature_share: float = 0.9
    row_share: float = 0.8
    rows_every: int = 5
    patience: int = 10
    # Our own.
    bins: int = 63
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    seed: int = 42


@dataclass
class Node:
    number: int
    feature: int = -1
    bin: int = -1
    left: int = -1
    right: int = -1
    gain: float = 0.0
    rows: int = 0  # at most so many
    sums: tuple[float, float, int] = (0.0, 0.0, 0)
    split: tuple | None = None  # (gain, feature, bin, rows that go left), once known
    known: bool = False


@dataclass
class Tree:
    """Node 0 is the root; ``value`` of a leaf is what it adds to its class's score."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            here = at[inner]
            goes_left = binned[rows[inner], self.feature[here]] <= self.bin[here]
            at[inner] = np.where(goes_left, self.left[here], self.right[here])


@dataclass
class Model:
    classes: list
    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def nodes(self) -> list[tuple]:
        """(round, class_index, node, feature, threshold, left, right, value, gain) of every node."""
        out = []
        for r, trees in enumerate(self.trees):
            for k, t in enumerate(trees):
                for i in range(len(t.left)):
                    inner = t.left[i] >= 0
                    where = (int(t.feature[i]), float(self.edges[t.feature[i]][t.bin[i]]), int(t.left[i]), int(t.right[i])) if inner else (None,) * 4
                    out.append((r, k, i, *where, None if inner else float(t.value[i]), float(t.gain[i])))
        return out


def bin_edges(rows: DataFrame, bins: int, features: str = "features") -> list[np.ndarray]:
    """Upper edges of all bins but the last, per feature: distinct quantiles over all rows."""
    values = rows.select(F.posexplode(features).alias("feature", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    shares = [i / bins for i in range(1, bins)]
    cuts = values.groupBy("feature").agg(F.percentile_approx("v", shares, 100 * bins).alias("cuts"), F.max("v").alias("most")).orderBy("feature").collect()
    found = {r["feature"]: np.array(sorted({c for c in r["cuts"] if c < r["most"]})) for r in cuts}  # the feature list
    return [found.get(i, np.zeros(0)) for i in range(max(found, default=-1) + 1)]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def drawn(keys: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Whether each row takes part in the rounds of this turn."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (s.seed * 1_000_003 + turn + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(s.row_share * 2**64), 2**64 - 1))


def chosen(turn: int, k: int, width: int, s: Settings) -> np.ndarray:
    """The features that the tree of class ``k`` may split at in this round."""
    take = np.zeros(width, bool)
    take[np.random.default_rng([s.seed, turn, k]).permutation(width)[: math.ceil(s.feature_share * width)]] = True
    return take


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-point gradients and hessians per row and class, and losses per row."""
    p, k = softmax(scores), scores.shape[1]
    rows = np.arange(len(y))
    g = p.copy()
    g[rows, y] -= 1
    h = np.maximum(p * (1 - p) * k / (k - 1), 1e-16)
    return np.rint(g * SCALE), np.rint(h * SCALE), np.rint(-np.log(np.maximum(p[rows, y], 1e-300)) * SCALE)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int, int]:
    """Of sums (feature, bin) of one leaf: the best gain, its feature and bin, and the rows that go left; gain 0 if none. Ties: the first feature, then bin."""
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
    left_g, left_h, left_n = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    right_g, right_h, right_n = total_g - left_g, total_h - left_h, total_n - left_n
    ok = (left_n >= s.least_rows) & (right_n >= s.least_rows) & (left_h >= s.least_hessian * SCALE) & (right_h >= s.least_hessian * SCALE) & allowed[:, None]
    if not ok.any():
        return 0.0, -1, -1, 0
    l2 = s.l2 * SCALE
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)) / SCALE
    gain = np.where(ok & (gain > 1e-12), gain, 0.0)
    feature, at = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[feature, at]), int(feature), int(at), int(left_n[feature, at])) if gain[feature, at] > 0 else (0.0, -1, -1, 0)


def counted(own: np.ndarray, g: np.ndarray, h: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Sums (gradients, hessians, rows) of whole numbers at the places of each row's bins."""
    out, width = np.zeros((3, size)), own.shape[1]
    for a in range(0, len(own), CHUNK):
        part = slice(a, a + CHUNK)
        at = (places + own[part]).ravel()
        out[0] += np.bincount(at, np.repeat(g[part], width), size)
        both = np.bincount(at, np.repeat(h[part] + UNIT, width), size)
        n = np.floor(both / UNIT)
        out[1] += both - n * UNIT
        out[2] += n
    return out


def grown(own: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, allowed: np.ndarray, s: Settings) -> list[tuple]:
    """All of a subtree that best-first growth may take, from its rows: (gain, feature, bin, left, right, g, h, n) of each node."""
    width = own.shape[1]
    places = np.arange(width) * bins

    def count(rows: np.ndarray) -> np.ndarray:
        return sum((counted(own[part], g[part], h[part], places, width * bins) for part in np.split(rows, range(CHUNK, len(rows), CHUNK))), np.zeros((3, width * bins)))

    def judge(rows: np.ndarray, sums: np.ndarray) -> tuple:
        return best_splits(*sums.reshape(3, width, bins), allowed, s), (float(g[rows].sum()), float(h[rows].sum()), len(rows))

    parts = [np.arange(len(own))]
    held = {0: count(parts[0])}  # of leaves that may be split
    judged, children, heap = [judge(parts[0], held[0])], [(-1, -1)], []
    if judged[0][0][0] > 0:
        heap.append((-judged[0][0][0], 0))
    for _ in range(s.leaves - 1):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        _, feature, at, _ = judged[i][0]
        left = own[parts[i], feature] <= at
        children[i] = (len(parts), len(parts) + 1)
        both, whole = (parts[i][left], parts[i][~left]), held.pop(i)
        less = int(len(both[1]) < len(both[0]))
        fewer = count(both[less])  # the rest is the difference, exact as all sums are whole numbers
        for side, rows in enumerate(both):
            sums = fewer if side == less else whole - fewer
            parts.append(rows)
            judged.append(judge(rows, sums))
            children.append((-1, -1))
            if judged[-1][0][0] > 0:
                held[len(parts) - 1] = sums
                heapq.heappush(heap, (-judged[-1][0][0], len(parts) - 1))
    return [(*split[:3], *below, *sums) for (split, sums), below in zip(judged, children)]


class Growth:
    """A tree of one class while it grows: more may be split than counts in the end."""

    def __init__(self, s: Settings, rows: int):
        self.s, self.nodes = s, [Node(0, rows=rows)]

    def arrays(self) -> Tree:
        n = self.nodes
        return Tree(*(np.array([getattr(x, a) for x in n], np.int64) for a in ("feature", "bin", "left", "right")), np.zeros(len(n)), np.zeros(len(n)))

    def unknown(self) -> list[int]:
        return [x.number for x in self.nodes if not x.known]

    def learn(self, number: int, split: tuple, sums: tuple) -> None:
        node = self.nodes[number]
        node.known, node.split, node.sums = True, split if split[0] > 0 else None, sums

    def learn_all(self, number: int, below: list[tuple]) -> None:
        """What ``grown`` gives for the node."""
        place = [number, *range(len(self.nodes), len(self.nodes) + len(below) - 1)]
        self.nodes += [Node(i) for i in place[1:]]
        for i, (gain, feature, at, left, right, *sums) in zip(place, below):
            self.learn(i, (gain, feature, at, 0), tuple(sums))
            if left >= 0:
                node = self.nodes[i]
                node.gain, node.feature, node.bin, node.left, node.right = gain, feature, at, place[left], place[right]

    def simulate(self) -> tuple[list[int], list[int]]:
        """Best-first growth as far as it is known: the nodes split, and those that must be split ahead to go on."""
        done, leaves, heap = [], 1, []

        def push(number: int) -> None:
            node = self.nodes[number]
            if node.split:
                heapq.heappush(heap, (-node.split[0], number))

        push(0)
        while heap and leaves < self.s.leaves:
            _, number = heap[0]
            if self.nodes[number].left < 0:
                return done, [i for _, i in heapq.nsmallest(self.s.leaves - leaves, heap) if self.nodes[i].left < 0]
            heapq.heappop(heap)
            done.append(number)
            leaves += 1
            push(self.nodes[number].left)
            push(self.nodes[number].right)
        return done, []

    def split_ahead(self, numbers: list[int]) -> None:
        for i in numbers:
            node = self.nodes[i]
            node.gain, node.feature, node.bin, left = node.split
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [Node(node.left, rows=left), Node(node.right, rows=node.sums[2] - left)]

    def finished(self, done: list[int]) -> Tree:
        keep, order = set(done), [0]
        for i in order:
            if i in keep:
                order += [self.nodes[i].left, self.nodes[i].right]
        place = {old: new for new, old in enumerate(order)}
        inner = [i in keep for i in order]
        pick = lambda a: np.array([getattr(self.nodes[i], a) if own else -1 for i, own in zip(order, inner)], np.int64)
        child = lambda a: np.array([place[getattr(self.nodes[i], a)] if own else -1 for i, own in zip(order, inner)], np.int64)
        value = lambda x: -self.s.rate * x.sums[0] / (x.sums[1] + self.s.l2 * SCALE)
        values = np.array([0.0 if own or not done else value(self.nodes[i]) for i, own in zip(order, inner)])
        return Tree(pick("feature"), pick("bin"), child("left"), child("right"), values, np.array([self.nodes[i].gain if own else 0.0 for i, own in zip(order, inner)]))


def _rows_of(batch: pa.RecordBatch, width: int, classes: int, later: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, width)
    scores = np.frombuffer(b"".join(batch["scores"].to_pylist()), np.float64).reshape(n, classes).copy()
    for trees in later:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.leaves(bins)]
    return batch["key"].to_numpy(zero_copy_only=False), batch["y"].to_numpy(zero_copy_only=False), bins, scores


_STATE = "key long, y int, bins binary, scores binary"


def _state_batch(keys: np.ndarray, y: np.ndarray, bins: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(y, pa.int32()), pa.array([b.tobytes() for b in bins], pa.binary()),
                                       pa.array([x.tobytes() for x in scores], pa.binary())], names=["key", "y", "bins", "scores"])


def _first_state(edges: list[np.ndarray], start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.full((batch.num_rows, len(edges)), np.nan)
                for i, row in enumerate(batch["features"].to_pylist()):
                    own = np.array([np.nan if v is None else v for v in row or ()][: len(edges)], np.float64)
                    values[i, : len(own)] = own
                yield _state_batch(batch["key"].to_numpy(zero_copy_only=False), batch["y"].to_numpy(zero_copy_only=False), binned(values, edges), np.tile(start, (batch.num_rows, 1)))
    return run


def _moved_on(width: int, classes: int, later: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _state_batch(*_rows_of(batch, width, classes, later))
    return run


_SUMS = "part int, slot int, block int, loss double, sums binary"
#: The block of a row that holds rows.
_ROWS = -1


def _sums(width: int, classes: int, bins: int, growing: list[Tree], slots: list[tuple[int, int]], local: set[int], turn: int, s: Settings, parts: int):
    """Sums of this task's rows for the wanted (class, node) ``slots``, in blocks of features; rows for the ``local`` ones; the loss of all rows as slot -1.

    ``part`` deals the keys (slot, block) to ``parts`` tasks in turn, those of rows first.
    """
    wanted = [{} for _ in range(classes)]
    for slot, (k, node) in enumerate(slots):
        wanted[k][node] = slot
    summed = {slot: i for i, slot in enumerate(x for x in range(len(slots)) if x not in local)}
    place = {slot: i for i, slot in enumerate(sorted(local))}
    blocks = -(-width // BLOCK)

    def part(slot: int, block: int) -> int:
        return (0 if slot < 0 else place[slot] if block == _ROWS else len(local) + summed[slot] * blocks + block) % parts

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
        dealt = [(part(slot, block), slot, block, *rest) for slot, block, *rest in out]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*dealt)) or [[]] * 5, kinds)], names=["part", "slot", "block", "loss", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, size = np.zeros((3, len(summed) * width * bins)), 0.0, width * bins
        places = np.arange(width) * bins
        for rows_in in batches:
            if not rows_in.num_rows:
                continue
            keys, y, own, scores = _rows_of(rows_in, width, classes, [])
            g, h, losses = gradients(scores, y)
            loss += losses.sum()
            within, out = np.flatnonzero(drawn(keys, turn // s.rows_every, s)), []
            for k in range(classes):
                if not wanted[k]:
                    continue
                slot_of = np.full(len(growing[k].left), -1, np.int64)
                slot_of[list(wanted[k])] = list(wanted[k].values())
                slot = slot_of[growing[k].leaves(own[within])]
                for x in local.intersection(wanted[k].values()):
                    rows = within[slot == x]
                    if len(rows):
                        out.append((x, _ROWS, None, own[rows].tobytes() + g[rows, k].tobytes() + h[rows, k].tobytes()))
                sums_at = np.array([summed.get(x, -1) for x in range(len(slots))], np.int64)[slot]
                sums_at[slot < 0] = -1
                rows = within[sums_at >= 0]
                if len(rows):
                    first = sums_at[sums_at >= 0]  # counted one slot at a time: few rows do not touch the sums of all
                    for i in np.unique(first):
                        of = rows[first == i]
                        total[:, i * size : (i + 1) * size] += counted(own[of], g[of, k], h[of, k], places, size)
            yield batch(out)
        out = [(-1, 0, loss, None)]
        cube = total.reshape(3, len(summed), width, bins)
        for slot, i in summed.items():
            if width and cube[2, i, 0].any():
                out += [(slot, b // BLOCK, None, cube[:, i, b : b + BLOCK].tobytes()) for b in range(0, width, BLOCK)]
        yield batch(out)
    return run


_BEST = "slot int, loss double, node int, gain double, feature int, bin int, left int, right int, g double, h double, n long"


def _best(width: int, bins: int, masks: dict[int, np.ndarray], s: Settings):
    """Sorted rows of sums, one key after the other: the best split of each; of rows: the subtree."""
    def judged(slot: int, block: int, held: list) -> list[tuple]:
        if block == _ROWS:
            rows = [len(raw) // (width + 16) for raw in held]
            own = np.concatenate([np.frombuffer(raw, np.uint8, n * width).reshape(n, width) for raw, n in zip(held, rows)])
            g, h = (np.concatenate([np.frombuffer(raw, np.float64, n, n * (width + at)) for raw, n in zip(held, rows)]) for at in (0, 8))
            return [(slot, None, i, *node) for i, node in enumerate(grown(own, g, h, bins, masks[slot], s))]
        g, h, n = held[0]
        gain, feature, at, left = best_splits(g, h, n, masks[slot][block * BLOCK : block * BLOCK + len(g)], s)
        return [(slot, None, _ROWS, gain, feature + block * BLOCK, at, left, 0, float(g[0].sum()), float(h[0].sum()), int(n[0].sum()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, held, loss = [], None, [], None
        for batch in batches:
            for slot, block, part, raw in zip(*(batch[c].to_pylist() for c in ("slot", "block", "loss", "sums"))):
                if slot < 0:
                    loss = (loss or 0.0) + part
                    continue
                if (slot, block) != key:
                    out += judged(*key, held) if key else []
                    key, held = (slot, block), []
                if block == _ROWS:
                    held.append(raw)
                elif held:
                    held[0] += np.frombuffer(raw, np.float64).reshape(3, -1, bins)
                else:
                    held.append(np.frombuffer(raw, np.float64).reshape(3, -1, bins).copy())
        out += judged(*key, held) if key else []
        if loss is not None:
            out.append((-1, loss, *[None] * 9))
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64(), *[pa.int32()] * 4, pa.float64(), pa.float64(), pa.int64())
        columns = list(zip(*out)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _BEST.split(", ")])
    return run


def _pass(state: DataFrame, width: int, classes: int, bins: int, growths: list[Growth], slots: list[tuple[int, int]], turn: int, s: Settings) -> float:
    """Fill in what is below the ``slots``; gives the summed loss of all rows before this round."""
    growing = [g.arrays() for g in growths]
    masks = {i: chosen(turn, k, width, s) for i, (k, _) in enumerate(slots)}
    local = {i for i, (k, node) in enumerate(slots) if growths[k].nodes[node].rows <= LOCAL}
    keys = max(1, len(local) + (len(slots) - len(local)) * -(-width // BLOCK))
    parts = min(keys, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = state.mapInArrow(_sums(width, classes, bins, growing, slots, local, turn, s, parts), _SUMS)
    # a partition holds all rows of its keys, one key after the other; no more tasks than keys, and as many keys in each
    dealt = sums.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("slot", "block")
    best, below, loss = {}, {}, 0.0
    for r in dealt.mapInArrow(_best(width, bins, masks, s), _BEST).collect():  # a row for each wanted leaf and block of features, or node of a subtree
        if r["slot"] < 0:
            loss += r["loss"]
        elif r["node"] != _ROWS:
            below.setdefault(r["slot"], []).append((r["node"], tuple(r)[3:]))
        else:
            now = (r["gain"], -r["feature"], -r["bin"])
            if r["slot"] not in best or now > best[r["slot"]][0]:
                best[r["slot"]] = (now, (r["gain"], r["feature"], r["bin"], r["left"]), (r["g"], r["h"], r["n"]))
    for i, (k, node) in enumerate(slots):
        if i in below:
            growths[k].learn_all(node, [x for _, x in sorted(below[i])])
        else:
            _, split, totals = best.get(i, (None, (0.0, -1, -1, 0), (0.0, 1.0, 0)))
            growths[k].learn(node, split, totals)
    return loss


def fit(rows: DataFrame, label: str = "class_name", features: str = "features", key: str = "vec_id", s: Settings = Settings()) -> Model:
    """Boosted trees over all ``rows``; classes are indexed by name."""
    spark = rows.sparkSession
    ship(spark)
    shared_dir(spark)
    counts = sorted((r[label], r["n"]) for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] is not None)  # the class list
    if len(counts) < 2:
        raise ValueError("boosting needs rows of two classes at least")
    names, total = [c for c, _ in counts], sum(n for _, n in counts)
    model = Model(names, bin_edges(rows, s.bins, features), np.log([n / total for _, n in counts]))
    width, classes, bins = len(model.edges), len(names), s.bins
    index = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    start = rows.where(F.col(label).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), index.cast("int").alias("y"), F.col(features).alias("features"))
    state = start.coalesce(max(1, total // TASK_ROWS)).mapInArrow(_first_state(model.edges, model.start), _STATE).checkpoint()
    at_once, held = max(1, PASS_BYTES // max(1, width * bins * 24)), []
    for turn in range(s.rounds + 1):
        growths, loss = [Growth(s, total) for _ in range(classes)], None
        done: list[list[int]] = []
        while turn < s.rounds:
            slots = [(k, i) for k, g in enumerate(growths) for i in g.unknown()]
            for a in range(0, len(slots), at_once):
                found = _pass(state, width, classes, bins, growths, slots[a : a + at_once], turn, s)
                loss = found if loss is None else loss
            plans = [g.simulate() for g in growths]
            done = [d for d, _ in plans]
            if not any(ahead for _, ahead in plans):
                break
            for g, (_, ahead) in zip(growths, plans):
                g.split_ahead(ahead)
        if loss is None:
            loss = _pass(state, width, classes, bins, growths, [], turn, s)
        for old in held[:-1]:  # the scores of this round are held by now
            old.unpersist()
        held = held[-1:]
        model.losses.append(loss / SCALE / total)
        best = int(np.argmin(model.losses))
        if turn == s.rounds or turn - best >= s.patience or not any(done):
            model.trees = model.trees[:best]
            for old in held:
                old.unpersist()
            return model
        model.trees.append([g.finished(d) for g, d in zip(growths, done)])
        state = state.mapInArrow(_moved_on(width, classes, model.trees[-1:]), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if len(model.trees) % WRITTEN == 0:
            state = state.checkpoint()
    return model
