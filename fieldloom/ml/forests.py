"""Random forests grown by table jobs over binned features.

Nodes of many rows are split level by level from sums that the tasks make; a node of few rows sends them to one task,
which grows all below it. What is grown stays in a table of subtrees, and rows are sent to the subtrees they reach, so
neither the driver nor a task holds a whole forest and work and shuffles follow rows x trees x depth.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.ml.boosting import HIST_BYTES, as_blocks, bin_edges, blocks_of
from fieldloom.session import reliable

#: Rows that are routed together; rows to be predicted for each copy of the subtrees; pairs of rows and trees that are
#: worth a task; rows up to which all below a node is grown in one task.
SLICE, COPY_ROWS, TASK_ROWS, FEW = 4096, 1 << 20, 1 << 15, 16_384
#: Rows, and bytes of features, of a table that tasks hold whole, so that each grows and uses forests of its own.
WHOLE, WHOLE_BYTES = 1 << 18, 1 << 26
#: Cells of (node, bin, class) that a row is worth.
CELLS = 8
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    depth: int = 5
    least: int = 1  # drawn rows on each side of a split
    subset: str = "auto"
    entropy: bool = False
    seed: int = 42
    bins: int = 32

    def width(self, features: int) -> int:
        """Features that a node tries."""
        named = {"auto": features if self.trees == 1 else math.ceil(math.sqrt(features)), "all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
        if self.subset in named:
            return named[self.subset]
        share = float(self.subset)
        if share <= 0:
            raise ValueError(f"features to try: {self.subset}")
        return min(features, int(share) if self.subset.isdigit() else math.ceil(share * features))


def bag_counts(draw: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson of mean 1 by a hash of the row's own number."""
    h = draw.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = h ^ (h >> np.uint64(31))
    return np.searchsorted(_POISSON[:-1], (h >> np.uint64(11)) / float(1 << 53), "right").astype(np.uint8)


def worth(counts: np.ndarray, entropy: bool) -> np.ndarray:
    """What a node's class weights are worth; a split gains by what its sides are worth more than the node."""
    total = counts.sum(-1)
    if entropy:
        part = np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-300)), 0.0).sum(-1)
        return part - np.where(total > 0, total * np.log(np.maximum(total, 1e-300)), 0.0)
    return (counts**2).sum(-1) / np.maximum(total, 1e-300)


@dataclass
class Nodes:
    """A tree or part of one; ``feature`` is -1 at leaves, ``stats`` the class weights of each node."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray

    def walk(self, table: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(table), np.int64), np.arange(len(table))
        while len(rows):
            here = at[rows]
            rows = rows[self.feature[here] >= 0]
            here = at[rows]
            at[rows] = np.where(table[rows, self.feature[here]] <= self.bin[here], self.left[here], self.right[here])
        return at


def group_starts(group: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def first_best(gain: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (sorted) and the first place of the greatest gain of each."""
    start = group_starts(group)
    most = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(group))))
    place = np.flatnonzero(gain == most)
    return group[start], place[group_starts(group[place])]


def sort_order(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0 on: number and place are sorted as one, which is faster than by a list of places."""
    bits = max(len(key) - 1, 1).bit_length()
    if len(key) and int(key.max()) >> (62 - bits):
        return np.argsort(key, kind="stable")
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def grow(bins: np.ndarray, label: np.ndarray, count: np.ndarray, weight: np.ndarray, classes: int, s: ForestSettings, depth: int, key: tuple[int, int]) -> Nodes:
    """All below one node from its rows, a level at a time.

    While nodes have many rows, a feature's cuts are judged by sums of (node, bin, class), then by rows sorted by (node,
    bin). There whole weights take their sums of squares from running sums, without a column for each class.
    """
    features, tried = bins.shape[1], s.width(bins.shape[1])
    rng = np.random.default_rng([s.seed, *key])
    mass, count = count * weight, count.astype(np.float64)
    width = int(bins.max()) + 1 if len(bins) else 1
    exact = not s.entropy and bool((mass == np.rint(mass)).all()) and mass.sum() < 1 << 26  # squares of sums stay whole

    def sums(group: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(group * classes + label[rows], mass[rows], size * classes).reshape(size, classes)

    def by_cells(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, the greatest gain of a feature and the bin that has it, from sums of all cells, nodes side by side."""
        low = np.bincount(own * (classes * m) + beside, weights, width * classes * m).reshape(width, classes, m)
        for b in range(1, width):
            low[b] += low[b - 1]
        n_low, square = low.sum(1), (low * low).sum(1)
        high = np.subtract(low[-1], low, out=low)
        n_high = high.sum(1)
        high *= high
        gain = square / np.maximum(n_low, 1e-300) + high.sum(1) / np.maximum(n_high, 1e-300) - before
        if s.least > 1:
            drawn = np.cumsum(np.bincount(own * m + slot, count[rows], width * m).reshape(width, m), axis=0)
            gain = np.where((drawn >= s.least) & (drawn[-1] - drawn >= s.least), gain, 0.0)
        place = gain.argmax(0)
        return np.arange(m), gain[place, np.arange(m)], place

    def by_rows(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from rows sorted by node and bin; the rows of a node lie together, before as after."""
        order = sort_order(slot << 8 | own)
        own = own.take(order)
        last = np.flatnonzero((own[1:] != own[:-1]) & (slot[1:] == slot[:-1]))
        if not len(last):
            return last, np.zeros(0), last
        at = slot[last]
        start, end = (ends - sizes - 1)[at], (ends - 1)[at]

        def since(run: np.ndarray, upto: np.ndarray) -> np.ndarray:
            return run.take(upto) - np.where(start >= 0, run.take(start), 0.0)

        if exact:
            mine, of = weights.take(order), kind.take(order)
            turn = sort_order(of)
            run = mine.take(turn)
            held = np.empty(len(order))  # of the row's class, in its node before it
            held[turn] = np.cumsum(run) - run - earlier
            cross = np.cumsum(mine * shared.take(order))
            held *= 2
            held += mine
            held *= mine
            n_low, low = since(np.cumsum(mine), last), since(np.cumsum(held), last)
            high = squares[at] - 2 * since(cross, last) + low
            gain = low / np.maximum(n_low, 1e-300) + high / np.maximum(total[at] - n_low, 1e-300) - before[at]
        else:
            one = np.zeros((len(order), classes))
            one[np.arange(len(order)), label[rows[order]]] = weights[order]
            run = np.cumsum(one, 0)
            low = run[last] - np.where(start[:, None] >= 0, run[start], 0.0)
            gain = worth(low, s.entropy) + worth(run[end] - run[last], s.entropy) - before[at]
        if s.least > 1:
            drawn = np.cumsum(count[rows[order]])
            gain = np.where((since(drawn, last) >= s.least) & (drawn[end] - drawn[last] >= s.least), gain, 0.0)
        names, place = first_best(gain, at)
        return names, gain[place], own[last[place]]

    rows = np.arange(len(label))
    level = sums(np.zeros(len(rows), np.int64), rows, 1)
    stats, feature, cut, left, right = [level], [np.full(1, -1)], [np.zeros(1, np.int64)], [np.full(1, -1)], [np.full(1, -1)]
    first, size, slot = 0, 1, np.zeros(len(rows), np.int64)  # the level's first node, nodes so far, node of a row within the level
    while depth < s.depth:
        open_nodes = (level > 0).sum(1) > 1
        keep = open_nodes[slot]
        rows, slot = rows[keep], slot[keep]
        if not len(rows):
            break
        m = len(level)
        chosen, drawn = np.zeros((m, tried), np.int64), rng.random((m, features))
        chosen[open_nodes] = np.argsort(drawn[open_nodes], axis=1)[:, :tried]
        before = worth(level, s.entropy)
        best, best_f, best_b = 1e-9 * level.sum(1), np.full(m, -1), np.zeros(m, np.int64)
        order = sort_order(slot)
        rows, slot = rows[order], slot[order]
        sizes, weights, near, place_of = np.bincount(slot, minlength=m), mass.take(rows), bins.take(rows, axis=0).ravel(), np.arange(len(rows)) * features
        ends, kind, total, squares = np.cumsum(sizes), slot * classes + label[rows], level.sum(1), (level**2).sum(1)
        cells = exact and m * width * classes <= CELLS * len(rows)
        if cells:
            beside = label[rows] * m + slot
        elif exact:
            part = np.where(open_nodes[:, None], level, 0.0).ravel()  # of the nodes whose rows are here
            earlier, shared = np.repeat(np.cumsum(part) - part, np.bincount(kind, minlength=len(part))), level.ravel()[kind]
        for j in range(tried):
            own = near.take(place_of + chosen[:, j].repeat(sizes)).astype(np.int64)
            names, gain, place = (by_cells if cells else by_rows)(own)
            better = gain > best[names]
            names = names[better]
            best[names], best_f[names], best_b[names] = gain[better], chosen[names, j], place[better]
        split = np.flatnonzero(best_f >= 0)
        if not len(split):
            break
        child = np.full(m, -1)
        child[split] = np.arange(len(split)) * 2
        feature[-1], cut[-1] = best_f, best_b
        left[-1] = np.where(child >= 0, size + child, -1)
        right[-1] = np.where(child >= 0, size + child + 1, -1)
        stay = child[slot] >= 0
        rows, slot = rows[stay], slot[stay]
        slot = child[slot] + (bins[rows, best_f[slot]] > best_b[slot])
        level = sums(slot, rows, 2 * len(split))
        first, size, depth = size, size + len(level), depth + 1
        stats.append(level)
        feature.append(np.full(len(level), -1)), cut.append(np.zeros(len(level), np.int64))
        left.append(np.full(len(level), -1)), right.append(np.full(len(level), -1))
    return Nodes(*(np.concatenate(p).astype(np.int32) for p in (feature, cut, left, right)), np.concatenate(stats))


@dataclass
class Top:
    """The upper part of a tree, of nodes with many rows; ``ends`` are the nodes below which a subtree stands."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    depth: list[int] = field(default_factory=lambda: [0])

    def nodes(self) -> Nodes:
        return Nodes(*(np.array(v, np.int64) for v in (self.feature, self.bin, self.left, self.right)), np.zeros(0))

    def split(self, node: int, f: int, b: int, sides: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
        pair = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = f, b, *pair
        for side in sides:
            self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.right.append(-1)
            self.stats.append(side), self.depth.append(self.depth[node] + 1)
        return pair


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], value: str) -> Iterator[tuple[tuple, list[bytes]]]:
    """Values of neighbouring rows with one key."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row[value])
    if held:
        yield now, held


def ask_nodes(blocks: DataFrame, tops: list[Top], sums: dict[int, list[int]], grown: dict[int, list[int]], s: ForestSettings, shape: tuple[int, int, int], rows: int) -> DataFrame:
    """(tree, node, data): the best split of nodes that are summed, the subtree of nodes that are grown."""
    classes, features, width = shape
    tried = s.width(features)
    told = blocks.sparkSession.sparkContext.broadcast(pickle.dumps(([t.nodes() for t in tops], [t.depth for t in tops], sums, grown)))

    def subset(tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([s.seed, tree, node]).permutation(features)[:tried]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, _, to_sum, to_grow = pickle.loads(told.value)
        held: dict[tuple[int, int], np.ndarray] = {}
        for block in blocks_of(batches, 0, 0):
            found = []
            for t, top in enumerate(trees):
                if t not in to_sum and t not in to_grow:
                    continue
                count = bag_counts(block.draw, s.seed, t)
                at = np.where(count > 0, top.walk(block.bins), -1)
                for node in to_grow.get(t, ()):
                    rows = np.flatnonzero(at == node)
                    if len(rows):
                        found.append((t, node, block.weight[rows].tobytes() + block.label[rows].astype(np.int32).tobytes() + count[rows].tobytes() + block.bins[rows].tobytes()))
                for node in to_sum.get(t, ()):
                    rows = np.flatnonzero(at == node)
                    cells = held.setdefault((t, node), np.zeros((classes + 1, tried, width)))
                    for j, f in enumerate(subset(t, node)):
                        place = block.bins[rows, f].astype(np.int64)
                        cells[-1, j] += np.bincount(place, count[rows], width)
                        both = np.bincount(block.label[rows] * width + place, count[rows] * block.weight[rows], classes * width)
                        cells[:-1, j] += both.reshape(classes, width)
            for at in range(0, len(found), 64):
                t, n, data = zip(*found[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["tree", "node", "data"])
        for (t, n), cells in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([n], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["tree", "node", "data"])

    def best(key: tuple[int, int], parts: list[bytes]) -> tuple:
        cells = sum(np.frombuffer(p, np.float64) for p in parts).reshape(classes + 1, tried, width)
        run = np.cumsum(cells, 2)
        low, drawn = np.moveaxis(run[:-1], 0, -1), run[-1]
        whole = low[:, -1:]
        gain = worth(low, s.entropy) + worth(whole - low, s.entropy) - worth(whole, s.entropy)
        gain = np.where((drawn >= s.least) & (drawn[:, -1:] - drawn >= s.least), gain, 0.0)
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] <= 1e-9 * whole[0].sum():
            return whole[0, 0], -1, 0, None, None, 0, 0
        return whole[0, 0], int(subset(*key)[j]), int(b), low[j, b], whole[j, 0] - low[j, b], int(drawn[j, b]), int(drawn[j, -1] - drawn[j, b])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, depth, to_sum, _ = pickle.loads(told.value)
        for (t, n), parts in groups_of(batches, ("tree", "node"), "data"):
            if n in to_sum.get(t, ()):
                data = best((t, n), parts)
            else:
                cut = [[], [], [], []]
                for raw in parts:
                    size = len(raw) // (13 + features)
                    for held, kind, at in zip(cut, (np.float64, np.int32, np.uint8), (0, 8 * size, 12 * size)):
                        held.append(np.frombuffer(raw, kind, size, at))
                    cut[3].append(np.frombuffer(raw, np.uint8, offset=13 * size).reshape(size, features))
                weight, label, count, bins = (np.concatenate(c) for c in cut)
                data = grow(bins, label.astype(np.int64), count, weight, classes, s, depth[t][n], (t, n))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([n], pa.int32()), pa.array([pickle.dumps(data)], pa.binary())], ["tree", "node", "data"])

    keys = sum(map(len, sums.values())) + sum(map(len, grown.values()))
    parts = max(1, min(keys, max(4 * blocks.sparkSession.sparkContext.defaultParallelism, keys // 16), math.ceil(rows * len(tops) / TASK_ROWS)))
    dealt = blocks.mapInArrow(gather, _NODES).repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", "data")
    return reliable(dealt.mapInArrow(choose, _NODES), "forest")


_NODES = "tree int, node int, data binary"


class RandomForest(Estimator):
    """A forest as an estimator: Poisson bags, binned cuts, shares of the classes in each leaf."""

    def __init__(self, settings: ForestSettings, weight: str | None = None, features: str = "features", label: str = "lc"):
        super().__init__()
        self.settings, self.weight, self.features, self.label = settings, weight, features, label

    def getMaxDepth(self) -> int:
        return self.settings.depth

    def getNumTrees(self) -> int:
        return self.settings.trees

    def getImpurity(self) -> str:
        return "entropy" if self.settings.entropy else "gini"

    def getMinInstancesPerNode(self) -> int:
        return self.settings.least

    def _fit(self, dataset: DataFrame) -> RandomForestModel:
        s, spark = self.settings, dataset.sparkSession
        x = vector_to_array(self.features).alias("x")
        flat = dataset.select(F.col(self.label).cast("int").alias("label"), F.lit(-1).alias("fold"), (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("weight"), x)
        flat = reliable(flat.where("label IS NOT NULL AND weight > 0").withColumn("draw", F.monotonically_increasing_id()))
        rows, most = flat.agg(F.count("*"), F.max("label")).first()
        if not rows:
            raise ValueError("no rows to learn from")
        edges = bin_edges(flat, "x", s.bins)
        shape = (most + 1, len(edges), max(len(e) for e in edges) + 1)
        parts = max(min(spark.sparkContext.defaultParallelism, math.ceil(rows / SLICE)), math.ceil(rows * len(edges) / (1 << 26)))
        blocks = reliable(as_blocks(flat.repartition(parts, "draw").sortWithinPartitions("draw"), edges, np.zeros((0, 0))))
        tops = [Top() for _ in range(s.trees)]
        large = {t: [0] for t in range(s.trees)} if rows > FEW else {}
        few = {} if large else {t: [0] for t in range(s.trees)}
        done: list[tuple[int, int, bytes]] = []
        room = max(1, HIST_BYTES // (8 * (shape[0] + 1) * s.width(shape[1]) * shape[2]))

        def leaf(t: int, n: int) -> None:
            end = np.full(1, -1, np.int32)
            done.append((t, n, pickle.dumps(Nodes(end, end, end, end, tops[t].stats[n][None, :]))))

        while large:
            todo, large = [(t, n) for t, nodes in large.items() for n in nodes], {}
            for at in range(0, len(todo), room):
                asked: dict[int, list[int]] = {}
                for t, n in todo[at : at + room]:
                    asked.setdefault(t, []).append(n)
                for t, n, data in ask_nodes(blocks, tops, asked, {}, s, shape, rows).orderBy("tree", "node").collect():
                    whole, f, b, low, high, *drawn = pickle.loads(data)
                    top = tops[t]
                    top.stats[n] = whole
                    if f < 0 or top.depth[n] >= s.depth:
                        leaf(t, n)
                        continue
                    for child, size in zip(top.split(n, f, b, (low, high)), drawn, strict=True):
                        if top.depth[child] >= s.depth or (top.stats[child] > 0).sum() < 2:
                            leaf(t, child)
                        else:
                            (large if size > FEW else few).setdefault(t, []).append(child)
        table = spark.createDataFrame(done, _NODES)
        if few:
            table = table.union(ask_nodes(blocks, tops, {}, few, s, shape, rows)) if done else ask_nodes(blocks, tops, {}, few, s, shape, rows)
        return RandomForestModel(table, tops, edges, shape[0], self.features)


class RandomForestModel(Model):
    """``table`` holds the subtrees (tree, node of the top, nodes), ``tops`` what stands above them."""

    def __init__(self, table: DataFrame, tops: list[Top], edges: list[np.ndarray], classes: int, features: str):
        super().__init__()
        self.table, self.tops, self.edges, self.numClasses, self.getNumTrees, self.features = table, tops, edges, classes, len(tops), features

    def node_table(self) -> DataFrame:
        """(tree, id, left, right, f, cut, stats) of every node; the root's id is 0, children of leaves are -1."""
        edges, spark = self.edges, self.table.sparkSession
        schema = "tree int, id long, left long, right long, f int, cut double, stats array<double>"

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    p: Nodes = pickle.loads(row["data"])
                    base = (row["node"] + 1) << 32
                    number = base + np.arange(len(p.feature))
                    number[0] = row["node"]
                    inner = p.feature >= 0
                    sides = [pa.array(np.where(inner, base + side.astype(np.int64), -1), pa.int64()) for side in (p.left, p.right)]
                    cuts = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(p.feature, p.bin, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(number), row["tree"], np.int32)), pa.array(number), *sides, pa.array(p.feature.astype(np.int32)), pa.array(cuts, pa.float64()), pa.array(list(p.stats), pa.list_(pa.float64()))],
                        ["tree", "id", "left", "right", "f", "cut", "stats"],
                    )

        upper = [
            (t, n, top.left[n], top.right[n], top.feature[n], float(edges[top.feature[n]][top.bin[n]]), top.stats[n].tolist())
            for t, top in enumerate(self.tops) for n in range(len(top.feature)) if top.feature[n] >= 0
        ]
        lower = self.table.mapInArrow(unpack, schema)
        return lower.union(spark.createDataFrame(upper, schema)) if upper else lower

    def shares(self, rows: DataFrame, size: int) -> DataFrame:
        """(_row, _shares) of ``size`` ``rows(_row, x)``: sums over the trees of the class shares in the leaf that a row reaches.

        Slices of rows go to the subtrees that they reach, each in a few copies if there are many rows, and what they
        find there comes back by slice.
        """
        spark, edges, classes = rows.sparkSession, self.edges, self.numClasses
        told = spark.sparkContext.broadcast(pickle.dumps([t.nodes() for t in self.tops]))
        features, copies = len(edges), 1 + size // COPY_ROWS

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = pickle.loads(told.value)
            for whole in batches:
                for begin in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(begin, SLICE)
                    ids = batch.column("_row").to_numpy(zero_copy_only=False).astype(np.int64)
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8)
                    out = []
                    for t, top in enumerate(trees):
                        at = top.walk(bins)
                        for n in np.unique(at).tolist():
                            mine = np.flatnonzero(at == n)
                            out.append((t, n, int(ids[0] // SLICE % copies), 1, int(ids[0]), ids[mine].tobytes() + bins[mine].tobytes()))
                    for at in range(0, len(out), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 64], strict=True), _ROUTE_KINDS, strict=True)], _ROUTE_NAMES)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = share = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        part = pickle.loads(row["data"])
                        share = part.stats / part.stats.sum(1, keepdims=True)
                        continue
                    n = len(row["data"]) // (8 + features)
                    bins = np.frombuffer(row["data"], np.uint8, offset=8 * n).reshape(n, features)
                    data = row["data"][: 8 * n] + share[part.walk(bins)].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), pa.array([row["tree"]], pa.int32()), pa.array([row["node"]], pa.int32()), pa.array([data], pa.binary())], ["slice", "tree", "node", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, sums = None, None, None
            for (now,), parts in groups_of(batches, ("slice",), "data"):
                each = [(np.frombuffer(p, np.int64, len(p) // (8 + 8 * classes)), p) for p in parts]
                ids = np.unique(np.concatenate([i for i, _ in each]))
                sums = np.zeros((len(ids), classes))
                for i, p in each:
                    sums[np.searchsorted(ids, i)] += np.frombuffer(p, np.float64, offset=8 * len(i)).reshape(len(i), classes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(sums), pa.list_(pa.float64()))], ["_row", "_shares"])

        routed = rows.mapInArrow(route, _ROUTE)
        trees = self.table.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slice"), "data")
        parts = max(1, min(max(4 * spark.sparkContext.defaultParallelism, size * len(self.tops) // (1 << 24)), math.ceil(size * len(self.tops) / TASK_ROWS)))
        met = trees.union(routed).repartition(parts, "tree", "node", "copy").sortWithinPartitions("tree", "node", "copy", "kind", "slice")
        back = met.mapInArrow(meet, "slice long, tree int, node int, data binary").repartition(parts, "slice").sortWithinPartitions("slice", "tree", "node")
        return back.mapInArrow(add, "_row long, _shares array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = reliable(dataset.withColumn("_row", F.monotonically_increasing_id()))
        found = self.shares(held.select("_row", vector_to_array(self.features).alias("x")), held.count())
        probability = F.transform("_shares", lambda v: v / F.lit(float(len(self.tops))))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return held.join(found, "_row").select(*dataset.columns, array_to_vector(probability).alias("probability"), best.alias("prediction"))


_ROUTE = "tree int, node int, copy int, kind int, slice long, data binary"
_ROUTE_NAMES = [c.split()[0] for c in _ROUTE.split(", ")]
_ROUTE_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


# --- forests of many folds ------------------------------------------------------


def exact_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """``bin_edges`` of rows x features at hand, from all values."""
    out = []
    for f in range(x.shape[1]):
        v = np.sort(x[:, f][~np.isnan(x[:, f])])
        places = [math.ceil(i / bins * len(v)) - 1 for i in range(1, bins)]
        out.append(np.unique(v[places]) if len(v) else np.zeros(0))
    return out


def forest_shares(x: np.ndarray, label: np.ndarray, weight: np.ndarray, draw: np.ndarray, train: np.ndarray, held: np.ndarray, s: ForestSettings) -> np.ndarray:
    """Sums over the trees of a forest, grown on the rows ``train``, of the class shares that the rows ``held`` reach."""
    classes = int(label[train].max()) + 1
    edges = exact_edges(x[train], s.bins)
    binned = [np.stack([np.searchsorted(e, x[rows, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8) for rows in (train, held)]
    label, weight, out = label[train].astype(np.int64), weight[train], np.zeros((len(held), classes))
    for t in range(s.trees):
        count = bag_counts(draw, s.seed, t)
        rows = np.flatnonzero(count)
        if len(rows):
            tree = grow(binned[0].take(rows, axis=0), label[rows], count[rows], weight[rows], classes, s, 0, (t, 0))
            out += (tree.stats / tree.stats.sum(1, keepdims=True))[tree.walk(binned[1])]
    return out


def held_rounds(rows: DataFrame, forest: RandomForest, folds: str, n_rounds: int, n_folds: int, keep: list[str]) -> DataFrame | None:
    """(*keep, round, fold, prediction) of every row and round by a forest grown on the round's other folds; ``folds`` is
    an array with a fold for each round. None if the table is too large for a task to hold it whole.

    A task for each forest reads the table, grows the forest and sends its held-out rows to it, so no table, tree or row
    is shuffled or stored for a forest. The trees are those of ``fit``, where its bin ends are exact.
    """
    s, spark = forest.settings, rows.sparkSession
    weight = F.coalesce(F.col(forest.weight).cast("double"), F.lit(0.0)) if forest.weight else F.lit(1.0)
    each = F.array(*[F.coalesce(F.get(folds, F.lit(r)).cast("int"), F.lit(-1)) for r in range(n_rounds)])
    flat = rows.select(*keep, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(forest.label).cast("int"), F.lit(-1)).alias("label"), weight.alias("weight"), each.alias("folds"), vector_to_array(forest.features).alias("x"))
    n_rows, width = flat.agg(F.count("*"), F.max(F.size("x"))).first()
    if n_rows > WHOLE or n_rows * (width or 0) * 8 > WHOLE_BYTES:
        return None
    flat = reliable(flat)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                parts = [batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("_row", np.int64), ("label", np.int32), ("weight", np.float64))]
                parts += [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(batch.num_rows, -1) for c, t in (("folds", np.int32), ("x", np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                found.setdefault(row["model"], []).append(pickle.loads(row["data"]))
        for model, blocks in found.items():
            ids, label, amount, fold, x = (np.concatenate(p) for p in zip(*blocks, strict=True))
            blocks.clear()
            fold = fold[:, model // n_folds]
            order = np.argsort(ids, kind="stable")
            train = order[((fold != model % n_folds) & (fold >= 0) & (label >= 0) & (amount > 0))[order]]
            held = np.flatnonzero(fold == model % n_folds)
            if not len(train):
                raise ValueError("no rows to learn from")
            # the draws of a table of the training rows alone: partition, and place within it
            part = ids[train] >> 33
            draw = (part << 33) + np.arange(len(train)) - np.searchsorted(part, part)
            best = forest_shares(x, label, amount, draw, train, held, s).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(np.full(len(held), model, np.int32)), pa.array(best.astype(np.float64))], ["_row", "_model", "prediction"])

    blocks = reliable(flat.mapInArrow(pack, "data binary")).coalesce(1)
    models = spark.range(0, n_rounds * n_folds, 1, n_rounds * n_folds).select(F.col("id").cast("int").alias("model"))
    # a plain product: a task reads all blocks, and nothing is shuffled or broadcast
    met = models.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(run, "_row long, _model int, prediction double")
    named = reliable(met).join(flat.select("_row", *keep), "_row")
    return named.select(*keep, F.floor(F.col("_model") / n_folds).cast("int").alias("round"), (F.col("_model") % n_folds).cast("int").alias("fold"), "prediction")
