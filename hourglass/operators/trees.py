"""Decision trees without bins and forests without a depth limit.

``ExactTree`` searches every split.  Each feature gets an attribute list (value, row, label), sorted once over ranges;
a level of the tree is two scans: totals of every node in every range, then the prefix sums that go on from the totals
of the ranges before.  Ranges that cannot hold a better split than their own ends (the score is convex in the left side's count
and sum) are skipped in the second scan.

``GrownForest`` grows every tree until its leaves are pure.  Large nodes are split on distributed histograms; a node of at most
``HAND_OVER`` rows is handed over to a task, which goes on with exact splits to the end, all nodes of a level at once.  A
tree is its upper part, a table of bounded size, and one row of arrays for each node handed over; rows are scored by
a join on that node.

Both split on the largest decrease of squared error, which for labels 0 and 1 is the decrease of the Gini impurity.  A split sends
``x <= threshold`` to the left, thresholds are midpoints; equal scores (within ``_tie``) go to the first feature, then to the smallest threshold.
Rows with a NULL, NaN or infinite feature, or without a label, are not learned from; scoring sends NaN to the right and NULL features as NaN.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_of
from ..session import materialise
from .neighbours import _points, cogrouped
from .saved import TableModel

HAND_OVER = 50_000           # rows of a node that one task finishes
BINS = 64                    # of an upper node's histogram
SAMPLE = 20_000              # rows whose quantiles are the first bin edges
TREES_AT_ONCE = 25           # trees that share the passes of the upper levels
ASK_ROWS = 50_000            # rows scored with one node's arrays in one task
RANGES = 200                 # of the attribute lists at most: bounds what the driver sees; up to 200, Spark's writers hold no entries in memory
RANGE_ROWS = 1 << 18         # entries of a range before there are RANGES
SCAN_ROWS = 1 << 17          # rows whose cells a task sums at once
BRANCH_ROWS = 32             # rows a node from which on a batch goes through a tree node by node
CELLS_A_ROW = 2              # a level's cells of a feature, up to which its sums come from cells
BLOCK = 1 << 20              # numbers of the points in a block of the attribute lists


# ---------------------------------------------------------------- one tree
@dataclass
class Nodes:
    """A tree as arrays: a leaf has feature -1; children follow their parent."""

    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    rows: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = at, at + 1
        for name, none in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0), ("rows", 0.0), ("gain", 0.0)):
            getattr(self, name).extend([none, none])
        return at, at + 1

    def split_all(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The same for many nodes: the children's numbers."""
        at, new = len(self.feature), 2 * len(nodes)
        for node, *own in zip(nodes.tolist(), feature.tolist(), threshold.tolist(), gain.tolist(), range(at, at + new, 2)):
            self.feature[node], self.threshold[node], self.gain[node], self.left[node] = own
            self.right[node] = own[-1] + 1
        for name, none in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0), ("rows", 0.0), ("gain", 0.0)):
            getattr(self, name).extend([none] * new)
        return np.arange(at, at + new)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.threshold, float), np.array(self.left, np.int32), np.array(self.right, np.int32))

    def depth(self) -> int:
        deep = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[i]] = deep[self.right[i]] = deep[i] + 1
        return max(deep)


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The leaf of each row, all rows a level at a time."""
    at = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        node = at[going]
        f = feature[node]
        at[going] = np.where(x[going, f] <= threshold[node], left[node], right[node])
        going = going[feature[at[going]] >= 0]
    return at


def routed(columns: np.ndarray, rows: np.ndarray, tree: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in wanted leaves and their leaves, node by node where a node has enough rows; ``columns``: a row a feature.
    Branches without a wanted leaf are left where they part."""
    if len(rows) < BRANCH_ROWS * len(wanted):
        leaf = descend(columns[:, rows].T, *tree)
        here = wanted[leaf]
        return rows[here], leaf[here]
    feature, threshold, left, right = (a.tolist() for a in tree)
    useful = wanted.tolist()
    for node in range(len(feature) - 1, -1, -1):                 # children follow their parent
        if feature[node] >= 0:
            useful[node] = useful[left[node]] or useful[right[node]]
    found, open_nodes = [], [(0, rows)] if useful[0] else []
    while open_nodes:
        node, own = open_nodes.pop()
        if feature[node] < 0:
            found.append((node, own))
        elif len(own):
            low = columns[feature[node]].take(own) <= threshold[node]
            for child, side in ((left[node], low), (right[node], ~low)):
                if useful[child]:
                    open_nodes.append((child, own.compress(side)))
    return (np.concatenate([np.zeros(0, np.int64), *(own for _, own in found)]),
            np.repeat(np.array([node for node, _ in found], np.int64), [len(own) for _, own in found]))


def _mix(a) -> np.ndarray:
    """A 64-bit hash of unsigned numbers."""
    with np.errstate(over="ignore"):
        a = (np.asarray(a, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


def _tie(best, rows, spread):
    """Scores this close are equal: rounding must not choose a split."""
    return 1e-9 * np.maximum(best, 0) + 1e-13 * rows * spread * spread


def _midpoint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mid = a + (b - a) / 2
    return np.where((mid >= b) | ~np.isfinite(mid), a, mid)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None, tried: int | None = None, seed: int = 0) -> Nodes:
    """A tree of exact splits on weighted rows in memory, to purity unless ``max_depth`` ends it.

    ``tried``: features a node may split on, drawn for every node among those that still vary in it."""
    return grow_all(x, y, w, np.zeros(len(y), np.int64), [seed], max_depth, tried)[0]


def grow_all(x: np.ndarray, y: np.ndarray, w: np.ndarray, place: np.ndarray, seeds: Sequence[int], max_depth: int | None = None,
             tried: int | None = None) -> list[Nodes]:
    """The trees of several sets of rows, a level of all of them at once; ``place`` numbers a row's set, none is empty."""
    columns, starts = _grown(x, y, w, place, seeds, max_depth, tried)
    return [Nodes(**{name: v[a:z].tolist() for name, v in columns.items()}) for a, z in zip(starts, starts[1:])]


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, place: np.ndarray, seeds: Sequence[int], max_depth: int | None = None,
           tried: int | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of the nodes of all trees, one tree after another, and where each begins.

    Rows lie in order of their nodes; a split parts that order into all left rows, then all right rows, both stable.  While a level's
    nodes have fewer cells (node, value) than rows, a feature's sums come from its cells.  From then on it keeps its rows in order of
    (node, value), parted in the same way, so nothing is sorted twice."""
    k, wy, place = x.shape[1], w * y, place.astype(np.int64)
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(k)))
    coded = np.stack(codes, axis=1).astype(np.int32).ravel()                  # of a row's feature: row * k + feature
    codes = [c.astype(np.uint16 if len(v) <= 1 << 16 else np.int32) for c, v in zip(codes, values)]
    order = [None] * k                                                        # of the features that left their cells
    rows, pairs, right = np.argsort(place, kind="stable"), np.zeros(len(y), complex), np.zeros(len(y), bool)
    pairs.real = w                                                            # rows and label about the node's mean, summed together
    # of the level's nodes, in the order in which their rows lie: number, key, tree, rows in memory
    ids, keys, roots, count = np.arange(len(seeds)), _mix(seeds), np.arange(len(seeds)), np.bincount(place, minlength=len(seeds))
    base, depth, levels = 0, 0, []
    while len(ids):
        starts = np.cumsum(count) - count
        own_y = y.take(rows)
        n, mean = np.add.reduceat(w.take(rows), starts), np.add.reduceat(wy.take(rows), starts)
        mean /= n
        low, high = (f.reduceat(own_y, starts) for f in (np.minimum, np.maximum))
        level = {"feature": np.full(len(ids), -1, np.int32), "left": np.zeros(len(ids), np.int32), "right": np.zeros(len(ids), np.int32),
                 **{name: np.zeros(len(ids)) for name in ("threshold", "value", "rows", "gain")}, "owner": np.zeros(len(ids), np.int64)}
        levels.append(level)
        own = ids - base
        level["value"][own], level["rows"][own], level["owner"][own] = np.where(low < high, mean, low), n, roots
        active = low < high
        if depth == max_depth or not active.any():
            break
        # rows of pure nodes leave
        if not active.all():
            stay = np.repeat(active, count)
            order = [o if o is None else o.compress(stay) for o in order]
            rows, own_y = rows.compress(stay), own_y.compress(stay)
            own, keys, roots, count, n, mean, spread = (v[active] for v in (own, keys, roots, count, n, mean, high - low))
            starts = np.cumsum(count) - count
        else:
            spread = high - low
        at, own_w = np.repeat(np.arange(len(own)), count), w.take(rows)
        own_y -= mean.take(at)
        own_y *= own_w
        for f in range(k):
            if order[f] is None and len(own) * len(values[f]) > CELLS_A_ROW * len(rows):
                order[f] = rows.take(np.argsort(at * len(values[f]) + codes[f].take(rows), kind="stable"))
        if any(o is not None for o in order):
            pairs.imag[rows] = own_y
        draws = tried is not None and tried < k
        looked = np.ones((len(own), k), bool)                                  # a feature in cells may turn out to have one value
        for f in range(k):
            if order[f] is not None:
                looked[:, f] = codes[f][order[f][starts]] < codes[f][order[f][starts + count - 1]]
            elif draws:
                c = codes[f].take(rows)
                looked[:, f] = np.minimum.reduceat(c, starts) < np.maximum.reduceat(c, starts)
        if draws:
            drawn = _mix(keys[:, None] + np.arange(1, k + 1, dtype=np.uint64)) >> np.uint64(1)
            drawn[~looked] = np.uint64(2 ** 64 - 1)
            looked &= np.argsort(np.argsort(drawn, axis=1), axis=1) < tried
        best, where, last = np.full((len(own), k), -np.inf), np.zeros((len(own), k)), np.zeros((len(own), k), np.int32)
        for f in range(k):
            nodes = np.flatnonzero(looked[:, f])
            if not len(nodes):
                continue
            taken = None if len(nodes) == len(own) else np.repeat(looked[:, f], count)
            if order[f] is None:
                of = [v if taken is None else v.compress(taken) for v in (rows, at, own_w, own_y)]
                if taken is not None:
                    of[1] = (np.cumsum(looked[:, f]) - 1).take(of[1])
                wide = len(values[f])
                cell = of[1] * wide
                cell += codes[f].take(of[0])
                cn, cs = (np.bincount(cell, v, len(nodes) * wide) for v in of[2:])
                held = np.flatnonzero(cn)
                owner, c = np.divmod(held, wide)
                size = np.bincount(owner, minlength=len(nodes))
                cn, cs = np.cumsum(cn.take(held)), np.cumsum(cs.take(held))
                turns = np.ones(len(held) - 1, bool)
            else:
                o, size = order[f], count
                if taken is not None:
                    o, size = o.compress(taken), count[nodes]
                c, sums = codes[f].take(o), np.cumsum(pairs.take(o))
                cn, cs = sums.real, sums.imag
                turns = c[:-1] < c[1:]
            end = np.cumsum(size)
            turns[end[:-1] - 1] = False
            cut = np.flatnonzero(turns)                                        # the left side ends here
            first = np.searchsorted(cut, end - size)
            cuts = np.diff(np.append(first, len(cut)))
            if order[f] is None and not cuts.all():                            # nodes that hold one value
                some = cuts > 0
                before = np.concatenate([[0], end[:-1]])
                nodes, size, end, first, cuts = nodes[some], size[some], end[some], first[some], cuts[some]
                if not len(nodes):
                    continue
                before = before[some]
            else:
                before = end - size
            ln, ls = cn.take(cut), cs.take(cut)
            ln -= np.repeat(np.where(before > 0, cn[before - 1], 0.0), cuts)
            ls -= np.repeat(np.where(before > 0, cs[before - 1], 0.0), cuts)
            ls *= ls
            score = ls / ln
            score += np.divide(ls, np.subtract(np.repeat(n[nodes], cuts), ln, out=ln), out=ls)
            top = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score >= np.repeat(top - _tie(top, n[nodes], spread[nodes]), cuts))
            c = c[cut[hit[np.searchsorted(hit, first)]][:, None] + np.arange(2)].astype(np.int64)
            best[nodes, f], where[nodes, f], last[nodes, f] = top, _midpoint(values[f][c[:, 0]], values[f][c[:, 1]]), c[:, 0]
        most = best.max(axis=1)
        feature = (best >= (most - _tie(most, n, spread))[:, None]).argmax(axis=1)
        whole = np.arange(len(own))
        splits = most > -np.inf
        if not splits.any():
            break
        # children are numbered in order of their parents' numbers
        chosen = own[splits]
        rank = np.empty(len(chosen), np.int64)
        rank[np.argsort(chosen)] = np.arange(len(chosen))
        base += len(ids)
        left = base + 2 * rank
        for name, v in (("feature", feature), ("threshold", where[whole, feature]), ("gain", best[whole, feature])):
            level[name][chosen] = v[splits]
        level["left"][chosen], level["right"][chosen] = left, left + 1
        stay = None
        if not splits.all():
            stay = np.repeat(splits, count)
            rows, at = rows.compress(stay), at.compress(stay)
        side = coded.take(rows * k + feature.take(at)) > last[whole, feature].take(at)
        right[rows] = side
        for f in range(k):
            if order[f] is not None:
                o = order[f] if stay is None else order[f].compress(stay)
                to = right.take(o)
                order[f] = np.concatenate([o.compress(~to), o.compress(to)])
        count = np.concatenate([np.bincount(at.compress(v), minlength=len(own))[splits] for v in (~side, side)])
        rows = np.concatenate([rows.compress(~side), rows.compress(side)])
        with np.errstate(over="ignore"):
            keys = np.concatenate([_mix(keys[splits] * np.uint64(2)), _mix(keys[splits] * np.uint64(2) + np.uint64(1))])
        ids, roots, depth = np.concatenate([left, left + 1]), np.tile(roots[splits], 2), depth + 1
    columns = {name: np.concatenate([v[name] for v in levels]) for name in levels[0]}
    owner = columns.pop("owner")
    order, starts = np.argsort(owner, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(seeds)))])
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order)) - starts[owner[order]]
    inner = columns["feature"] >= 0
    for name in ("left", "right"):
        columns[name] = np.where(inner, number[columns[name]], 0).astype(np.int32)
    return {name: columns[name][order] for name in vars(Nodes())}, starts


def _vector(features: Sequence[str]):
    return F.array(*[F.coalesce(col_of(c).cast("double"), F.lit(float("nan"))) for c in features])


def _learned(df: DataFrame, inputs: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """``id, x, y`` of the rows that are learned from; without ``keys``, equal rows share an id."""
    rows = df.select(F.xxhash64(*map(col_of, keys or [*inputs, label])).alias("id"), _vector(inputs).alias("x"), col_of(label).cast("double").alias("y"))
    return rows.where(F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col("y").isNotNull() & ~F.isnan("y"))


class _Scored:
    """Adds ``prediction``, and for classes 0 and 1 ``probability``, from a column of mean labels."""

    def scored(self, df: DataFrame, mean: str) -> DataFrame:
        if self.classes:
            share = F.col(mean)
            df = df.withColumn("probability", array_to_vector(F.array(1 - share, share))).withColumn("prediction", (share > 0.5).cast("double"))
        else:
            df = df.withColumn("prediction", F.col(mean))
        return df.drop(mean)


# ---------------------------------------------------------------- exact tree
class ExactTree(Estimator):
    """A tree of at most ``max_depth`` levels; every threshold of every feature is looked at."""

    def __init__(self, inputs: Sequence[str], label: str = "label", max_depth: int = 8, classes: bool = False, ranges: int = RANGES,
                 range_rows: int = RANGE_ROWS):
        super().__init__()
        self.inputs, self.label, self.max_depth, self.classes, self.ranges, self.range_rows = list(inputs), label, max_depth, classes, ranges, range_rows

    def _lists(self, rows: DataFrame) -> DataFrame:
        """The attribute lists: sorted by feature and value over ranges."""
        n, k = rows.count(), len(self.inputs)
        width = int(min(self.ranges, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * k // self.range_rows))))
        entries = rows.select(F.posexplode("x").alias("feature", "value"), "x", "y", "id")
        # the id parts a value that many rows share
        return entries.repartitionByRange(width, "feature", "value", "id").sortWithinPartitions("feature", "value")

    def _fit(self, dataset: DataFrame) -> "ExactTreeModel":
        rows = _learned(dataset, self.inputs, self.label)
        # written once, so a range is the same in every scan
        lists, tree = materialise(_blocks(self._lists(rows), len(self.inputs))), Nodes()
        level = [0]
        for depth in range(self.max_depth + 1):
            totals = _totals(lists, tree, level)
            if not len(totals):
                break
            open_nodes = _settle(tree, totals, depth == self.max_depth)
            if not open_nodes:
                break
            level = []
            for node, feature, threshold, gain in _best_splits(lists, tree, totals, open_nodes):
                level += tree.split(node, feature, threshold, gain)
            if not level:
                break
        return ExactTreeModel(self.inputs, tree, self.classes)


_TOTALS = "feature int, node int, range int, n long, s double, low double, high double, first double, last double"


def _blocks(lists: DataFrame, width: int) -> DataFrame:
    """The lists in blocks of about ``BLOCK`` numbers, each column's as plain bytes: a scan takes them as they lie, entry by entry
    nothing is turned into rows and back."""
    def pack(batches):
        for t in _gathered(batches, max(1, BLOCK // width)):
            columns = [t.column("feature").to_numpy().astype(np.int32), t.column("value").to_numpy(), t.column("y").to_numpy(), _points(t)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns],
                                             names=["feature", "value", "y", "x"])

    return lists.select("feature", "value", "y", "x").mapInArrow(pack, "feature binary, value binary, y binary, x binary")


def _entries(batches):
    """Feature, value, y and x of each block."""
    for b in batches:
        for i in range(b.num_rows):
            feature, value, y, x = (np.frombuffer(b.column(c)[i].as_buffer(), ty) for c, ty in
                                    (("feature", np.int32), ("value", float), ("y", float), ("x", float)))
            yield feature, value, y, x.reshape(len(y), -1)


def _segments(feature: np.ndarray, value: np.ndarray, y: np.ndarray, x: np.ndarray, tree: tuple, wanted: np.ndarray):
    """The block's entries of wanted nodes in order of (feature, node), values ascending: feature and node, value, y, and heads."""
    node = descend(x, *tree)
    take = np.flatnonzero(wanted[node])
    key = feature[take].astype(np.int64) * len(wanted) + node[take]
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")
    take, key = take[order], key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key, value[take], y[take], heads


def _totals(lists: DataFrame, tree: Nodes, level: Sequence[int]) -> np.ndarray:
    """Count, sum, extremes of the label and the ends of the values of each (feature, node) in each range: at most
    ranges x nodes rows reach the driver."""
    arrays, size = tree.arrays(), len(tree.feature)
    wanted = np.zeros(size, bool)
    wanted[list(level)] = True

    def scan(batches):
        from pyspark import TaskContext

        found: dict[int, list] = {}
        for block in _entries(batches):
            key, value, y, heads = _segments(*block, arrays, wanted)
            ends = np.append(heads[1:], len(key))
            for a, z in zip(heads.tolist(), ends.tolist()):
                part = y[a:z]
                t = found.setdefault(int(key[a]), [0, 0.0, math.inf, -math.inf, value[a], value[a]])
                t[0] += z - a
                t[1] += float(part.sum())
                t[2], t[3], t[5] = min(t[2], part.min()), max(t[3], part.max()), value[z - 1]
        at = TaskContext.get().partitionId()
        rows = [(k // size, k % size, at, *v) for k, v in found.items()]
        names, types = zip(*(c.split() for c in _TOTALS.split(", ")))
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))

    return lists.mapInArrow(scan, _TOTALS).toPandas().sort_values(["feature", "node", "range"]).reset_index(drop=True)


def _settle(tree: Nodes, totals, last: bool) -> list[int]:
    """Values of this level's nodes; those that may be split."""
    first = totals[totals["feature"] == 0].groupby("node").agg(n=("n", "sum"), s=("s", "sum"), low=("low", "min"), high=("high", "max"))
    open_nodes = []
    for node, n, s, low, high in first.itertuples():
        tree.value[node], tree.rows[node] = (s / n if low < high else low), float(n)
        if low < high and not last:
            open_nodes.append(int(node))
    return open_nodes


def _score(n, s, total, whole):
    """Decrease of the squared error when ``n`` rows of sum ``s`` go to the left."""
    rest = total - n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n > 0) & (rest > 0), s * s / n + (whole - s) ** 2 / rest - whole * whole / total, -np.inf)


def _best_splits(lists: DataFrame, tree: Nodes, totals, open_nodes: Sequence[int]) -> list[tuple]:
    """(node, feature, threshold, decrease) of the best split of each open node that has one."""
    t = totals[totals["node"].isin(open_nodes)].reset_index(drop=True)
    mean = t["node"].map(dict(zip(open_nodes, (tree.value[i] for i in open_nodes)))).to_numpy()
    # sums about the node's mean
    t["s"], t["low"], t["high"] = t["s"] - mean * t["n"], t["low"] - mean, t["high"] - mean
    by = t.groupby(["feature", "node"])
    n0, s0 = (by[c].cumsum() - t[c] for c in ("n", "s"))
    total, whole = by["n"].transform("sum").to_numpy(), by["s"].transform("sum").to_numpy()
    before = by["last"].shift()
    # between two ranges: a known candidate
    ends = np.where(before < t["first"], _score(n0, s0, total, whole), -np.inf)
    known = t.assign(ends=ends).groupby("node")["ends"].transform("max").to_numpy()
    # inside a range (n, s) stays in a parallelogram; the score is convex, so its corners bound it
    spread = (t["high"] - t["low"]).to_numpy()
    many = np.where(spread > 0, (t["s"] - t["n"] * t["low"]) / np.where(spread > 0, spread, 1), 0)     # rows at the high end
    corners = [(n0, s0), (n0 + t["n"], s0 + t["s"]), (n0 + many, s0 + many * t["high"]), (n0 + t["n"] - many, s0 + (t["n"] - many) * t["low"])]
    bound = np.maximum(np.max([_score(*map(np.asarray, c), total, whole) for c in corners], axis=0), 0)
    alive = (bound * (1 + 1e-9) + 1e-12 >= known)
    size, arrays = len(tree.feature), tree.arrays()
    width = (t.groupby("node")["high"].transform("max") - t.groupby("node")["low"].transform("min")).to_numpy()
    goes_on = {(int(r), int(f) * size + int(i)): tuple(map(float, v)) for r, f, i, *v in
               zip(t["range"][alive], t["feature"][alive], t["node"][alive], n0[alive], s0[alive], mean[alive], total[alive], whole[alive],
                   before[alive], width[alive])}
    by_range: dict[int, dict] = {}
    for (r, key), v in goes_on.items():
        by_range.setdefault(r, {})[key] = v
    wanted = np.zeros(size, bool)
    wanted[list(open_nodes)] = True

    def scan(batches):
        from pyspark import TaskContext

        mine = by_range.get(TaskContext.get().partitionId(), {})
        state = {k: list(v) for k, v in mine.items()}
        best: dict[int, tuple] = {}
        for block in _entries(batches) if mine else ():
            key, value, y, heads = _segments(*block, arrays, wanted)
            for a, z in zip(heads.tolist(), np.append(heads[1:], len(key)).tolist()):
                k = int(key[a])
                if k not in state:
                    continue
                n, s, mean, total, whole, last, spread = state[k]
                v, c = value[a:z], np.cumsum(y[a:z] - mean)
                prior = np.concatenate([[last], v[:-1]])                      # NaN before the first value: no candidate
                cut = np.flatnonzero(prior < v)
                if len(cut):
                    score = _score(n + cut, s + np.where(cut > 0, c[cut - 1], 0.0), total, whole)
                    i = int((score >= score.max() - _tie(score.max(), total, spread)).argmax())
                    if k not in best or score[i] > best[k][0] + _tie(score[i], total, spread):
                        best[k] = float(score[i]), float(_midpoint(prior[cut[i]], v[cut[i]]))
                state[k][:2], state[k][5] = [n + z - a, s + float(c[-1])], float(v[-1])
        rows = [(k % size, k // size, sc, th) for k, (sc, th) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ty) for i, ty in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                                         names=["node", "feature", "score", "threshold"])

    found = lists.mapInArrow(scan, "node int, feature int, score double, threshold double")
    # a row a range and node at most, besides the ends of ranges
    ends = [(int(i), int(f), float(sc), float(_midpoint(u, v))) for i, f, sc, u, v in zip(t["node"], t["feature"], ends, before, t["first"]) if sc > -np.inf]
    candidates: dict[int, list] = {}
    for node, feature, score, threshold in [*ends, *map(tuple, found.collect())]:
        candidates.setdefault(node, []).append((feature, threshold, score))
    out = []
    for node, n, spread in dict.fromkeys(zip(t["node"].tolist(), total.tolist(), width.tolist())):
        if node in candidates:
            most = max(c[2] for c in candidates[node])
            out.append((node, *min(c for c in candidates[node] if c[2] >= most - _tie(most, n, spread))))
    return sorted(out)


class ExactTreeModel(Model, _Scored, TableModel):
    """At most ``2 ** (max_depth + 1)`` nodes, sent to every task."""

    def __init__(self, inputs: Sequence[str], tree: Nodes, classes: bool):
        super().__init__()
        self.inputs, self.tree, self.classes = list(inputs), tree, classes

    @property
    def featureImportances(self) -> DenseVector:
        total = np.zeros(len(self.inputs))
        for f, g in zip(self.tree.feature, self.tree.gain):
            if f >= 0:
                total[f] += g
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        arrays, value = self.tree.arrays(), np.array(self.tree.value)

        @F.pandas_udf("double")
        def leaf(*columns: pd.Series) -> pd.Series:
            return pd.Series(value[descend(np.column_stack([c.to_numpy(float) for c in columns]), *arrays)])

        return self.scored(dataset.withColumn("__mean", leaf(*[col_of(c).cast("double") for c in self.inputs])), "__mean")


    def saved_state(self):
        return {"inputs": self.inputs, "classes": self.classes, "tree": vars(self.tree)}, {}

    @classmethod
    def restored(cls, state, read) -> "ExactTreeModel":
        return cls(state["inputs"], Nodes(**state["tree"]), state["classes"])


# ---------------------------------------------------------------- forest
def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson of mean 1 by hash, the same in every scan."""
    u = (_mix(_mix(ids.astype(np.int64).view(np.uint64)) ^ _mix([seed * 1_000_003 + tree])) >> np.uint64(11)) * (1.0 / (1 << 53))
    drawn = np.zeros(len(u))
    for share in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)]):
        more = u >= share
        if not more.any():
            break
        drawn += more
    return drawn


def _gathered(batches, rows: int):
    """Batches joined to about ``rows`` rows each, empty ones left out."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b] if b.num_rows else held, n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _by_key(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Rows of equal ``key`` (none below 0) as one block of each column's plain bytes: the keys, their rows, the blocks."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(heads[1:], len(key))[:len(heads)]
    return key[order[heads]], ends - heads, [pa.array([c[a:z].tobytes() for a, z in zip(heads.tolist(), ends.tolist())], pa.binary())
                                             for c in (c[order] for c in columns)]


def _unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])


def _cell_sums(cell: np.ndarray, size: int, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each cell (a number below ``size``) that holds rows: rows, sum of y, least and largest x and y."""
    names = None
    if size > 2 * len(cell):
        names, cell = np.unique(cell, return_inverse=True)
        size = len(names)
    n = np.bincount(cell, w, size)
    held = np.flatnonzero(n)
    ends = []
    for of, none, what in ((np.minimum, np.inf, x), (np.maximum, -np.inf, x), (np.minimum, np.inf, y), (np.maximum, -np.inf, y)):
        ends.append(np.full(size, none))
        of.at(ends[-1], cell, what)
    return held if names is None else names[held], n[held], np.bincount(cell, w * y, size)[held], *[e[held] for e in ends]


_CELLS = "tree int, node int, feature int, bin int, n double, s double, x_low double, x_high double, low double, high double"


class GrownForest(Estimator):
    """Bootstrap trees grown to pure leaves.  ``tried``: features a node may split on (None: all; "sqrt").

    ``keys`` name a row: its draws hang on them alone, not on partitions.  Without keys rows are numbered as they lie."""

    def __init__(self, inputs: Sequence[str], label: str = "label", keys: Sequence[str] = (), n_trees: int = 100, classes: bool = False, tried: int | str | None = None,
                 seed: int = 42, sampled: bool = True, hand_over: int = HAND_OVER, trees_at_once: int = TREES_AT_ONCE, bins: int = BINS):
        super().__init__()
        self.inputs, self.label, self.keys, self.n_trees, self.classes = list(inputs), label, list(keys), n_trees, classes
        self.seed, self.sampled = seed, sampled
        self.tried = max(1, int(math.sqrt(len(inputs)))) if tried == "sqrt" else tried
        self.hand_over, self.trees_at_once, self.bins = hand_over, trees_at_once, bins

    def _fit(self, dataset: DataFrame) -> "GrownForestModel":
        spark = dataset.sparkSession
        rows = _learned(dataset, self.inputs, self.label, self.keys)
        rows = materialise(rows if self.keys else rows.withColumn("id", F.xxhash64("id", F.monotonically_increasing_id())))
        n = rows.count()
        if n == 0:
            raise ValueError("a forest needs at least one row")
        sample = _points(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow())
        edges = [np.unique(np.quantile(sample[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(len(self.inputs))]
        uppers, subs = {}, None
        for at in range(0, self.n_trees, self.trees_at_once):
            trees = range(at, min(at + self.trees_at_once, self.n_trees))
            grown, handed = self._upper(rows, trees, edges, n)
            uppers.update(grown)
            part = self._finish(rows, grown, handed)
            subs = part if subs is None else subs.unionByName(part)
        leaves = [(t, i, [-1], [0.0], [0], [0], [tree.value[i]], [tree.rows[i]], [0.0]) for t, tree in uppers.items()
                  for i, f in enumerate(tree.feature) if f < 0 and i in tree.done]
        subs = subs.unionByName(spark.createDataFrame(leaves, _SUBTREE)) if leaves else subs
        return GrownForestModel(self.inputs, uppers, materialise(subs), self.classes)

    def _weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        return bootstrap(ids, tree, self.seed) if self.sampled else np.ones(len(ids))

    # ------------------------------------------------------------ upper levels
    def _upper(self, rows: DataFrame, trees: Sequence[int], edges: list, n: int) -> tuple[dict[int, Nodes], dict[int, list[int]]]:
        """Levels of nodes too large for a task.  The trees' upper parts hold about 2 n / hand_over nodes each."""
        grown = {t: Nodes() for t in trees}
        for tree in grown.values():
            tree.done = set()
        handed: dict[int, list[int]] = {t: [] for t in trees}
        if n <= self.hand_over / 2:                      # no bootstrap sample is larger
            return grown, {t: [0] for t in trees}
        level = {t: [0] for t in trees}
        own: dict[tuple[int, int], list] = {}            # nodes whose bins are their own: (low, high) of each feature
        while any(level.values()):
            cells = self._cells(rows, grown, level, edges, own)
            splits, level = self._choose(cells), {t: [] for t in trees}
            for r in splits:
                t, node = r["tree"], r["node"]
                tree = grown[t]
                tree.value[node], tree.rows[node] = r["mean"], r["n"]
                if r["n"] <= self.hand_over:
                    handed[t].append(node)
                elif r["feature"] >= 0:
                    level[t] += tree.split(node, r["feature"], r["threshold"], r["score"])
                elif r["low"] < r["high"] and any(a < b for a, b in zip(r["x_low"], r["x_high"])):
                    own[t, node] = list(zip(r["x_low"], r["x_high"]))        # no edge parts it: look closer
                    level[t].append(node)
                else:
                    tree.done.add(node)                  # pure, or all its rows are one point
        return grown, handed

    def _cells(self, rows: DataFrame, grown: dict, level: dict, edges: list, own: dict) -> DataFrame:
        arrays = {t: tree.arrays() for t, tree in grown.items()}
        weights, bins, k = self._weights, self.bins, len(edges)
        names, types = zip(*(c.split() for c in _CELLS.split(", ")))
        kinds = [pa.int32() if ty == "int" else pa.float64() for ty in types]
        places = {}                                      # of a tree's nodes in this level; ends of their own bins, NaN where edges part them
        for t, nodes in level.items():
            if nodes:
                place = np.full(len(grown[t].feature), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                places[t] = place, np.array(nodes, np.int32), np.array([own.get((t, i), [(np.nan, np.nan)] * k) for i in nodes], float)

        def scan(batches):
            for b in _gathered(batches, SCAN_ROWS):
                x, y, ids = np.ascontiguousarray(_points(b).T), b.column("y").to_numpy(), b.column("id").to_numpy()
                coded = [np.searchsorted(e, v, side="left") for e, v in zip(edges, x)]
                for t, (place, nodes, ends) in places.items():
                    w = weights(ids, t)
                    r, leaf = routed(x, np.flatnonzero(w > 0), arrays[t], place >= 0)
                    at, wr, yr = place[leaf], w[r], y[r]
                    mine = np.flatnonzero(~np.isnan(ends[:, 0, 0])[at])
                    for f in range(k if len(r) else 0):
                        v, code = x[f].take(r), coded[f].take(r)
                        if len(mine):
                            a, z = ends[at[mine], f].T
                            span = np.where(z > a, z - a, 1)
                            code[mine] = np.where(z > a, np.minimum((bins * ((v[mine] - a) / span)).astype(int), bins - 1), 0)
                        cell, *sums = _cell_sums(at * bins + code, len(nodes) * bins, wr, v, yr)
                        n = len(cell)
                        out = [np.full(n, t), nodes[cell // bins], np.full(n, f), cell % bins, *sums]
                        yield pa.RecordBatch.from_arrays([pa.array(o, ty) for o, ty in zip(out, kinds)], names=list(names))

        return rows.mapInArrow(scan, _CELLS).groupBy("tree", "node", "feature", "bin").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), *[f(c).alias(c) for f, c in ((F.min, "x_low"), (F.max, "x_high"), (F.min, "low"), (F.max, "high"))])

    def _choose(self, cells: DataFrame) -> list:
        """The best edge of each node: one row a node; thresholds are midpoints between neighbouring cells' values."""
        tried, seed, k = self.tried, self.seed, len(self.inputs)

        def choose(table: pa.Table) -> pa.Table:
            t = {c: v.to_numpy() for c, v in zip(table.column_names, table.sort_by([("feature", "ascending"), ("bin", "ascending")]).columns)}
            tree, node = int(t["tree"][0]), int(t["node"][0])
            starts = np.searchsorted(t["feature"], np.arange(k + 1))
            of = [slice(a, z) for a, z in zip(starts.tolist(), starts[1:].tolist())]       # a feature's cells
            n, s, low, high = t["n"][of[0]].sum(), t["s"][of[0]].sum(), t["low"][of[0]].min(), t["high"][of[0]].max()
            mean, best = s / n, (-np.inf, -1, 0.0)
            drawn = np.argsort(_mix(_mix([seed * 1_000_003 + tree]) + _mix([node]) + np.arange(k, dtype=np.uint64)))
            usable = [f for f in drawn.tolist() if of[f].stop - of[f].start > 1][:tried]
            for f in sorted(usable):
                cn, cs, x_low, x_high = (t[c][of[f]] for c in ("n", "s", "x_low", "x_high"))
                score = _score(np.cumsum(cn)[:-1], np.cumsum(cs - mean * cn)[:-1], n, 0.0)
                i = int(score.argmax())
                if score[i] > best[0] + _tie(score[i], n, high - low):
                    best = float(score[i]), f, float(_midpoint(x_high[i], x_low[i + 1]))
            row = {"tree": tree, "node": node, "n": float(n), "mean": float(mean), "low": float(low), "high": float(high),
                   "feature": best[1] if low < high else -1, "threshold": best[2], "score": float(max(best[0], 0.0)),
                   "x_low": [t["x_low"][c].min() for c in of], "x_high": [t["x_high"][c].max() for c in of]}
            return pa.Table.from_pylist([row], schema=schema)

        schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("n", pa.float64()), ("mean", pa.float64()), ("low", pa.float64()),
                            ("high", pa.float64()), ("feature", pa.int32()), ("threshold", pa.float64()), ("score", pa.float64()),
                            ("x_low", pa.list_(pa.float64())), ("x_high", pa.list_(pa.float64()))])
        return cells.groupBy("tree", "node").applyInArrow(
            choose, "tree int, node int, n double, mean double, low double, high double, feature int, threshold double, score double, "
                    "x_low array<double>, x_high array<double>").collect()

    # ------------------------------------------------------------ the rest, in tasks
    def _finish(self, rows: DataFrame, grown: dict, handed: dict) -> DataFrame:
        arrays = {t: tree.arrays() for t, tree in grown.items()}
        parts = {}                                       # small nodes are grown together, about HAND_OVER rows at once
        for t, nodes in handed.items():
            parts[t] = np.full(len(grown[t].feature), -1, np.int32)
            rows_of = np.array(grown[t].rows)[nodes]
            parts[t][nodes] = (np.cumsum(rows_of) - rows_of) // HAND_OVER
        weights, tried, seed = self._weights, self.tried, self.seed

        def deal(batches):
            for b in _gathered(batches, SCAN_ROWS):
                points, ids, y = _points(b), b.column("id").to_numpy(), b.column("y").to_numpy()
                x = np.ascontiguousarray(points.T)
                for t in arrays:
                    w = weights(ids, t)
                    r, node = routed(x, np.flatnonzero(w > 0), arrays[t], parts[t] >= 0)
                    own, _, blocks = _by_key(parts[t][node], node.astype(np.int32), ids[r], points[r], y[r], w[r])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own), *blocks], names=["tree", "part", *_DEALT])

        def finish(table: pa.Table) -> pa.Table:
            node, ids, x, y, w = (_unpacked(table, c, ty) for c, ty in _DEALT.items())
            order = np.lexsort((ids, node))                       # the same trees however the rows arrive
            tree, (nodes, place) = int(table.column("tree")[0].as_py()), np.unique(node[order], return_inverse=True)
            x, y, w = x.reshape(len(y), -1)[order], y[order], w[order]
            columns, starts = _grown(x, y, w, place, [(seed * 1_000_003 + tree) * 1_009 + node for node in nodes.tolist()], tried=tried)
            starts = pa.array(starts, pa.int32())
            return pa.table([pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()),
                             *(pa.ListArray.from_arrays(starts, pa.array(v)) for v in columns.values())], schema=_SUBTREE_ARROW)

        dealt = rows.mapInArrow(deal, "tree int, part int, " + ", ".join(f"{c} binary" for c in _DEALT))
        # about a task a set of rows, so that none ends long after the others
        width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, sum(int(p.max()) + 1 for p in parts.values())))
        return dealt.repartition(width, "tree", "part").groupBy("tree", "part").applyInArrow(finish, _SUBTREE)


_DEALT = {"node": np.int32, "id": np.int64, "x": float, "y": float, "w": float}      # columns of dealt rows, plain bytes of many rows
_SUBTREE = ("tree int, node int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, "
            "rows array<double>, gain array<double>")
_SUBTREE_ARROW = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())),
                            ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())),
                            ("rows", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))])


class GrownForestModel(Model, _Scored, TableModel):
    """Upper parts (sent to every task) and ``subtrees``: a row of arrays for each node handed over and each upper leaf."""

    def __init__(self, inputs: Sequence[str], uppers: dict[int, Nodes], subtrees: DataFrame, classes: bool):
        super().__init__()
        self.inputs, self.uppers, self.subtrees, self.classes = list(inputs), uppers, subtrees, classes

    def saved_state(self):
        uppers = {str(t): {k: v for k, v in vars(tree).items() if k != "done"} for t, tree in self.uppers.items()}
        return {"inputs": self.inputs, "classes": self.classes, "uppers": uppers}, {"subtrees": self.subtrees}

    @classmethod
    def restored(cls, state, read) -> "GrownForestModel":
        return cls(state["inputs"], {int(t): Nodes(**tree) for t, tree in state["uppers"].items()}, read("subtrees"), state["classes"])

    def shape(self) -> DataFrame:
        """Trees' leaves and learned rows."""
        return self.subtrees.groupBy("tree").agg(F.sum(F.size(F.filter("feature", lambda f: f < 0))).alias("leaves"),
                                                 F.sum(F.get("rows", F.lit(0))).alias("rows"), F.count(F.lit(1)).alias("parts"))

    @property
    def featureImportances(self) -> DenseVector:
        parts = self.subtrees.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("g")).where("g.feature >= 0")
        gains = np.zeros((len(self.uppers), len(self.inputs)))
        for r in parts.groupBy("tree", F.col("g.feature").alias("f")).agg(F.sum("g.gain").alias("g")).collect():    # trees x features
            gains[r["tree"], r["f"]] += r["g"]
        for t, tree in self.uppers.items():
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains[t, f] += g
        whole = gains.sum(axis=1, keepdims=True)
        mean = (gains / np.where(whole > 0, whole, 1)).mean(axis=0)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = materialise(dataset.withColumn("__row", F.monotonically_increasing_id()))
        arrays = {t: tree.arrays() for t, tree in self.uppers.items()}

        def route(batches):
            for b in _gathered(batches, ASK_ROWS):
                x, row = _points(b), b.column("row").to_numpy()
                for t, upper in arrays.items():
                    node, n, blocks = _by_key(descend(x, *upper).astype(np.int32), row, x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(node), pa.array(n), *blocks],
                                                     names=["tree", "node", "n", "row", "x"])

        asks = asked.select(F.col("__row").alias("row"), _vector(self.inputs).alias("x")).mapInArrow(route, "tree int, node int, n long, row binary, x binary")
        sizes = materialise(asks.groupBy("tree", "node").agg(F.ceil(F.sum("n") / ASK_ROWS).cast("int").alias("blocks")))
        key = ["tree", "node", "block"]
        left = asks.join(sizes, ["tree", "node"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).select(*key, "row", "x")
        right = self.subtrees.drop("rows", "gain").join(sizes, ["tree", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def score(asks: pa.Table, part: pa.Table) -> pa.Table:
            row, value = np.zeros(0, np.int64), np.zeros(0)
            if asks.num_rows and part.num_rows:          # without part: a tree that drew no row
                of = [part.column(c)[0].values.to_numpy() for c in ("feature", "threshold", "left", "right", "value")]
                row, x = _unpacked(asks, "row", np.int64), _unpacked(asks, "x", float)
                value = of[4][descend(x.reshape(len(row), -1), *of[:4])]
            return pa.table([pa.array(row), pa.array(value)], names=["row", "value"])

        found = cogrouped(left, right, key, score, "row long, value double")
        mean = materialise(found.groupBy("row").agg(F.avg("value").alias("__mean")))
        return self.scored(asked.join(mean.withColumnRenamed("row", "__row"), "__row").drop("__row"), "__mean")
