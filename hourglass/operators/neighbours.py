"""Exact k nearest neighbours by pivot cells (K6).

A join of asked points with indexed points that never compares all with all:

1. Equal points are one: of an indexed point the ``k`` copies of smallest id stay (no more can be neighbours), an asked point is
   asked once.  So a value that a third of the rows share costs one comparison, not its square.
2. A bounded sample gives the pivots; every indexed point lies in the cell of its nearest pivot and carries its distance to it.
   Cells of more than ``CELL_ROWS`` points are split by a second set of pivots, drawn inside the cell.
   Near cells make up a group of ``GROUP`` times that, a large cell is its own.
3. An asked point first meets the inner cell it would lie in.  The k-th distance there is its reach; without k points there,
   the reach comes from the cells' radii.
4. It then meets those cells alone that the triangle inequality cannot rule out: a cell is out if its whole ring of
   radii lies farther off than the reach, or the plane between its pivot and the nearest pivot does.  Inner cells are judged the same way.
   It is sent once to a group with such cells, not once to each: where no cell can be ruled out, all asked points go to all cells.
5. Blocks of points meet blocks of asked points; matrix products pick candidates within the reach, their distances are then
   summed column by column, so equal differences give equal distances.  The k best of each block are merged.

Only the first pivots (``PIVOTS`` at most) and one row of figures a first cell are sent to every task; inner pivots travel
with their cell.  No task holds more than about ``GROUP * CELL_ROWS`` points and ``ASK_ROWS`` asked points at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_of
from ..session import materialise
from .saved import TableModel

PIVOTS = 1024                # first pivots at most
INNER = 64                   # pivots inside a large cell at most
CELL_ROWS, ASK_ROWS = 4096, 8192
GROUP = 8                    # times CELL_ROWS: points of the cells that a task takes at once
SEED = 42


# ---------------------------------------------------------------- geometry of one task
def _points(table: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two small sets, by differences column by column."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += np.subtract.outer(a[:, j], b[:, j]) ** 2
    return np.sqrt(total)


def _slack(reach: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The reach with room for rounding: bounds only pick what is compared, never what is returned."""
    return reach + 1e-9 * (reach + scale) + 1e-300


def cells_in_reach(to_pivot: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, between: np.ndarray,
                   home: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Asked points by cells: True where the triangle inequality cannot rule the cell out.  ``own``: distance to the home pivot
    if that is not among the cells."""
    d, own = to_pivot, (to_pivot[np.arange(len(to_pivot)), home] if own is None else own)[:, None]
    r = _slack(reach, np.maximum(d.max(axis=1, initial=0), own[:, 0]))[:, None]
    near = (d - high <= r) & (low - d <= r)
    gap = 2 * between[home]
    # distance to the plane between the two pivots, for cells whose pivot is another point
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d * d - own * own) / np.where(gap > 0, gap, 1), -np.inf)
    return near & (plane <= r)


@dataclass
class Pivots:
    """The first pivots and their cells' figures."""

    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        self.between = distances(self.x, self.x)

    def first_reach(self, d: np.ndarray, k: int) -> np.ndarray:
        """A distance within which k points lie for certain: cells by their farthest point, until they hold k."""
        far = np.where(self.rows > 0, d + self.high, np.inf)
        order = np.argsort(far, axis=1)
        held = np.cumsum(self.rows[order], axis=1)
        at = np.minimum((held < k).sum(axis=1), far.shape[1] - 1)
        reach = np.take_along_axis(far, order, axis=1)[np.arange(len(d)), at]
        return np.where(held[:, -1] >= k, reach, np.inf)


def _k_best(i: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest distances (then ids) of each ``i``, in that order."""
    order = np.lexsort((ids, d2, i))
    return order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]


def nearest_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, at_once: int | None = None):
    """The ``k`` nearest rows of ``x`` within each asked point's reach: positions in q and x, squared distances."""
    out_q, out_x, out_d = [], [], []
    at_once = at_once or max(64, (1 << 18) // max(len(x), 1))
    square = (x * x).sum(axis=1)
    for at in range(0, len(q), at_once):
        part, limit = q[at:at + at_once], reach[at:at + at_once]
        own = (part * part).sum(axis=1)
        rough = own[:, None] - 2 * part @ x.T + square
        room = 1e-9 * (own + square.max(initial=0))                      # of the product's rounding
        if len(x) > k:
            limit = np.minimum(limit, np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1] + room, 0)))
        with np.errstate(over="ignore"):
            i, j = np.nonzero(rough <= (limit * limit * (1 + 1e-9) + room)[:, None])
        exact = np.zeros(len(i))
        for c in range(x.shape[1]):
            exact += (part[i, c] - x[j, c]) ** 2
        best = _k_best(i, ids[j], exact, k)
        out_q.append(i[best] + at)
        out_x.append(j[best])
        out_d.append(exact[best])
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((out_q, int), (out_x, int), (out_d, float)))


# ---------------------------------------------------------------- the join
def cogrouped(left: DataFrame, right: DataFrame, keys: Sequence[str], task, schema: str) -> DataFrame:
    """``task`` of both sides' Arrow tables of each key.  Both may come from one table: the right side's columns get ids of their own."""
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


class PivotIndex:
    """``points`` (id long, x array<double>, label double) in cells; ``rows`` and ``inner`` are written once."""

    def __init__(self, points: DataFrame, k: int, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, inner: int = INNER, seed: int = SEED):
        self.k, self.cell_rows, self.spark = k, cell_rows, points.sparkSession
        copies = Window.partitionBy("x").orderBy("id")
        points = materialise(points.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k).drop("__copy"))
        n = points.count()
        take = int(max(1, min(pivots, math.isqrt(max(n, 1)))))
        sample = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(take).select("x").toArrow()
        x = np.unique(_points(sample), axis=0)
        self.d, self.empty = x.shape[1], n == 0
        if self.empty:
            return

        def assign(batches):
            for b in batches:
                own = _points(b)
                far = distances(own, x) if len(own) else np.zeros((0, len(x)))
                cell = far.argmin(axis=1) if len(own) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(own)), cell])],
                                                 names=[*b.schema.names, "cell", "r"])

        rows = materialise(points.mapInArrow(assign, "id long, x array<double>, label double, cell int, r double"))
        figures = {f["cell"]: f for f in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"),
                                                                    F.max("r").alias("high")).collect()}       # a row a pivot
        of = lambda name, none: np.array([figures[i][name] if i in figures else none for i in range(len(x))])
        self.pivots = Pivots(x, of("low", np.inf), of("high", -np.inf), of("n", 0))
        counts = self.pivots.rows
        blocks = self.spark.createDataFrame([(i, int(-(-c // cell_rows)), int(min(inner, 1 + c // cell_rows * 2)))
                                             for i, c in enumerate(counts.tolist()) if c > cell_rows], "cell int, blocks int, take int")
        small = [(i, 0, x[i].tolist(), float(self.pivots.low[i]), float(self.pivots.high[i]), int(c))
                 for i, c in enumerate(counts.tolist()) if 0 < c <= cell_rows]
        small = self.spark.createDataFrame(small, "cell int, sub int, pivot array<double>, low double, high double, n long")
        self.rows = rows.join(F.broadcast(blocks), "cell", "left_anti").withColumn("sub", F.lit(0))
        self.inner = small
        if (counts > cell_rows).any():
            self._split(rows.join(F.broadcast(blocks), "cell"), seed)
        self.rows, self.inner = materialise(self.rows), materialise(self.inner)
        self.group()

    def group(self) -> None:
        """Numbers the groups: a large cell alone, others with the free cells nearest to the first free one."""
        rows, most = self.pivots.rows, GROUP * self.cell_rows
        groups, free = np.full(len(rows), -1), (rows > 0) & (rows <= self.cell_rows)
        large = np.flatnonzero(rows > self.cell_rows)
        groups[large], n = np.arange(len(large)), len(large)
        while free.any():
            near = np.argsort(np.where(free, self.pivots.between[free.argmax()], np.inf), kind="stable")[:free.sum()]
            near = near[np.cumsum(rows[near]) <= most]
            groups[near], free[near], n = n, False, n + 1
        self.groups = groups
        self.blocks = self.spark.createDataFrame([(int(c), int(groups[c]), int(-(-rows[c] // most))) for c in np.flatnonzero(rows)],
                                                 "cell int, group int, row_blocks int")

    def _split(self, large: DataFrame, seed: int) -> None:
        """Points of large cells go to inner pivots."""
        drawn = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
        inner = (large.withColumn("sub", F.row_number().over(drawn) - 1).where(F.col("sub") < F.col("take"))
                 .select("cell", "sub", F.col("x").alias("pivot"), "blocks"))
        inner = materialise(inner)
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")

        def assign(points: pa.Table, pivots: pa.Table) -> pa.Table:
            pivots = pivots.sort_by("sub")
            own = _points(points)
            far = distances(own, _points(pivots, "pivot")) if len(own) else np.zeros((0, 1))
            sub = far.argmin(axis=1) if len(own) else np.zeros(0, int)
            keep = points.select(["id", "x", "label", "cell"])
            return keep.append_column("r", pa.array(far[np.arange(len(own)), sub])).append_column(
                "sub", pa.array(pivots.column("sub").to_numpy()[sub] if len(own) else sub, pa.int32())).select(
                ["cell", "id", "x", "label", "r", "sub"])

        left = large.withColumn("block", block)
        right = inner.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = materialise(cogrouped(left, right, ["cell", "block"], assign,
                                      "cell int, id long, x array<double>, label double, r double, sub int"))
        figures = found.groupBy("cell", "sub").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
        self.rows = self.rows.unionByName(found)
        self.inner = self.inner.unionByName(inner.drop("blocks").join(figures, ["cell", "sub"]))

    # ------------------------------------------------------------ routing
    def _routed(self, asked: DataFrame, home_only: bool) -> DataFrame:
        """``ask, x, reach, home`` to the groups with first cells in reach; without a reach yet, to the home cell's group."""
        pivots, groups, k = self.pivots, self.groups, self.k

        def route(batches):
            for b in batches:
                q = _points(b)
                if not len(q):
                    continue
                d = distances(q, pivots.x)
                home = np.where(pivots.rows > 0, d, np.inf).argmin(axis=1)
                reach = b.column("reach").to_numpy(zero_copy_only=False)
                reach = np.minimum(reach, pivots.first_reach(d, k))
                if home_only:
                    i, group = np.arange(len(q)), groups[home]
                else:
                    near = cells_in_reach(d, reach, pivots.low, pivots.high, pivots.between, home)
                    hit = np.zeros((len(q), groups.max() + 1), bool)
                    for cell in np.flatnonzero(pivots.rows):
                        hit[:, groups[cell]] |= near[:, cell]
                    i, group = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([b.column("ask").take(pa.array(i)), _lists(q[i]), pa.array(reach[i]), pa.array(home[i].astype(np.int32)),
                                                  pa.array(group.astype(np.int32))], names=["ask", "x", "reach", "home", "group"])

        return materialise(asked.mapInArrow(route, "ask long, x array<double>, reach double, home int, group int"))

    def _met(self, routed: DataFrame, home_only: bool) -> DataFrame:
        """Blocks of a group's points with blocks of asked points: ``ask, id, label, d2`` of each block's k best in the inner cells
        in reach (``home_only``: in the home cell, otherwise in all but that one), and a row of ``ask, n_cells, n_compared``."""
        pivots, groups, k = self.pivots, self.groups, self.k
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        sizes = routed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("ask_blocks"))      # a row a group
        cells = F.broadcast(self.blocks.join(sizes, "group"))
        key, none = ["group", "row_block", "ask_block"], F.lit(None).cast("double")
        points = self.rows.select("cell", "sub", "id", "x", "label", none.alias("low"), none.alias("high")).join(cells, "cell").withColumn(
            "row_block", deal("id", "row_blocks"))
        large = cells.where(F.col("cell").isin(np.flatnonzero(pivots.rows > self.cell_rows).tolist()))
        inner = self.inner.select("cell", "sub", F.lit(None).cast("long").alias("id"), F.col("pivot").alias("x"), none.alias("label"), "low", "high")
        inner = inner.join(F.broadcast(large), "cell").withColumn("row_block", spread("row_blocks"))
        left = points.unionByName(inner).withColumn("ask_block", spread("ask_blocks"))
        of_group = F.broadcast(self.blocks.groupBy("group").agg(F.max("row_blocks").alias("row_blocks")).join(sizes, "group"))
        right = routed.join(of_group, "group").withColumn("ask_block", deal("ask", "ask_blocks")).withColumn("row_block", spread("row_blocks"))
        schema = pa.schema([("ask", pa.int64()), ("id", pa.int64()), ("label", pa.float64()), ("d2", pa.float64()), ("n_cells", pa.int64()),
                            ("n_compared", pa.int64())])

        def match(points: pa.Table, asks: pa.Table) -> pa.Table:
            if not points.num_rows or not asks.num_rows:
                return schema.empty_table()
            q, reach, home = _points(asks), asks.column("reach").to_numpy(), asks.column("home").to_numpy()
            pivot = points.filter(pc.is_valid(points.column("low"))).sort_by("sub")
            points = points.filter(pc.is_null(points.column("low")))
            if pivot.num_rows:                               # one large cell
                p, code = _points(pivot, "x"), np.searchsorted(pivot.column("sub").to_numpy(), points.column("sub").to_numpy())
                d = distances(q, p)
                first = d.argmin(axis=1)
                met = (np.arange(len(p)) == first[:, None]) & (home == pivot.column("cell")[0].as_py())[:, None]
                near = met if home_only else cells_in_reach(d, reach, *(pivot.column(c).to_numpy() for c in ("low", "high")), distances(p, p), first)
            else:
                cells = np.flatnonzero(groups == asks.column("group")[0].as_py())
                code = np.searchsorted(cells, points.column("cell").to_numpy())
                met = home[:, None] == cells
                if not home_only:
                    own = np.sqrt(sum((q[:, c] - pivots.x[home, c]) ** 2 for c in range(q.shape[1])))
                    near = cells_in_reach(distances(q, pivots.x[cells]), reach, pivots.low[cells], pivots.high[cells], pivots.between[:, cells], home, own)
            use = met if home_only else near & ~met
            x, ids, rows, found = _points(points), points.column("id").to_numpy(), np.argsort(code, kind="stable"), []
            starts = np.searchsorted(code[rows], np.arange(use.shape[1] + 1))
            for cell in np.flatnonzero(use.any(axis=0)):
                of, own = np.flatnonzero(use[:, cell]), rows[starts[cell]:starts[cell + 1]]
                if len(own):
                    i, j, d2 = nearest_of(x[own], ids[own], q[of], reach[of], k)
                    found.append((of[i], own[j], d2))
            i, j, d2 = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            best = _k_best(i, ids[j], d2, k)
            ask, named = asks.column("ask"), points.select(["id", "label"]).take(pa.array(j[best]))
            empty = lambda n, t: pa.nulls(n, t)
            n = len(best)
            near = pa.table([ask.take(pa.array(i[best])), *named.columns, pa.array(d2[best]), empty(n, pa.int64()), empty(n, pa.int64())], schema=schema)
            n_cells, n_compared = use.sum(axis=1), use @ np.diff(starts)
            did = np.flatnonzero(n_cells)
            if asks.column("row_block")[0].as_py():              # a cell cut into blocks counts once
                n_cells = np.zeros_like(n_cells)
            n = len(did)
            work = pa.table([ask.take(pa.array(did)), empty(n, pa.int64()), empty(n, pa.float64()), empty(n, pa.float64()), pa.array(n_cells[did]),
                             pa.array(n_compared[did])], schema=schema)
            return pa.concat_tables([near, work])

        return materialise(cogrouped(left.select(*key, "cell", "sub", "id", "x", "label", "low", "high"), right.select(*key, "ask", "x", "reach", "home"), key,
                                     match, "ask long, id long, label double, d2 double, n_cells long, n_compared long"))

    def search(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For ``ask long, x array<double>`` (distinct points): neighbours ``ask, rank, id, label, distance``, and the work:
        ``ask, n_cells, n_compared``."""
        if self.empty:
            return (self.spark.createDataFrame([], "ask long, rank int, id long, label double, distance double"),
                    self.spark.createDataFrame([], "ask long, n_cells long, n_compared long"))
        order = Window.partitionBy("ask").orderBy("d2", "id")
        top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        near_of = lambda met: met.where(F.col("n_cells").isNull()).select("ask", "id", "label", "d2")
        asked = materialise(asked.select("ask", "x", F.lit(float("inf")).alias("reach")))
        home = self._met(self._routed(asked, True), True)
        near = materialise(top(near_of(home)))
        reach = near.where(F.col("rank") == self.k).select("ask", F.sqrt("d2").alias("reach"))
        asked = asked.drop("reach").join(reach, "ask", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        rest = self._met(self._routed(asked.select("ask", "x", "reach"), False), False)
        found = top(near.drop("rank").unionByName(near_of(rest)))
        work = home.unionByName(rest).where(F.col("n_cells").isNotNull()).groupBy("ask").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_compared").alias("n_compared"))
        return found.select("ask", "rank", "id", "label", F.sqrt("d2").alias("distance")), work


def _vector(features: Sequence[str]):
    return F.array(*[col_of(c).cast("double") for c in features])


def _whole(x: str = "x"):
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def nearest_neighbours(points: DataFrame, asked: DataFrame, x: str, id_col: str, label: str, k: int = 7, **params) -> tuple[DataFrame, DataFrame]:
    """``asked`` (its own columns kept) with ``rank, id, label, distance`` of its ``k`` nearest ``points``; and the work done.

    Points with a null, NaN or infinite component take no part, such asked rows have no neighbours.  Ties go to
    the smaller id; a row of ``asked`` equal to a point meets it at distance 0."""
    rows = points.select(col_of(id_col).cast("long").alias("id"), col_of(x).cast("array<double>").alias("x"), col_of(label).cast("double").alias("label"))
    index = PivotIndex(rows.where(F.col("x").isNotNull() & _whole() & F.col("id").isNotNull()), k, **params)
    asked = asked.withColumn("__x", col_of(x).cast("array<double>"))
    alone = materialise(asked.select(F.col("__x").alias("x")).where(F.col("x").isNotNull() & _whole()).distinct()
                        .withColumn("ask", F.monotonically_increasing_id()))
    found, work = index.search(alone)
    near = materialise(found.join(alone, "ask"))
    return asked.join(near.withColumnsRenamed({"x": "__x"}), "__x").drop("__x", "ask"), work


def vote(near: DataFrame, keys: Sequence[str], weights: str = "uniform") -> DataFrame:
    """Majority label of ``keys``' neighbours (ties: the smallest label), its share, the nearest and the farthest distance.

    ``weights="distance"``: votes by inverse distance; neighbours at distance 0, if any, vote alone."""
    w = F.lit(1.0)
    if weights == "distance":
        least = F.min("distance").over(Window.partitionBy(*keys))
        near = near.withColumn("__w", F.when(least == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance")))
        w = F.col("__w")
    votes = near.groupBy(*keys, "label").agg(F.sum(w).alias("v"), F.min("distance").alias("near"), F.max("distance").alias("far"))
    return votes.groupBy(*keys).agg(F.max_by("label", F.struct("v", -F.col("label"))).alias("prediction"),
                                    (F.max("v") / F.sum("v")).alias("confidence"), F.min("near").alias("nearest"), F.max("far").alias("farthest"))


class _KnnParams:
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)


class NearestNeighbours(Estimator, _KnnParams):
    """K6 as a pipeline stage: fitting sorts the training rows into pivot cells; the model joins rows with them.

    ``inputs`` are (standardised) feature columns, ``id_col`` names a training row and orders ties; without one, rows are
    ordered by a hash of their values.  The model adds ``probability`` (of classes 0 and 1) and ``prediction``."""

    def __init__(self, inputs: Sequence[str], id_col: str | None = None, label: str = "label", k: int = 7):
        super().__init__()
        self.inputs, self.id_col, self.label = list(inputs), id_col, label
        self._set(k=k)

    def _fit(self, dataset: DataFrame) -> "NearestNeighboursModel":
        names = col_of(self.id_col).cast("long") if self.id_col else F.xxhash64(*map(col_of, [*self.inputs, self.label]))
        rows = dataset.select(names.alias("id"), _vector(self.inputs).alias("x"), col_of(self.label).cast("double").alias("label"))
        return NearestNeighboursModel(self.inputs, PivotIndex(rows.where(_whole() & F.col("label").isNotNull()), self.getOrDefault("k")))


class NearestNeighboursModel(Model, TableModel):
    def __init__(self, inputs: Sequence[str], index: PivotIndex):
        super().__init__()
        self.inputs, self.index = list(inputs), index

    def saved_state(self):
        i = self.index
        if i.empty:
            raise ValueError("a model that learned from no rows cannot be saved")
        figures = {c: getattr(i.pivots, c).tolist() for c in ("x", "low", "high", "rows")}
        return {"inputs": self.inputs, "k": i.k, "cell_rows": i.cell_rows, "pivots": figures}, {"rows": i.rows, "inner": i.inner}

    @classmethod
    def restored(cls, state, read) -> "NearestNeighboursModel":
        index = PivotIndex.__new__(PivotIndex)
        index.k, index.cell_rows, index.empty = state["k"], state["cell_rows"], False
        index.pivots = Pivots(**{c: np.array(v) for c, v in state["pivots"].items()})
        index.rows, index.inner = read("rows"), read("inner")
        index.spark, index.d = index.rows.sparkSession, index.pivots.x.shape[1]
        index.group()
        return cls(state["inputs"], index)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = dataset.withColumn("__x", _vector(self.inputs))
        alone = materialise(asked.select(F.col("__x").alias("x")).where(_whole()).distinct().withColumn("ask", F.monotonically_increasing_id()))
        share = self.index.search(alone)[0].groupBy("ask").agg(F.avg((F.col("label") == 1).cast("double")).alias("__share"))
        share = materialise(alone.join(share, "ask").select(F.col("x").alias("__x"), "__share"))
        return (asked.join(share, "__x", "left").withColumn("probability", array_to_vector(F.array(1 - F.col("__share"), F.col("__share"))))
                .withColumn("prediction", (F.col("__share") > 0.5).cast("double")).drop("__x", "__share"))
