"""Linear models and learning curves from sums of products.

Linear, ridge and lasso regression need nothing of the data but the sums of products of features and label.  One
aggregate gives them for every stretch of rows; sums of stretches are added up, so every fold and training size of a learning
curve, its fit and its scores on both sides come from a single scan.  The lasso runs its coordinate descent on those sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_of
from ..session import materialise
from .saved import TableModel

KINDS = ("linear", "ridge", "lasso")


def row_ranks(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 in ``order``: sorted ranges, their sizes added up; rows equal in ``order`` lie in any order."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(width, *order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()))         # range number and place in it
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())    # a row a range
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    starts = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "__part long, __start long")
    return (ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
            .withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start", "__at"))


def sums(df: DataFrame, inputs: Sequence[str], label: str, by: str | None = None) -> dict:
    """Sums of products of (1, inputs, label) over the rows without NULL or NaN, one symmetric matrix for each value of ``by`` (few)."""
    names = [f"__{i}" for i in range(len(inputs) + 2)]
    columns = [F.lit(1.0), *[F.nanvl(col_of(c).cast("double"), F.lit(None)) for c in [*inputs, label]]]
    rows = df.select(*[c.alias(n) for c, n in zip(columns, names)], *([F.col(by).alias("__by")] if by else [F.lit(0).alias("__by")]))
    rows = rows.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.groupBy("__by").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["__by"]] = m
    return out


def solve(m: np.ndarray, kind: str = "linear", alpha: float = 1.0, rounds: int = 100_000) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from sums of products: least squares (the shortest of equal ones), plus ``alpha`` times the squared
    coefficients (ridge), or half the mean square plus ``alpha`` times their sizes (lasso)."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    c = m - n * np.outer(mean, mean)
    xx, xy = c[1:-1, 1:-1], c[1:-1, -1]
    if kind == "linear":
        w = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    elif kind == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    elif kind == "lasso":
        w, grad, size = np.zeros(len(xx)), xy / n, np.diag(xx) / n
        for _ in range(rounds):
            moved = 0.0
            for j in np.flatnonzero(size > 0):
                pull = grad[j] + size[j] * w[j]
                new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / size[j]
                step = new - w[j]
                if step:
                    grad -= step * xx[:, j] / n
                    w[j], moved = new, max(moved, abs(step) * np.sqrt(size[j]))
            if moved <= 1e-14 * np.sqrt(c[-1, -1] / n):
                break
    else:
        raise ValueError(f"no such kind: {kind}")
    return float(mean[-1] - w @ mean[1:-1]), w


def r2_of(m: np.ndarray, intercept: float, w: np.ndarray) -> float | None:
    """R^2 of a linear model on the rows whose sums of products are ``m``."""
    v = np.concatenate([[-intercept], -w, [1.0]])
    whole = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return float(1 - v @ m @ v / whole) if whole > 0 else None


class GramRegression(Estimator):
    """R1-R3 as a stage: one aggregate, then a solution of the features' size."""

    def __init__(self, inputs: Sequence[str], label: str = "label", kind: str = "linear", alpha: float = 1.0):
        super().__init__()
        self.inputs, self.label, self.kind, self.alpha = list(inputs), label, kind, alpha

    def _fit(self, dataset: DataFrame) -> "GramRegressionModel":
        m = sums(dataset, self.inputs, self.label)
        if not m:
            raise ValueError("no row to learn from")
        return GramRegressionModel(self.inputs, *solve(m[0], self.kind, self.alpha))


class GramRegressionModel(Model, TableModel):
    """``prediction`` as one column expression."""

    def __init__(self, inputs: Sequence[str], intercept: float, w: Sequence[float]):
        super().__init__()
        self.inputs, self.intercept, self.coefficients = list(inputs), intercept, DenseVector(w)

    def saved_state(self):
        return {"inputs": self.inputs, "intercept": self.intercept, "w": self.coefficients.toArray().tolist()}, {}

    @classmethod
    def restored(cls, state, read) -> "GramRegressionModel":
        return cls(state["inputs"], state["intercept"], state["w"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        total = F.lit(self.intercept)
        for c, w in zip(self.inputs, self.coefficients.toArray().tolist()):
            total = total + col_of(c).cast("double") * F.lit(w)
        return dataset.withColumn("prediction", total)


# ---------------------------------------------------------------- learning curve
def fold_plan(n: int, folds: int, sizes: Sequence[float]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(fold, start, end, training stretches of each size) by row number: folds are contiguous, the first ``n % folds`` one row larger;
    a size is a share of the first fold's training rows, taken from the start of the training rows in order."""
    cuts = np.concatenate([[0], np.cumsum([n // folds + (f < n % folds) for f in range(folds)])]).tolist()
    most = n - cuts[1]
    plan = []
    for f in range(folds):
        a, b = cuts[f], cuts[f + 1]
        for k in sorted({int(s * most) for s in sizes}):
            head = (0, min(k, a))
            plan.append((f, a, b, k, [s for s in (head, (b, b + k - head[1])) if s[0] < s[1]]))
    return plan


def linear_learning_curve(df: DataFrame, inputs: Sequence[str], label: str, order: Sequence[str], kind: str = "linear", alpha: float = 1.0,
                          folds: int = 3, sizes: Sequence[float] | None = None) -> DataFrame:
    """E13 for linear, ridge and lasso in one scan: ``n_train``, mean and population deviation of R^2 on training and held-out rows.

    Rows are numbered in ``order``; folds and growing training sets are stretches of them."""
    sizes = np.linspace(0.1, 1.0, 8) if sizes is None else sizes
    ranked = materialise(row_ranks(df.select(*dict.fromkeys([*inputs, label, *order])), order, "__rank"))
    n = ranked.count()
    plan = fold_plan(n, folds, sizes)
    edges = sorted({e for _, a, b, _, parts in plan for s in [(a, b), *parts] for e in s})
    stretch = F.lit(0)
    for i, e in enumerate(edges):
        stretch = F.when(F.col("__rank") >= e, i).otherwise(stretch)
    by = sums(ranked.withColumn("__stretch", stretch), inputs, label, "__stretch")
    size = len(inputs) + 2
    of = lambda parts: sum((by[i] for i, e in enumerate(edges) if i in by and any(s[0] <= e < s[1] for s in parts)), np.zeros((size, size)))
    rows = []
    for f, a, b, k, parts in plan:
        train, test = of(parts), of([(a, b)])
        fits = train[0, 0] > 0 and test[0, 0] > 0
        model = solve(train, kind, alpha) if fits else None
        rows.append((f, k, r2_of(train, *model) if fits else None, r2_of(test, *model) if fits else None))
    scores = df.sparkSession.createDataFrame(rows, "fold int, n_train long, train_r2 double, test_r2 double")
    return scores.groupBy("n_train").agg(F.avg("train_r2").alias("train_r2_mean"), F.stddev_pop("train_r2").alias("train_r2_std"),
                                         F.avg("test_r2").alias("test_r2_mean"), F.stddev_pop("test_r2").alias("test_r2_std"))
