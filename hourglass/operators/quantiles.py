"""Exact and approximate quantiles.

``method``:

* ``"exact"``  – Spark's ``percentile`` aggregate (linear interpolation, the
  same definition as pandas/numpy and DuckDB ``quantile_cont``).  Its buffer
  holds one entry per distinct value, so it is the right choice per group or
  on low-cardinality columns.
* ``"select"`` – exact quantiles with bounded memory for whole-table columns of
  any size: an approximate sketch brackets each wanted order statistic, one
  counting pass checks the bracket, and only the values inside the bracket
  (a bounded number, narrowed again if needed) are sorted.
* ``"approx"`` – ``percentile_approx`` only (one pass, fixed-size sketch).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_of
from ..session import materialise
from .joins import key_join, measured

WINDOW_LIMIT = 100_000
ACCURACY = 10_000


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              method: str = "select", accuracy: int = ACCURACY, extra: Sequence = (),
              extra_out: dict | None = None) -> dict[str, list[float | None]]:
    """Global quantiles per column -> {column: [value per prob]} (driver gets k numbers).

    ``extra`` aggregate columns ride along in the first pass over the data;
    their values are stored in ``extra_out`` (saves a scan for callers such
    as ``describe`` that also need moments)."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    if extra and method == "select":
        return _select_quantiles(df, cols, probs, accuracy, extra, extra_out)
    if extra:
        row = df.agg(*extra).first()
        if extra_out is not None:
            extra_out.update(row.asDict())
    if method == "exact":
        row = df.agg(*[F.percentile(col_of(c), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    if method == "approx":
        row = df.agg(*[F.percentile_approx(col_of(c), probs, accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: [float(v) for v in row[f"q{i}"]] if row[f"q{i}"] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    if method != "select":
        raise ValueError(f"unknown quantile method {method!r}")
    return _select_quantiles(df, cols, probs, accuracy)


def medians(df: DataFrame, cols: Sequence[str], method: str = "select") -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, cols, [0.5], method).items()}


class _Target:
    """One wanted order statistic: 0-based ``rel`` rank inside the rows of
    column ``i`` that lie strictly between ``base_lo`` and ``base_hi``."""

    __slots__ = ("i", "rank", "rel", "base_lo", "base_hi", "n_base", "lo", "hi", "value", "p")

    def __init__(self, i, rank, n):
        self.i, self.rank, self.rel = i, rank, rank
        self.base_lo = self.base_hi = None
        self.n_base, self.lo, self.hi, self.value = n, None, None, None
        self.p = rank / max(n - 1, 1)


def _select_quantiles(df, cols, probs, accuracy, extra=(), extra_out=None):
    delta = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, p + s * delta)) for p in probs for s in (-1.0, 1.0)})
    xs = [col_of(c).cast("double") for c in cols]
    # pass 1: counts and a sketch around every requested probability
    row = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                 *[F.percentile_approx(x, probes, accuracy).alias(f"a{i}") for i, x in enumerate(xs)],
                 *extra).first()
    if extra_out is not None:
        extra_out.update(row.asDict())
    targets: dict[tuple[int, int], _Target] = {}
    plans = {}
    for i in range(len(cols)):
        n = row[f"n{i}"]
        plans[i] = []
        for p in probs:
            if n == 0:
                plans[i].append(None)
                continue
            pos = (n - 1) * p
            k = int(math.floor(pos))
            frac = pos - k
            ranks = [k] if frac == 0 or k + 1 >= n else [k, k + 1]
            plans[i].append((ranks, frac))
            sketch = row[f"a{i}"]
            for r in ranks:
                t = targets.setdefault((i, r), _Target(i, r, n))
                t.lo = sketch[probes.index(min(1.0, max(0.0, p - delta)))]
                t.hi = sketch[probes.index(min(1.0, max(0.0, p + delta)))]
    _resolve(df, xs, list(targets.values()), accuracy)
    out = {}
    for i, c in enumerate(cols):
        vals = []
        for plan in plans[i]:
            if plan is None:
                vals.append(None)
                continue
            ranks, frac = plan
            lo = targets[(i, ranks[0])].value
            vals.append(lo if len(ranks) == 1 else lo + (targets[(i, ranks[1])].value - lo) * frac)
        out[c] = vals
    return out


def _base(x, t: _Target):
    cond = x.isNotNull()
    if t.base_lo is not None:
        cond = cond & (x > F.lit(t.base_lo))
    if t.base_hi is not None:
        cond = cond & (x < F.lit(t.base_hi))
    return cond


def _resolve(df, xs, targets, accuracy, depth=0):
    """Pin each target to its exact value.

    The bracket [lo, hi] comes from a sketch whose rank error is at most
    n/accuracy, so at most about 8n/accuracy values lie strictly inside it.
    One counting pass splits the base rows into < lo, = lo, (lo, hi), = hi;
    only the values strictly inside are ever sorted (ties at the ends are
    counted, never collected), and that in the same pass when the bound
    guarantees a small bracket.  Wide brackets are narrowed recursively.
    """
    pending = [t for t in targets if t.value is None]
    if not pending:
        return
    if depth > 8:
        raise RuntimeError("quantile selection did not converge")
    combine = all(t.n_base * 8.0 / accuracy + 8 <= WINDOW_LIMIT for t in pending)
    # neighbouring ranks share a bracket: its counts are taken once
    at = {}
    for t in pending:
        at.setdefault((t.i, t.base_lo, t.base_hi, t.lo, t.hi), (len(at), t))
    group = {id(t): at[(t.i, t.base_lo, t.base_hi, t.lo, t.hi)][0] for t in pending}
    aggs = []
    for j, t in at.values():
        x = xs[t.i]
        base = _base(x, t)
        lo, hi = F.lit(t.lo), F.lit(t.hi)
        inside = base & (x > lo) & (x < hi)
        aggs += [F.count_if(base & (x < lo)).alias(f"b{j}"), F.count_if(base & (x == lo)).alias(f"l{j}"),
                 F.count_if(inside).alias(f"m{j}"),
                 F.count_if(base & (x == hi) & (hi != lo)).alias(f"h{j}")]
        if combine:
            aggs.append(F.sort_array(F.collect_list(F.when(inside, x))).alias(f"v{j}"))
    counts = [F.col(f"{c}{j}") for j, _ in at.values() for c in "blmh"]
    # the wanted element is picked where the values are: one number a target comes to the driver
    picks = [F.get(F.col(f"v{group[id(t)]}"), (F.lit(t.rel) - F.col(f"b{group[id(t)]}") - F.col(f"l{group[id(t)]}")).cast("int")).alias(f"x{n}")
             for n, t in enumerate(pending)] if combine else []
    row = df.agg(*aggs).select(*counts, *picks).first()
    collect, deeper = [], []
    for n, t in enumerate(pending):
        j = group[id(t)]
        below, eq_lo, mid, eq_hi = row[f"b{j}"], row[f"l{j}"], row[f"m{j}"], row[f"h{j}"]
        r = t.rel
        if r < below or r >= below + eq_lo + mid + eq_hi:
            # the sketch missed (not expected): re-sketch the same base more finely
            deeper.append(t)
        elif r < below + eq_lo:
            t.value = float(t.lo)
        elif r < below + eq_lo + mid:
            if combine:
                t.value = float(row[f"x{n}"])
            elif mid <= WINDOW_LIMIT:
                collect.append((t, r - below - eq_lo))
            else:
                t.base_lo, t.base_hi, t.rel, t.n_base = t.lo, t.hi, r - below - eq_lo, mid
                deeper.append(t)
        else:
            t.value = float(t.hi)
    if collect:
        row = df.agg(*[F.get(F.sort_array(F.collect_list(F.when(_base(xs[t.i], t) & (xs[t.i] > F.lit(t.lo))
                                                                & (xs[t.i] < F.lit(t.hi)), xs[t.i]))), F.lit(k)).alias(f"v{j}")
                       for j, (t, k) in enumerate(collect)]).first()
        for j, (t, _) in enumerate(collect):
            t.value = float(row[f"v{j}"])
    if deeper:
        acc = accuracy * 4
        delta = 3.0 / acc
        sk = df.agg(*[F.percentile_approx(F.when(_base(xs[t.i], t), xs[t.i]),
                                          [max(0.0, t.rel / max(t.n_base - 1, 1) - delta),
                                           min(1.0, t.rel / max(t.n_base - 1, 1) + delta)], acc).alias(f"s{j}")
                      for j, t in enumerate(deeper)]).first()
        for j, t in enumerate(deeper):
            t.lo, t.hi = sk[f"s{j}"]
        _resolve(df, xs, deeper, acc, depth + 1)


BROADCAST_TARGETS = 100_000
GRID = 1000


def grouped_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) with bounded memory.

    Pass 1 sketches every group.  Pass 2 joins the one-row-per-group
    brackets back to the data and, per group, counts the values below / at /
    strictly inside / at the top of each bracket, collecting the inside
    values only where the sketch bound guarantees at most ``WINDOW_LIMIT``.
    Targets still open (groups too large for that, or a sketch miss) are
    narrowed in further rounds that read only the rows inside their
    brackets: a fixed 1001-point quantile grid of the bracket, then the same
    count/collect step.  The table of open targets is broadcast only after
    its row count is checked.  Returns keys..., n, q (aligned with probs).
    """
    keys, probs = list(keys), [float(p) for p in probs]
    spark = df.sparkSession
    delta = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, p + s * delta)) for p in probs for s in (-1.0, 1.0)})
    data = df.select(*keys, col_of(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    st = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                 F.percentile_approx("_x", probes, accuracy).alias("_a"))
    exprs = []
    for j, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(p)
        k = F.floor(pos).cast("long")
        exprs += [k.alias(f"_k{j}"), (pos - k).alias(f"_f{j}"),
                  F.col("_a")[probes.index(min(1.0, max(0.0, p - delta)))].alias(f"_lo{j}"),
                  F.col("_a")[probes.index(min(1.0, max(0.0, p + delta)))].alias(f"_hi{j}")]
    st = st.select(*keys, "_n", *exprs)
    small = (F.col("_n") * 8.0 / accuracy + 8) <= WINDOW_LIMIT
    aggs = [F.first("_n").alias("_n")]
    for j in range(len(probs)):
        x, lo, hi = F.col("_x"), F.col(f"_lo{j}"), F.col(f"_hi{j}")
        inside = (x > lo) & (x < hi)
        aggs += [F.first(f"_k{j}").alias(f"_k{j}"), F.first(f"_f{j}").alias(f"_f{j}"),
                 F.first(f"_lo{j}").alias(f"_lo{j}"), F.first(f"_hi{j}").alias(f"_hi{j}"),
                 F.count_if(x < lo).alias(f"_b{j}"), F.count_if(x == lo).alias(f"_e{j}"),
                 F.count_if(inside).alias(f"_m{j}"), F.count_if((x == hi) & (hi != lo)).alias(f"_t{j}"),
                 F.sort_array(F.collect_list(F.when(small & inside, x))).alias(f"_v{j}")]
    counted = key_join(data, measured(st), keys).groupBy(*keys).agg(*aggs)
    rows = []
    for j in range(len(probs)):
        for w in (0, 1):
            rows.append(F.struct(
                F.lit(2 * j + w).alias("_qtid"), (F.col(f"_k{j}") + w).alias("_qrank"), F.col(f"_f{j}").alias("_qfrac"),
                F.lit(None).cast("double").alias("_qbase_lo"), F.lit(None).cast("double").alias("_qbase_hi"),
                (F.col(f"_k{j}") + w).alias("_qrel"), F.col(f"_lo{j}").alias("_qlo"), F.col(f"_hi{j}").alias("_qhi"),
                F.col(f"_b{j}").alias("_qb"), F.col(f"_e{j}").alias("_qe"), F.col(f"_m{j}").alias("_qm"),
                F.col(f"_t{j}").alias("_qt"), F.col(f"_v{j}").alias("_qv")))
    long = counted.select(*keys, "_n", F.inline(F.array(*rows)))
    # a rank past the last row is only the unused upper neighbour of the maximum
    long = long.filter(F.col("_qrank") < F.col("_n"))
    long = _settle(long)
    long = _persist(spark, long)
    done = long.filter(F.col("_qvalue").isNotNull()).select(*keys, "_n", "_qtid", "_qfrac", "_qvalue")
    pending = long.filter(F.col("_qvalue").isNull())
    acc = accuracy
    for _ in range(10):
        n_pending = pending.count()
        if n_pending == 0:
            break
        acc *= 4
        pending = _narrow(data, keys, pending, n_pending, acc)
        pending = _persist(spark, _settle(pending))
        done = done.unionByName(pending.filter(F.col("_qvalue").isNotNull())
                                .select(*keys, "_n", "_qtid", "_qfrac", "_qvalue"))
        pending = pending.filter(F.col("_qvalue").isNull())
    else:
        raise RuntimeError("grouped quantile selection did not converge")
    out = done.groupBy(*keys).agg(F.first("_n").alias("n"),
                                  F.map_from_entries(F.collect_list(F.struct("_qtid", "_qvalue"))).alias("_vals"),
                                  F.map_from_entries(F.collect_list(F.struct("_qtid", "_qfrac"))).alias("_fr"))
    q = []
    for j in range(len(probs)):
        v0, v1 = F.col("_vals")[2 * j], F.col("_vals")[2 * j + 1]
        fr = F.col("_fr")[2 * j]
        q.append(F.when(fr == 0, v0).otherwise(v0 + (v1 - v0) * fr))
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), F.array(*q).alias("q"))


def _settle(long: DataFrame) -> DataFrame:
    """Value of each target from its bracket counts; open targets get the
    base/rank of the next round."""
    r, b, e, m, t = (F.col(c) for c in ("_qrel", "_qb", "_qe", "_qm", "_qt"))
    inside_rank = (r >= b + e) & (r < b + e + m)
    collected = F.size(F.col("_qv")) == m
    value = (F.when(r < b, F.lit(None))
             .when(r < b + e, F.col("_qlo"))
             .when(inside_rank & collected, F.element_at(F.col("_qv"), (r - b - e + 1).cast("int")))
             .when(inside_rank, F.lit(None))
             .when(r < b + e + m + t, F.col("_qhi")))
    return long.select(
        "*", value.alias("_qvalue"),
        F.when(inside_rank, F.col("_qlo")).otherwise(F.col("_qbase_lo")).alias("_qnbase_lo"),
        F.when(inside_rank, F.col("_qhi")).otherwise(F.col("_qbase_hi")).alias("_qnbase_hi"),
        F.when(inside_rank, r - b - e).otherwise(r).alias("_qnrel"))


def _narrow(data: DataFrame, keys: list[str], pending: DataFrame, n_pending: int, acc: int) -> DataFrame:
    """One narrowing round for open targets: grid the bracket interior, pick
    the grid cell holding the rank, then count / collect inside it."""
    tgt = pending.select(*keys, "_n", "_qtid", "_qrank", "_qfrac", F.col("_qnbase_lo").alias("_qbase_lo"),
                         F.col("_qnbase_hi").alias("_qbase_hi"), F.col("_qnrel").alias("_qrel"))
    side = F.broadcast(tgt) if n_pending <= BROADCAST_TARGETS else tgt   # broadcast only when counted small
    x = F.col("_x")
    inb = ((F.col("_qbase_lo").isNull() | (x > F.col("_qbase_lo"))) &
           (F.col("_qbase_hi").isNull() | (x < F.col("_qbase_hi"))))
    grid = [i / GRID for i in range(GRID + 1)]
    sk = (key_join(data, side, keys).filter(inb)
              .groupBy(*keys, "_qtid").agg(F.count(F.lit(1)).alias("_qnb"),
                                         F.percentile_approx(x, grid, acc).alias("_qg")))
    tgt = key_join(tgt, sk, [*keys, "_qtid"])
    pos = F.col("_qrel") / F.greatest(F.col("_qnb") - 1, F.lit(1)) * GRID
    lo_i = F.greatest(F.floor(pos) - 1, F.lit(0)).cast("int")
    hi_i = F.least(F.ceil(pos) + 1, F.lit(GRID)).cast("int")
    tgt = tgt.select(*keys, "_n", "_qtid", "_qrank", "_qfrac", "_qbase_lo", "_qbase_hi", "_qrel", "_qnb",
                     F.col("_qg")[lo_i].alias("_qlo"), F.col("_qg")[hi_i].alias("_qhi"),
                     (hi_i - lo_i).alias("_qcells"))
    side = F.broadcast(tgt) if n_pending <= BROADCAST_TARGETS else tgt
    lo, hi = F.col("_qlo"), F.col("_qhi")
    inside = inb & (x > lo) & (x < hi)
    # the grid bound: at most cells/GRID of the base plus the sketch error
    bound_ok = (F.col("_qnb") * (F.col("_qcells") / GRID + 2.0 / acc) + 8) <= WINDOW_LIMIT
    cnt = (key_join(data, side, keys).filter(inb)
               .groupBy(*keys, "_qtid").agg(
                   *[F.first(c).alias(c) for c in ("_n", "_qrank", "_qfrac", "_qbase_lo", "_qbase_hi", "_qrel", "_qlo", "_qhi")],
                   F.count_if(inb & (x < lo)).alias("_qb"), F.count_if(inb & (x == lo)).alias("_qe"),
                   F.count_if(inside).alias("_qm"), F.count_if(inb & (x == hi) & (hi != lo)).alias("_qt"),
                   F.sort_array(F.collect_list(F.when(inside & bound_ok, x))).alias("_qv")))
    return cnt


def _persist(spark, df: DataFrame) -> DataFrame:
    """Cut lineage between rounds (shared checkpoint folder)."""
    return materialise(df)
