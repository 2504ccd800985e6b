"""Hard negatives by a vertical scan of branch and bound: dimensions one after another, most telling first.

Components become whole numbers, scores are their inner products.  For every anchor the scan reads the columns of a block in
descending size of the anchor's own component.  After each step the least and the largest contribution that the
remaining columns can add, from the block's column minima and maxima, bound every candidate's score; the candidates' bitmap
loses those whose bounds rule them out, until the exact scores of the rest are known.

1. Positives: rows of the anchor's label; the bound is the k-th best score so far, or the k-th best lower bound.
2. Negatives: rows of other labels; a candidate stays while its bounds meet the window of a positive, above that window's k-th best
   score so far.  Windows are settled on exact scores.

Scale: rows are cut into blocks, anchors into blocks; a task joins one with one, so memory is bounded and a label or a vector that a third
of the rows share is spread over all blocks.  Shuffled are rows x anchor blocks + anchors x row blocks; each pair of blocks
returns k rows an anchor (and window) at most.  The blocks of rows grow from ``LEAST_ROWS`` to ``BLOCK_ROWS`` with the table.

Defined results: rows with a null label or vector, or with any null or non-finite component, take no part, nor do rows
without a vec_id; vectors of different lengths are never compared; an empty vector has the score 0 with other empty ones; vectors whose
scaled norm reaches 2**25 take no part (their scores could leave exact doubles); rows with the anchor's vec_id are the anchor
itself, equal rows are one anchor but separate candidates; equal scores go by ascending vec_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hourglass.llm.common import stored

POSITIVES = NEGATIVES = 5
EVERY = 100                  # anchors are the rows whose vec_id it divides
SCALE = 256                  # of components
LOW, HIGH = 80, 100          # per cent of the positive's score between which a negative lies
LEAST_ROWS, BLOCK_ROWS, BLOCK_ANCHORS = 2048, 32768, 4096
TASKS = 64                   # row blocks that a table is cut into before blocks grow
STEP = 8                     # columns read between two looks at the bounds
AT_ONCE = 4096               # rows of a block scanned together
_NORM = 2.0 ** 50


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, q`` of the rows that take part; components as whole numbers."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", good)))
    small = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v * SCALE) * (v * SCALE)) < _NORM
    return rows.where(small).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("q"))


def mislabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Labels of every ``every``-th id moved on by one: a known share of wrong ones."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


class Columns:
    """Rows of a block, a slice of them at a time: columns, and their least and largest values."""

    def __init__(self, q: np.ndarray):
        self.columns = np.ascontiguousarray(q.T.astype(np.float64))         # whole numbers under 2**50: sums are exact
        self.low, self.high = (f(self.columns, axis=1, initial=s * np.inf) if len(q) else np.zeros(q.shape[1])
                               for f, s in ((np.min, 1), (np.max, -1)))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, drop) -> tuple[np.ndarray, np.ndarray]:
        """Rows left of the bitmap ``alive`` and their exact scores.  ``drop(least, most)`` says which scores are ruled out."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])
        least, most = ends.min(axis=0)[order], ends.max(axis=0)[order]
        rest_least, rest_most = (np.append(np.cumsum(v[::-1])[::-1], 0.0) for v in (least, most))
        rows = np.flatnonzero(alive)
        whole = len(rows) * 2 > len(alive)                                  # then columns are read whole, not gathered
        part = np.zeros(len(alive) if whole else len(rows))
        for at in range(0, len(order), STEP):
            now = order[at:at + STEP]
            block = self.columns[now]
            part = part + anchor[now] @ (block if whole else block[:, rows])
            seen = at + len(now)
            if seen == len(order):
                break
            own = part[rows] if whole else part
            out = drop(own + rest_least[seen], own + rest_most[seen])
            if out is not None and out.any():
                rows, own = rows[~out], own[~out]
                if not whole or len(rows) * 2 < len(alive):
                    part, whole = own, False
            if not len(rows):
                break
        return rows, part[rows] if whole else part


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Best:
    """The ``k`` best (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def bound(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        top = _first(score, ids, self.k)
        self.score, self.ids = score[top], ids[top]


def _matrix(table: pa.Table) -> np.ndarray:
    q = table.column("q").combine_chunks()
    return q.flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int32)


def _slices(rows: pa.Table):
    """Ids, labels and columns of a block's rows, ``AT_ONCE`` at a time, sorted by label."""
    ids, label, q = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows)
    order = np.lexsort((ids, label))
    for at in range(0, len(order), AT_ONCE):
        part = order[at:at + AT_ONCE]
        yield ids[part], label[part], Columns(q[part])


def positives_of(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Each anchor's ``k`` best rows of its label in one block: anchor, vec_id, score."""
    own, own_label, q = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors).astype(np.float64)
    best = [Best(k) for _ in own]
    for ids, label, columns in _slices(rows):
        for i, b in enumerate(best):
            alive = (label == own_label[i]) & (ids != own[i])
            if alive.any():
                left, score = columns.scan(q[i], alive, lambda least, most, b=b: most < max(b.bound(), _kth(least, k)))
                b.add(score, ids[left])
    names = np.repeat(anchors.column("anchor").to_numpy(), [len(b.ids) for b in best])
    return pa.table({"anchor": pa.array(names, pa.int64()), "vec_id": pa.array(np.concatenate([b.ids for b in best] or [[]]), pa.int64()),
                     "score": pa.array(np.concatenate([b.score for b in best] or [[]]).astype(np.int64), pa.int64())})


def negatives_of(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The ``k`` best rows of other labels in each window of each anchor, in one block: anchor, window (the positive's score), vec_id, score."""
    own, own_label, q = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors).astype(np.float64)
    tops = [sorted(set(t), reverse=True) for t in anchors.column("windows").to_pylist()]
    # the whole scores s with low * t <= 100 * s <= high * t
    windows = [[(t, -((-low * t) // 100), (high * t) // 100, Best(k)) for t in ts if -((-low * t) // 100) <= (high * t) // 100] for ts in tops]
    for ids, label, columns in _slices(rows):
        for i, of in enumerate(windows):
            if not of:
                continue
            alive = (label != own_label[i]) & (ids != own[i])
            if not alive.any():
                continue

            def drop(least, most, of=of):
                out = np.ones(len(least), bool)
                for _, a, b, best in of:
                    floor = max(a, best.bound())
                    if len(least) > k:
                        inside = (least >= a) & (most <= b)
                        floor = max(floor, _kth(least[inside], k))
                    out &= (most < floor) | (least > b)
                return out

            left, score = columns.scan(q[i], alive, drop)
            for _, a, b, best in of:
                fits = (score >= max(a, best.bound())) & (score <= b)
                best.add(score[fits], ids[left[fits]])
    found = [(n, t, best) for n, of in zip(anchors.column("anchor").to_pylist(), windows) for t, _, _, best in of if len(best.ids)]
    size = [len(b.ids) for _, _, b in found]
    return pa.table({"anchor": pa.array(np.repeat(np.array([f[0] for f in found], np.int64), size), pa.int64()),
                     "window": pa.array(np.repeat(np.array([f[1] for f in found], np.int64), size), pa.int64()),
                     "vec_id": pa.array(np.concatenate([f[2].ids for f in found] or [[]]), pa.int64()),
                     "score": pa.array(np.concatenate([f[2].score for f in found] or [[]]).astype(np.int64), pa.int64())})


def _joined(rows: DataFrame, anchors: DataFrame, n_row_blocks: int, n_anchor_blocks: int, match, schema: str) -> DataFrame:
    """``match`` of each block of rows with each block of anchors of the same vector length."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("row_block", deal("row", n_row_blocks)).withColumn("anchor_block", spread(n_anchor_blocks))
    right = anchors.withColumn("anchor_block", deal("anchor", n_anchor_blocks)).withColumn("row_block", spread(n_row_blocks))
    key = ["d", "row_block", "anchor_block"]

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return match(a, b) if a.num_rows and b.num_rows else match(a.slice(0, 0), b.slice(0, 0))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(both, schema)


def mine(rows: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows``, as :func:`scaled` returns them."""
    rows = stored(rows.withColumns({"d": F.size("q"), "row": F.monotonically_increasing_id()}), "scaled")
    anchors = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "q", "d").agg(F.min("row").alias("anchor")), "anchors")
    n, n_anchors = rows.count(), anchors.count()
    n_row_blocks = max(1, -(-n // min(BLOCK_ROWS, max(LEAST_ROWS, n // TASKS))))
    n_anchor_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    order = [F.desc("score"), "vec_id"]
    best = lambda df, k, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)

    found = _joined(rows, anchors, n_row_blocks, n_anchor_blocks, lambda a, b: positives_of(a, b, n_positives),
                    "anchor long, vec_id long, score long")
    positives = stored(best(found, n_positives, "anchor").withColumnsRenamed({"vec_id": "positive_id", "score": "window", "rank": "nth"}), "positives")
    asking = anchors.join(positives.groupBy("anchor").agg(F.collect_list("window").alias("windows")), "anchor")
    found = _joined(rows, asking, n_row_blocks, n_anchor_blocks, lambda a, b: negatives_of(a, b, n_negatives, low, high),
                    "anchor long, window long, vec_id long, score long")
    negatives = best(found, n_negatives, "anchor", "window")
    return (positives.join(negatives, ["anchor", "window"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"),
                    F.col("score").alias("negative_score")))


# ---------------------------------------------------------------------------------------------------- SQL check

ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor({SCALE} * x::DOUBLE) for x in embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT vec_id AS anchor_id, label, q FROM v WHERE vec_id % {EVERY} = 0),
s AS (SELECT anchor_id, a.label AS anchor_label, vec_id, v.label, list_dot_product(a.q, v.q)::BIGINT AS score
      FROM a JOIN v ON vec_id <> anchor_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                            row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
                     FROM s WHERE label = anchor_label) WHERE nth <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE label <> anchor_label AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
