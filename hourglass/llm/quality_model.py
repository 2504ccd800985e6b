"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is fitted on a bounded sample of labelled documents (``sample_rows``, the smallest hashes of doc_id): the
statistics of at most that many documents reach the driver, never their texts.  Trees are grown on binned statistics
and flattened into arrays; every document is then scored where it lies, by numpy traversal of all trees at once, in one
pass without a shuffle.  Inputs of a score are statistics of the text alone.

Defined results: a null or empty text has all statistics zero and is scored like any other; labels that are null are
left out, repeated labels of a document are averaged (1 from one half on); without labels of both kinds the score
is their smoothed share (0.5 with no label); repeated rows are scored alike; very long texts are read whole; other
columns are ignored when scoring and carried by :func:`keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 60, 4, 0.2, 64, 4, 1.0
CUT = 0.3

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "log_lines", "line_words", "upper", "digit", "space", "non_ascii", "stop",
    "exclaim", "comma", "bar", "symbol", "other_punct", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
    "distinct_lines", "ends_sentence", "noise_words", "long_words", "short_words",
]

_CLASS = np.full(256, -1)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n\v\f", "", ".", "!", ",", "|",
                             "#*$%&<>@^~_=+{}[]\\", "?;:'\"()-/`")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 3


def statistics(texts) -> np.ndarray:
    """One row of ``STATISTICS`` a text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    known = _CLASS >= 0
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        shares = np.bincount(_CLASS[known], np.bincount(raw, minlength=256)[known], 10) / len(raw)
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, m = max(1, len(words)), max(1, len(lines))
        size = np.fromiter(map(len, words), np.int64, len(words))
        count: dict[str, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        out[i] = (
            np.log1p(len(raw)), np.log1p(len(words)), size.sum() / n, np.log1p(len(lines)), len(words) / m, *shares,
            len(count) / n, max(count.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / n, len(set(lines)) / m, sum(x.rstrip()[-1] in ".!?…" for x in lines) / m,
            sum(w[-1] in "!#*$%&|" and (len(w) < 2 or w[-2] in "!#*$%&|") for w in words) / n,
            (size > 12).sum() / n, (size < 3).sum() / n)
    return out


@dataclass
class Forest:
    """Trees as flat arrays; a leaf points to itself."""

    feature: np.ndarray      # (nodes,) column of the statistics
    limit: np.ndarray        # (nodes,) go left at or below
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray        # (nodes,) log-odds of a leaf
    root: np.ndarray         # (trees,)
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i in range(0, len(x), 4096):
            part = x[i:i + 4096]
            row = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.root, (len(part), len(self.root)))
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total[i:i + 4096] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def constant(y: np.ndarray) -> Forest:
    p = (y.sum() + 1) / (len(y) + 2)
    none = np.zeros(0, np.int64)
    return Forest(none, none.astype(float), none, none, none.astype(float), none, 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
        min_leaf: int = MIN_LEAF, l2: float = L2) -> Forest:
    """Boosted trees for the logistic loss, grown level by level on per-node histograms."""
    if len(y) == 0 or y.min() == y.max():
        return constant(y)
    d = x.shape[1]
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)   # bin k: at most edges[k]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), base)
    feature, limit, left, right, value, root = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (limit, np.inf), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        k = len(feature) - 1
        left[k] = right[k] = k
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.full(len(y), node())
        root.append(int(at[0]))
        level = [root[-1]]
        for step in range(depth + 1):
            slot = np.searchsorted(level, at)                       # level is ascending
            slot = np.where((slot < len(level)) & (np.take(level, np.minimum(slot, len(level) - 1)) == at), slot, -1)
            use = slot >= 0
            s, k = slot[use], len(level)
            gs, hs = np.bincount(s, g[use], k), np.bincount(s, h[use], k)
            for j, n in enumerate(level):
                value[n] = rate * gs[j] / (hs[j] + l2)
            if step == depth:
                break
            best = np.zeros(k)
            split: list[tuple[int, int] | None] = [None] * k
            for f in range(d):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                cell = s * width + binned[use, f]
                gl, hl, nl = (np.bincount(cell, w, k * width).reshape(k, width).cumsum(1)
                              for w in (g[use], h[use], np.ones(len(s))))
                gr, hr, nr = gs[:, None] - gl, hs[:, None] - hl, nl[:, -1:] - nl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - (gs ** 2 / (hs + l2))[:, None]
                gain[(nl < min_leaf) | (nr < min_leaf)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(k), b]
                for j in np.flatnonzero(top > best + 1e-9):
                    best[j], split[j] = top[j], (f, int(b[j]))
            nxt = []
            for j, n in enumerate(level):
                if split[j] is not None:
                    f, b = split[j]
                    feature[n], limit[n] = f, edges[f][b]
                    left[n], right[n] = node(), node()
                    mine = use & (slot == j)
                    at = np.where(mine, np.where(binned[:, f] <= b, left[n], right[n]), at)
                    nxt += [left[n], right[n]]
            if not nxt:
                break
            level = nxt
        margin += np.array(value)[at]
    return Forest(*(np.array(a) for a in (feature, limit, left, right, value, root)), depth, base)


def held_out(doc_id: Column) -> Column:
    """The fold kept from training: crc32 of the id as text, divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **settings) -> Forest:
    """A forest from at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(sample_rows)

    def measure(frames):
        for frame in frames:
            yield frame[["doc_id", "y"]].assign(x=list(statistics(frame["text"].tolist())))

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id")                    # at most sample_rows rows of two numbers
            .mapInPandas(measure, "doc_id long, y int, x array<double>"))
    got = rows.orderBy(order, "doc_id", F.xxhash64("x")).limit(sample_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit(x, got["y"].to_numpy(float), **settings)


def score_column(forest: Forest, text: Column) -> Column:
    """The score of each text."""
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(forest.score(statistics(texts.fillna("").tolist())), dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                         score_column(forest, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the cut, with their columns unchanged."""
    return docs.where(score_column(forest, F.col(f"`{text_col}`")) >= CUT)
