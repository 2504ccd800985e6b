"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Largest inner product becomes smallest Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm.  A k-means on a bounded sample (``SAMPLE_VALUES`` numbers) gives the lists; every vector is indexed in the list of its
nearest centre.  A query probes a share of the lists, more if they hold fewer than 2k other vectors.  Within a probed list the vectors are rotated at random and
lie in column blocks: after each block a hypothesis test compares the partial distance, scaled to all
dimensions, with the query's k-th best distance so far and abandons the candidate if it is unlikely to be nearer.
The first bound comes from the sample.  What survives all blocks is scored exactly, in double precision, on the original vectors.

Scale: lists are cut into blocks of about ``BLOCK_ROWS`` vectors and their queries into blocks of about ``BLOCK_QUERIES``;
a task joins one with one, so a list that holds a third of all vectors (copies) is spread, and no group grows with the
table.  Each pair of blocks returns k rows a query at most.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different
lengths are never compared; rows with the query's vec_id count as the query itself; equal rows that are queries are one
query; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import stored

K = 20
SAMPLE_VALUES = 1 << 20      # numbers in the sample that reaches the driver
PROBE_SHARE = 0.75           # of the lists
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
COLUMNS = 16                 # of a column block
STRICT = 2.1                 # of the test: larger abandons fewer candidates wrongly
SEED = 7


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors that take part, as doubles."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
            .where(F.forall("x", finite)).where(F.exists("x", lambda v: v != 0)))


class Lists:
    """Centres, rotation and sample of one dimension; small and of bounded size."""

    def __init__(self, sample: np.ndarray, n: int, top_square: float, seed: int = SEED, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.top_square = top_square
        self.sample = self.lift(sample)
        d = self.sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        k = int(max(1, min(np.sqrt(n), len(sample) // 4)))
        self.centres = self.sample[rng.permutation(len(sample))[:k]].copy()
        for _ in range(rounds):
            at = self.order(self.sample, 1)[:, 0]
            size = np.bincount(at, minlength=k)
            total = np.zeros_like(self.centres)
            np.add.at(total, at, self.sample)
            full = size > 0
            self.centres[full] = total[full] / size[full, None]
        self.sample_list = self.order(self.sample, 1)[:, 0] if len(self.sample) else np.zeros(0, int)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top_square - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def order(self, lifted: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        near = -2 * lifted @ self.centres.T + (self.centres ** 2).sum(axis=1)
        return np.argsort(near, axis=1, kind="stable")[:, :n]

    def first_bound(self, queries: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """Squared distance to the 2k-th nearest sampled vector of the probed lists (``reach``: query by list): at least k
        others are nearer, whatever the tests drop."""
        if len(self.sample) < 2 * k:
            return np.full(len(queries), np.inf)
        far = (queries ** 2).sum(1)[:, None] - 2 * queries @ self.sample.T + (self.sample ** 2).sum(1)
        far[~reach[:, self.sample_list]] = np.inf
        return np.partition(far, 2 * k - 1, axis=1)[:, 2 * k - 1] * (1 + 1e-9) + 1e-9


def query_lift(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.zeros(len(x))])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in column order: equal vectors get equal scores wherever they lie."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


DENSE = 0.1                  # share of pairs still in the race above which a column block is taken for all of them


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query: indices in order of query, score (largest first) and id, and their ranks from 0."""
    order = np.lexsort((ids, -score, i))
    of = i[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return order[rank < k], rank[rank < k]


def scan(queries: np.ndarray, own: np.ndarray, bound: np.ndarray, rows: np.ndarray, ids: np.ndarray, lists: Lists, k: int):
    """Adaptive dimension scan of one block: arrays query number, vec_id, score of each query's k best here."""
    q, x = query_lift(queries) @ lists.rotation, lists.lift(rows) @ lists.rotation
    d = q.shape[1]
    cuts = list(range(0, d, COLUMNS)) + [d]
    blocks = [(np.ascontiguousarray(q[:, a:b]), np.ascontiguousarray(x[:, a:b])) for a, b in zip(cuts, cuts[1:])]
    square = (queries ** 2).sum(axis=1)
    top = np.full((len(queries), k), -np.inf)
    bound = bound.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(rows), 512):
        some = slice(at, at + 512)
        part = np.zeros((len(queries), len(ids[some])))
        alive = np.ones(part.shape, bool)
        i = j = None
        for (qb, xb), seen in zip(blocks, cuts[1:]):
            # the hypothesis: scaled to all dimensions, the candidate is not beyond the bound
            loose = 1 if seen == d else (seen / d) * (1 + STRICT / np.sqrt(seen)) ** 2
            xb = xb[some]
            if i is None:
                part += (qb ** 2).sum(1)[:, None] - 2 * qb @ xb.T + (xb ** 2).sum(1)
                alive &= part <= (bound * loose + 1e-9)[:, None]
                if np.count_nonzero(alive) < DENSE * alive.size:
                    i, j = np.nonzero(alive)
                    part = part[i, j]
            else:
                part = part + ((qb[i] - xb[j]) ** 2).sum(axis=1)
                stay = part <= bound[i] * loose + 1e-9
                i, j, part = i[stay], j[stay], part[stay]
        if i is None:
            i, j = np.nonzero(alive)
        other = ids[some][j] != own[i]
        i, j = i[other], j[other] + at
        score = inner(queries[i], rows[j])
        pick, rank = _best(i, ids[j], score, k)
        i, j, score = i[pick], j[pick], score[pick]
        found.append((i, ids[j], score))
        new = np.full(top.shape, -np.inf)
        new[i, rank] = score
        top = -np.partition(-np.concatenate([top, new], axis=1), k - 1, axis=1)[:, :k]
        worst = top.min(axis=1)
        full = np.isfinite(worst)
        far = square + lists.top_square - 2 * np.where(full, worst, 0.0)
        bound = np.where(full, np.minimum(bound, far * (1 + 1e-9) + 1e-9), bound)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, v, s = (np.concatenate(c) for c in zip(*found))
    pick, _ = _best(i, v, s, k)
    return i[pick], v[pick], s[pick]


def _search(rows: DataFrame, d: int, k: int, every: int, probe_share: float, sample_values: int) -> DataFrame:
    """Search among the vectors of length ``d``."""
    import pandas as pd

    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    n, top_square = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    pick = max(64, sample_values // d)
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(pick).select("x").toPandas()
    lists = Lists(np.array(got["x"].tolist(), float), n, top_square)
    n_lists = len(lists.centres)
    n_probe = max(1, int(np.ceil(probe_share * n_lists)))

    def index(frames):
        for f in frames:
            x = np.array(f["x"].tolist(), float).reshape(-1, d)
            yield pd.DataFrame({"list": lists.order(lists.lift(x), 1)[:, 0] if len(x) else [], "vec_id": f["vec_id"],
                                "x": [v.tobytes() for v in x]})

    def probe(frames):
        for f in frames:
            x = np.array(f["x"].tolist(), float).reshape(-1, d)
            for at in range(0, len(x), 256):
                part = x[at:at + 256]
                near = lists.order(query_lift(part), n_lists)
                # the nearest n_probe, and further ones until they hold 2k vectors besides the query's own rows
                before = np.cumsum(held[near], axis=1) - held[near]
                want = (np.arange(n_lists) < n_probe) | (before < 2 * k + 1)
                own, at_list = np.nonzero(want)
                bound = lists.first_bound(query_lift(part), want[np.arange(len(part))[:, None], np.argsort(near, axis=1)], k)
                raw = [v.tobytes() for v in part]
                yield pd.DataFrame({"list": near[own, at_list], "vec_id": f["vec_id"].to_numpy()[at:at + 256][own], "bound": bound[own],
                                    "x": [raw[o] for o in own]})

    indexed = stored(rows.mapInPandas(index, "list int, vec_id long, x binary"), "vector-index")
    # one number a list: at most a quarter of the sample's rows
    n_rows = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows that share an id are one candidate less each: ids count
    n_ids = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.countDistinct("vec_id").alias("n")).collect()}
    held = np.array([n_ids.get(i, 0) for i in range(n_lists)], np.int64)
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])
    probes = stored(queries.mapInPandas(probe, "list int, vec_id long, bound double, x binary"), "vector-probes")
    n_ask = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = rows.sparkSession
    cut = pd.DataFrame([(i, -(-n_rows.get(i, 0) // BLOCK_ROWS), -(-n_ask.get(i, 0) // BLOCK_QUERIES)) for i in range(n_lists)],
                       columns=["list", "row_blocks", "ask_blocks"])
    cut = F.broadcast(spark.createDataFrame(cut, "list int, row_blocks int, ask_blocks int"))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    part = lambda blocks: F.pmod(F.xxhash64("vec_id", "x"), F.col(blocks)).cast("int")
    both = cut.where("row_blocks > 0 AND ask_blocks > 0")
    left = (indexed.join(both, "list").withColumn("row_block", part("row_blocks")).withColumn("ask_block", spread("ask_blocks"))
            .select("list", "row_block", "ask_block", "vec_id", "x"))
    right = (probes.join(both, "list").withColumn("ask_block", part("ask_blocks")).withColumn("row_block", spread("row_blocks"))
             .select("list", "row_block", "ask_block", "vec_id", "bound", "x"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        x, q = (np.frombuffer(b"".join(f["x"]), float).reshape(-1, d) for f in (a, b))
        own = b["vec_id"].to_numpy()
        i, v, s = scan(q, own, b["bound"].to_numpy(), x, a["vec_id"].to_numpy(), lists, k)
        return pd.DataFrame(dict(zip(names, (own[i], b["x"].to_numpy()[i], v, s))))

    key = ["list", "row_block", "ask_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(match, "query_id long, query_key binary, vec_id long, score double")
    return found.withColumn("query_key", F.xxhash64("query_key"))


def search(vectors: DataFrame, k: int = K, every: int = 20, probe_share: float = PROBE_SHARE, sample_values: int = SAMPLE_VALUES,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest vectors found for each query (ids divisible by ``every``)."""
    from functools import reduce

    from pyspark.sql import Window

    rows = stored(valid(vectors, id_col, vector_col).withColumn("d", F.size("x")), "vectors")
    lengths = [r["d"] for r in rows.select("d").distinct().orderBy("d").collect()]
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, [_search(rows.where(F.col("d") == d).drop("d"), d, k, every, probe_share, sample_values)
                                           for d in lengths])
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
