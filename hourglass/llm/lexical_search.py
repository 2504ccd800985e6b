"""Ranked lexical search by presence masks: every document is ranked for each item, exactly.

1. Documents become postings over the items' vocabulary: term numbers and counts of each document, written once.  Counts
   of documents and terms are summed from them, in parts.
2. A block of postings is turned by term.  For an item, one bit a distinct term is set in the words of every document that
   holds it: its presence mask.  Equal masks are one group of documents.
3. The highest score a mask can reach is the sum of its terms' largest contributions in the block.  Groups are scored in
   descending order of it, and a block ends when the next group cannot reach the item's k-th best score so far.
4. Each task keeps k documents an item; those are merged in two steps, first by salts, then by item.

Scale: documents are read once and never shuffled; what is shuffled is k rows an item and task.  Items go to the tasks in
batches of about ``ITEM_BYTES`` (a longer text is a batch of its own), each batch a scan of the documents, so that what is
sent has a bound however many items there are.  A word that every document holds makes its postings longer, by one
number a document.  Blocks shrink when an item has many terms, so that a block's table stays under ``CELLS`` numbers.

Defined results: null or empty texts (and texts without a term) are neither counted nor ranked, such items have no rows; a
null doc_id takes part and comes last among equal scores; repeated documents are ranked each; items equal in id and text
are one, items equal in id alone are ranked each from 1; equal scores go by ascending doc_id; very long texts are
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hourglass.llm.chunks import text_blocks
from hourglass.llm.common import stored

K = 20
ITEM_BYTES = 4 << 20         # of item texts sent to the tasks at once
BLOCK = 8192                 # documents of a block, fewer if an item has many terms
CELLS = 1 << 24              # numbers of a block's table of one item
SATURATION, LENGTH_SHARE = 12, 25    # of the score: 1.2 and 0.25 in tenths and hundredths

#: A-Z to a-z; ASCII that is neither letter nor digit to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def _indexed(vocabulary: dict[bytes, int]):
    """Arrow batches of doc_id, text to doc_id, n, ids, tfs: the vocabulary's terms in each text, by number."""
    size = len(vocabulary)

    def index(batches):
        get = vocabulary.get
        for batch in batches:
            for part in text_blocks(batch):
                lengths, found, at = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = terms(text)
                    lengths.append(len(words))
                    ids = [j for j in map(get, words) if j is not None]
                    if ids:
                        found.append(np.array(ids, np.int64))
                        at.append(i)
                key = np.concatenate([x + i * size for x, i in zip(found, at)]) if found else np.zeros(0, np.int64)
                key, tf = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(part.num_rows + 1) * max(size, 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (key % max(size, 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), *lists],
                                                 names=["doc_id", "n", "ids", "tfs"])

    return index


def _counted(size: int):
    """Postings to partial sums: documents holding each term; documents with a term (-1) and their terms (-2)."""

    def count(batches):
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(b.column("ids").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held]).astype(np.int64)),
                                          pa.array(np.concatenate([[docs, total], df[held]]).astype(np.int64))], names=["term", "n"])

    return count


class Postings:
    """A block of documents turned by term: rows and contributions of each term, and its largest contribution."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, ids: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int, size: int):
        tf, m = tfs.astype(np.int64), 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * n_docs) // max(n_terms, 1)
        row = np.repeat(np.arange(len(n)), np.diff(ends))
        order = np.argsort(ids, kind="stable")
        self.rows = row[order]
        self.parts = ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[row]))[order]
        self.starts = np.searchsorted(ids[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.parts, self.starts[held])
        self.n = len(n)

    def masks(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence masks of an item's terms (documents by words of 64 bits) and the terms' contributions (term by document)."""
        mask = np.zeros((-(-len(own) // 64), self.n), np.uint64)
        table = np.zeros((len(own), self.n), np.int64)
        for j, t in enumerate(own):
            a, b = self.starts[t], self.starts[t + 1]
            rows = self.rows[a:b]
            mask[j >> 6, rows] |= np.uint64(1 << (j & 63))
            table[j, rows] = self.parts[a:b]
        return mask, table

    def best(self, own: np.ndarray, weight: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the documents that may be among the ``k`` best above or at ``floor``."""
        mask, table = self.masks(own)
        some = np.flatnonzero(mask.any(axis=0))
        if not len(some):
            return some, np.zeros(0, np.int64)
        words = mask[:, some]
        if len(words) == 1:
            order = np.argsort(words[0], kind="stable")
        else:
            order = np.lexsort(words)
        words = words[:, order]
        first = np.flatnonzero(np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(axis=0)]))
        groups = words[:, first]                                          # the distinct masks
        bits = np.unpackbits(np.ascontiguousarray(groups.T).view(np.uint8), axis=1, bitorder="little")[:, :len(own)]
        most = bits.astype(np.int64) @ (weight * self.most[own])
        by = np.argsort(-most, kind="stable")
        size = np.diff(np.append(first, len(some)))
        found, scores, at, take = [], [], 0, 4 * k
        while at < len(by) and most[by[at]] >= floor:
            upto = at + int(np.searchsorted(np.cumsum(size[by[at:]]), take)) + 1
            chosen = by[at:upto]
            chosen = chosen[most[chosen] >= floor]
            rows = some[order[np.concatenate([np.arange(first[g], first[g] + size[g]) for g in chosen])]]
            score = weight @ table[:, rows]
            found.append(rows[score >= floor])
            scores.append(score[score >= floor])
            have = np.concatenate(scores)
            if len(have) >= k:
                floor = max(floor, int(np.partition(have, len(have) - k)[len(have) - k]))
            at, take = upto, 2 * take
        if not found:
            return some[:0], np.zeros(0, np.int64)
        rows, score = np.concatenate(found), np.concatenate(scores)
        return rows[score >= floor], score[score >= floor]


def _ranked(queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, size: int, k: int):
    """Postings to each task's ``k`` best documents of every item: item, salt, doc_id, score."""
    widest = max((len(own) for own, _ in queries), default=1)
    block = int(min(BLOCK, max(64, CELLS // max(widest, 1))))

    def rank(batches):
        from pyspark import TaskContext

        kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, tfs = (part.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
                ends = part.column("ids").offsets.to_numpy()
                docs = Postings(part.column("n").to_numpy(), ends - ends[0], ids, tfs, n_docs, n_terms, size)
                names, unnamed = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for q, (own, weight) in enumerate(queries):
                    name, none, score = kept[q]
                    rows, new = docs.best(own, weight, int(score[-1]) if len(score) == k else 1, k)
                    if len(rows):
                        name, none, score = (np.concatenate(x) for x in ((name, names[rows]), (none, unnamed[rows]), (score, new)))
                        top = np.lexsort((name, none, -score))[:k]
                        kept[q] = name[top], none[top], score[top]
        salt = TaskContext.get().partitionId()
        for q in range(0, len(queries), 1000):
            name, none, score = (np.concatenate([x[i] for x in kept[q:q + 1000]]) for i in range(3))
            item = np.repeat(np.arange(q, min(q + 1000, len(queries))), [len(x[2]) for x in kept[q:q + 1000]])
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(np.full(len(item), salt, np.int32)),
                                              pa.array(name, mask=none), pa.array(score)], names=["item", "salt", "doc_id", "score"])

    return rank


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_batch(docs: DataFrame, batch: list, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for a batch of (item_id, text) rows."""
    spark = docs.sparkSession
    texts = [terms(r["text"]) for r in batch]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in texts for t in x}))}
    size = len(vocabulary)
    postings = stored(docs.mapInArrow(_indexed(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>")
                      .where(F.col("n") > 0), "postings")
    sums = {r["term"]: r["n"] for r in postings.mapInArrow(_counted(size), "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect()}           # one row a term of the batch
    n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([_weight(n_docs, sums.get(i, 0)) for i in range(size)], np.int64)
    queries = []
    for x in texts:
        own, often = np.unique(np.array([vocabulary[t] for t in x], np.int64), return_counts=True)
        weight = weights[own] * often
        held = (weight > 0) & np.array([i in sums for i in own.tolist()], bool)
        queries.append((own[held], weight[held]))
    found = postings.mapInArrow(_ranked(queries, n_docs, n_terms, size, k), "item int, salt int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    # a thousand tasks a salt
    merged = best(best(found.withColumn("salt", F.floor(F.col("salt") / 1000)), "item", "salt").drop("rank"), "item")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], "item int, item_id long")
    return merged.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score for each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = stored(items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
                   .where(F.col("text").isNotNull()).dropDuplicates(["item_id", "text"]), "items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // item_bytes))
    found = []
    for b in range(n):                                                       # a batch at a time: what is sent has a bound
        batch = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        if batch:
            found.append(_search_batch(rows, batch, k) if n == 1 else stored(_search_batch(rows, batch, k), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------------------------------------------- SQL check

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM i) GROUP BY item_id, t),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, nn),
m AS (SELECT rid, doc_id, 100 - {LENGTH_SHARE} + (({LENGTH_SHARE} * len(w)::BIGINT * nn) // ll) AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT item_id, rid, sum(c * w * ((1000000000 * tf) // (1000 * tf + {SATURATION} * m)))::BIGINT AS score, min(doc_id) AS doc_id
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY item_id, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
