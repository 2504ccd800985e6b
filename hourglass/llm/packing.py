"""Best-fit packing in bulk-synchronous steps.

Lengths and gaps are integers of at most ``capacity``, so the two sorted lists (documents by length, gaps by size)
are held run-length encoded: ``capacity`` lengths at most, whatever the number of documents.  Superstep by superstep,
longest class first, every document of a class seeks its successor, the smallest gap that holds it; conflicts are
resolved by rank (the k-th document of the class takes the k-th place of the sorted gaps); gaps are updated, and the
next class goes on with them.  A bin keeps taking documents of the class until they no longer fit, as best fit does.
What is left over opens new bins.

The table-sized work is distributed: documents get their rank within their class through (class, salt) windows and
summed counts, so a class with a third of all rows is spread over all partitions, and each task turns (class, rank) into
a bin and an offset by a search in the list of moves.  A run of gaps is used up by a class or its gap at least halves,
so the moves are at most about 3 * capacity * log2(capacity): a size that does not grow with the table.

Defined results: a null or empty text is one piece with the end id alone; ties within a class are dealt by rank; repeated
rows are packed each on its own; very long texts are cut into pieces of the capacity; other columns are ignored; an empty table
packs nothing.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourglass.llm.chunks import text_blocks, worker_coder
from hourglass.llm.common import stored, text_rows

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, words: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: ids of every whole text and the end id, cut at ``capacity``."""
    def run(batches):
        import pyarrow as pa

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            coder = worker_coder(path, words)
            for block in text_blocks(batch):
                cut = [_cut(raw + end, 4 * capacity) for raw in coder.encode(block.column("text").to_pylist())]
                n = [len(c) for c in cut]
                piece = np.concatenate([np.arange(k) for k in n]).astype(np.int32)
                parts = [p for c in cut for p in c]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(piece),
                     pa.array(piece.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in parts], pa.int64()),
                     pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _cut(raw: bytes, size: int) -> list[bytes]:
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Moves as rows ``length, first_rank, first_bin, offset, per_bin``, sorted by length and rank.

    Ranks from ``first_rank`` to the next move of that length go to bins from ``first_bin`` on, ``per_bin`` in each,
    from ``offset`` on.
    """
    gaps: dict[int, list[list[int]]] = {}      # gap -> runs [first_bin, n_bins]
    sizes: list[int] = []                      # the gaps that have runs, ascending
    moves, bins = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)                      # the successor of this length
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = gap // length
            whole = min(n, left // per)
            if whole:
                moves.append((length, rank, first, capacity - gap, per))
                rank, left = rank + whole * per, left - whole * per
                leave(gap - per * length, first, whole)
            if left and whole < n:                                      # fewer documents than one bin takes
                moves.append((length, rank, first + whole, capacity - gap, per))
                leave(gap - left * length, first + whole, 1)
                rank, whole, left = rank + left, whole + 1, 0
            leave(gap, first + whole, n - whole)
    return np.array(sorted(moves), np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    own = items.columns
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*keys, "length"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    counts = stored(counts, "packing-counts")
    moves = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    ranked = salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*keys)))
    ranked = (ranked.join(base.hint("merge"), ["length", "__salt"])        # both lie by that key; a broadcast would grow
              .withColumn("__rank", (F.col("__base") + F.col("__row") - 1).cast("long"))
              .select(*own, "__rank"))
    key = moves[:, 0] << 44 | moves[:, 1]

    def place(frames):
        import pyarrow as pa

        for batch in frames:
            frame = batch.select(["length", "__rank"])
            length, rank = (frame.column(i).to_numpy() for i in (0, 1))
            m = moves[np.searchsorted(key, length << 44 | rank, "right") - 1]
            k = rank - m[:, 1]
            batch = batch.drop_columns(["__rank"])
            batch = batch.append_column("sequence_id", pa.array(m[:, 2] + k // m[:, 4]))
            yield batch.append_column("offset", pa.array(m[:, 3] + k % m[:, 4] * length))

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in ranked.schema.fields if f.name != "__rank"])
    for name in ("sequence_id", "offset"):
        schema = schema.add(name, LongType())
    return ranked.mapInArrow(place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    cut = stored(pieces(docs, path, end_id, capacity).drop("ids"), "packing-pieces")
    return pack(cut, capacity)
