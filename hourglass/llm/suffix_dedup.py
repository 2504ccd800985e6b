"""Exact substring dedup: maximal repeats from common-prefix interval trees over suffix arrays.

A byte is removed if a string of ``width`` bytes that covers it also starts anywhere else in the table.

1. Anchors.  Each start position has as its anchor the smallest rolling hash among the 32-byte strings that its window of
   ``width`` bytes holds (leftmost of equals).  Equal windows have equal anchors, and the starts of one anchor adjoin:
   a row holds an anchor's fingerprint, its run of starts and a digest of its context, the bytes those windows cover.
2. Fingerprints seen once cannot hold a repeat.  Equal contexts are one string; one that occurs twice is repeated as a whole.
3. The distinct contexts of a fingerprint meet in a task, many fingerprints in one suffix array (prefix doubling).  A stack
   scan of its common-prefix intervals tests each for left-extension diversity and yields the maximal repeats
   of at least ``width`` bytes with all their occurrences, not just neighbours.
4. The occurrences go back to every anchor of that context, and each document drops the union.

Scale: fingerprints and contexts are counted with a map-side part and joined back as plain shuffled tables, which Spark's skew
join can split.  A fingerprint with more than ``GROUP`` distinct contexts (a hot passage in ever other surroundings) is dealt to
several suffix arrays, and windows that are single in one are compared between them by digest.  Memory of a task is
bounded by ``BATCH`` bytes of contexts.

Digests have 128 bits; fingerprints may collide without harm, as the suffix array compares the bytes themselves.

Defined results: a null or empty text has no bytes; a text shorter than ``width`` keeps all; repeated rows are separate
occurrences, as are equal texts under other ids; null ids take part; matches never cross documents; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.chunks import text_blocks
from hourglass.llm.common import stored

WIDTH = 400
GRAM = 32                      # bytes of an anchor
GROUP = 8192                   # distinct contexts of a fingerprint in one suffix array: 6 MB, some 300 MB of ranks
BATCH = 1_000_000              # bytes in one suffix array, or a group more
SEGMENT = 4_000_000            # bytes of text handled at a time
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _mixed(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    h, k, mul = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while k < GRAM:
        h = h[:len(h) - k] * np.uint64(mul) + h[k:]
        k, mul = 2 * k, mul * mul & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors_of(texts: list[bytes], width: int = WIDTH):
    """Arrays ``text number, first start, last start, fingerprint`` and the contexts' digests, of several texts."""
    from xxhash import xxh3_128_digest

    raw = b"".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none, []
    h = _mixed(np.frombuffer(raw, np.uint8))
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, reach = width - GRAM + 1, 1                            # grams in a window
    while 2 * reach <= span:
        low = np.minimum(low[:len(low) - reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    owner = np.repeat(np.arange(len(texts)), size)[:len(low)]
    start = np.arange(len(low))
    fits = start + width <= end[owner]
    start, owner, at = start[fits], owner[fits], (low[fits] & _LOW).astype(np.int64)
    if not len(start):
        return none, none, none, none, []
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    owner = owner[new]
    digests = [xxh3_128_digest(raw[a:b + width]) for a, b in zip(first.tolist(), last.tolist())]
    begin = (end - size)[owner]
    return owner, first - begin, last - begin, h[at[new]].view(np.int64), digests


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _anchors(rows: DataFrame, width: int) -> DataFrame:
    """``fp, ctx, doc, tag, first, last``: a row an anchor."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block in text_blocks(batch, size=SEGMENT // 2):
                texts, own, skip = [], [], []
                for i, t in enumerate(block.column("text").to_pylist()):
                    t = t.encode()
                    # a long text goes in segments that share width - 1 bytes: each start lies in one of them
                    for a in range(0, max(1, len(t) - width + 1), SEGMENT):
                        texts.append(t[a:a + SEGMENT + width - 1])
                        own.append(i)
                        skip.append(a)
                parts, held, at = [], 0, 0
                for j, t in enumerate(texts):
                    held += len(t)
                    if held >= SEGMENT or j == len(texts) - 1:
                        parts.append((at, j + 1))
                        held, at = 0, j + 1
                for a, b in parts:
                    owner, first, last, fp, ctx = anchors_of(texts[a:b], width)
                    if not len(owner):
                        continue
                    source, shift = np.array(own[a:b])[owner], np.array(skip[a:b])[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp), pa.array(ctx, pa.binary()), block.column("doc").take(pa.array(source)),
                         block.column("tag").take(pa.array(source)), pa.array(first + shift), pa.array(last + shift)],
                        ["fp", "ctx", "doc", "tag", "first", "last"])

    return rows.mapInArrow(run, "fp long, ctx binary, doc long, tag long, first long, last long")


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of ``parts`` (columns of ranks, most significant first)."""
    key, bits = parts[0].astype(np.int64), int(parts[0].max(initial=0)).bit_length()
    for p in parts[1:]:
        more = int(p.max(initial=0)).bit_length()
        if bits + more > 63:
            key = _ranks(key).astype(np.int64)
            bits = int(key.max(initial=0)).bit_length()
        key, bits = key << more | p, bits + more
    return _ranks(key)


class SuffixArray:
    """The chosen starts of several contexts in order, with the common prefix of neighbours from ``width`` on.

    Prefix growth over the contexts laid end to end with a zero byte between: ranks of 8 bytes, then of three times as
    many, as long as that fits in ``width``; only starts are then ranked by ``width`` bytes and by all that follows.  What a
    comparison sees behind a context's end is cut off by the bytes that are left.
    """

    def __init__(self, contexts: list[bytes], width: int):
        raw = b"\0".join(contexts) + b"\0" * 8
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        begin = np.cumsum(size + 1) - size - 1
        n = len(raw) - 8
        code = np.frombuffer(raw, np.uint8)
        words = np.zeros(n, np.uint64)
        for j in range(8):
            words = words << np.uint64(8) | code[j:j + n]
        starts = size - width + 1
        self.owner = np.repeat(np.arange(len(contexts)), starts)
        self.start = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        at = begin[self.owner] + self.start

        def ahead(rank: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int32)
            out[:max(0, n - by)] = rank[by:] + 1                               # 0: behind the end of everything
            return out

        levels, h = [(min(8, width), _ranks(words if width >= 8 else words >> np.uint64(8 * (8 - width))))], min(8, width)
        while 3 * h <= width:
            rank = levels[-1][1]
            levels.append((3 * h, _joined([rank + 1, ahead(rank, h), ahead(rank, 2 * h)])))
            h *= 3
        top, longest = levels[-1][1], int(size.max())
        see = lambda by: np.where(at + by < n, top[np.minimum(at + by, n - 1)] + 1, 0)
        wide = _joined([see(min(by, width - h)) for by in range(0, width, h)])  # ranks of ``width`` bytes
        full = _joined([wide, *[see(by) for by in range(width, longest, h)]]) if longest > width else wide
        order = np.argsort(full, kind="stable")
        self.owner, self.start, at, wide = self.owner[order], self.start[order], at[order], wide[order]
        left = size[self.owner] - self.start                                   # bytes to the context's end
        self.common = np.zeros(max(0, len(at) - 1), np.int64)
        same = np.flatnonzero(wide[1:] == wide[:-1])
        a, b, room = at[same], at[same + 1], np.minimum(left[same], left[same + 1])
        common = np.full(len(same), width, np.int64)
        for step, rank in reversed(levels):
            going = np.ones(len(same), bool)
            while going.any():
                x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
                going &= (common < room) & (rank[x] == rank[y])
                common += np.where(going, step, 0)
        for _ in range(7):                                                     # the last bytes, one by one
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            common += (common < room) & (code[x] == code[y])
        self.common[same] = np.minimum(common, room)
        # what stands before each start; a context's first start counts as different from all
        before = code[np.maximum(at - 1, 0)].astype(np.int64)
        self.before = np.where(self.start == 0, 256 + np.arange(len(at)), before)

    def maximal_repeats(self, width: int):
        """``(length, first, last)`` of each left-diverse interval of at least ``width`` bytes: positions in the array."""
        deep = np.concatenate([[False], self.common >= width, [False]])
        opens = np.flatnonzero(~deep[:-1] & deep[1:])
        closes = np.flatnonzero(deep[:-1] & ~deep[1:])
        if not len(opens):
            return
        # an interval whose starts all follow the same byte has no left-diverse interval inside
        cuts = np.column_stack([opens, closes + 1]).ravel()
        padded = np.append(self.before, self.before[-1:])
        differ = np.minimum.reduceat(padded, cuts)[::2] != np.maximum.reduceat(padded, cuts)[::2]
        common, before = self.common, self.before
        for lo, hi in zip(opens[differ].tolist(), closes[differ].tolist()):
            stack: list[list] = []                    # [length, first, the byte before all of them or None if they differ]
            for i in range(lo, hi + 1):
                depth = int(common[i]) if i < hi else 0
                first, mark = i, int(before[i])
                while stack and stack[-1][0] > depth:
                    length, first, seen = stack.pop()
                    mark = seen if seen == mark else None
                    if mark is None:
                        yield length, first, i
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == mark else None
                elif depth >= width:
                    stack.append([depth, first, mark])


def _unions(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(contexts: list[tuple], width: int):
    """For a batch of ``(ctx, hot, bytes)``: rows of repeats by context, and window digests of hot fingerprints."""
    from xxhash import xxh3_128_digest

    sa = SuffixArray([c[2] for c in contexts], width)
    found: dict[int, list[tuple[int, int]]] = {}
    for length, first, last in sa.maximal_repeats(width):
        for i in range(first, last + 1):
            s = int(sa.start[i])
            found.setdefault(int(sa.owner[i]), []).append((s, s + length))
    repeats = [(contexts[k][0], a, b) for k, pairs in found.items() for a, b in _unions(pairs)]
    hot = np.array([c[1] for c in contexts], bool)
    windows = []
    if hot.any():
        deep = np.concatenate([[False], sa.common >= width, [False]])
        for i in np.flatnonzero(hot[sa.owner] & ~deep[:-1]).tolist():          # the first start of each distinct window
            ctx, _, raw = contexts[int(sa.owner[i])]
            s = int(sa.start[i])
            windows.append((xxh3_128_digest(raw[s:s + width]), 2 if deep[i + 1] else 1, ctx, s))
    return repeats, windows


def _contexts(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``fp, part, hot, ctx, raw``: the bytes of each wanted context, cut from one of the documents that hold it."""
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                fps, parts, hots, ctxs, raws = [], [], [], [], []
                for text, held in zip(part.column("text").to_pylist(), part.column("held").to_pylist()):
                    text = text.encode()
                    for c in held:
                        fps.append(c["fp"])
                        parts.append(c["part"])
                        hots.append(c["hot"])
                        ctxs.append(c["ctx"])
                        raws.append(text[c["first"]:c["last"] + width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps, pa.int64()), pa.array(parts, pa.int32()), pa.array(hots, pa.bool_()), pa.array(ctxs, pa.binary()),
                     pa.array(raws, pa.binary())], ["fp", "part", "hot", "ctx", "raw"])

    # a document's contexts are bounded by its own text
    held = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("fp", "part", "hot", "ctx", "first", "last")).alias("held"))
    match = rows["doc"].eqNullSafe(held["doc"]) & (rows["tag"] == held["tag"])
    return (rows.join(held, match).select("text", "held").mapInArrow(cut, "fp long, part int, hot boolean, ctx binary, raw binary")
            .dropDuplicates(["fp", "part", "ctx"]))


def _repeats(contexts: DataFrame, width: int) -> DataFrame:
    """``kind, ctx, a, b, window``: byte ranges of contexts (kind 0), windows of hot fingerprints (kind 1, b counts)."""
    def run(batches):
        import pyarrow as pa

        def rows(held):
            repeats, windows = _scan(held, width)
            out = [(0, c, a, b, None) for c, a, b in repeats] + [(1, c, s, n, w) for w, n, c, s in windows]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

        schema = pa.schema([("kind", pa.int32()), ("ctx", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("window", pa.binary())])
        held, size, now, group = [], 0, None, 0
        for batch in batches:
            for fp, part, hot, ctx, raw in zip(*(batch.column(c).to_pylist() for c in ("fp", "part", "hot", "ctx", "raw"))):
                if (fp, part) != now:
                    if len(held) - group == 1 and not hot and not held[group][1]:
                        size -= len(held.pop()[2])                 # alone in its group: nothing to compare
                    if size >= BATCH:
                        yield rows(held)
                        held, size = [], 0
                    now, group = (fp, part), len(held)
                held.append((ctx, hot, raw))
                size += len(raw)
        if held:
            yield rows(held)

    ordered = contexts.repartition("fp", "part").sortWithinPartitions("fp", "part")
    return ordered.mapInArrow(run, "kind int, ctx binary, a long, b long, window binary")


def spans(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, tag, a, b``: byte ranges of each document that repeats cover (they may overlap)."""
    rows = _rows(docs, id_col, text_col)
    anchors = stored(_anchors(rows, width), "repeat-anchors")
    twice = stored(anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("least"), F.max("ctx").alias("most"))
                   .where("n > 1").select("fp", (F.col("least") == F.col("most")).alias("same")), "repeat-fingerprints")
    shared = stored(anchors.join(twice, "fp"), "repeat-shared")
    same = shared.where("same").select("doc", "tag", F.col("first").alias("a"), (F.col("last") + width).alias("b"))
    mixed = shared.where(~F.col("same")).drop("same")
    one = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "tag", "first", "last")).alias("one")
    distinct = stored(mixed.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), one), "repeat-contexts")
    crowd = distinct.groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")).where("parts > 1")
    wanted = (distinct.join(stored(crowd, "repeat-crowds"), "fp", "left").withColumn("hot", F.col("parts").isNotNull())
              .select("fp", "ctx", "hot", F.when(F.col("hot"), F.pmod(F.xxhash64("ctx"), F.col("parts"))).otherwise(0).cast("int").alias("part"),
                      "one.doc", "one.tag", "one.first", "one.last"))
    found = stored(_repeats(_contexts(rows, wanted, width), width), "repeat-found")
    seen = found.where("kind = 1")
    again = seen.groupBy("window").agg(F.sum("b").alias("n")).where("n > 1").select("window")
    across = (seen.where("b = 1").join(stored(again, "repeat-windows"), "window")
              .select("ctx", "a", (F.col("a") + width).alias("b")))
    whole = distinct.where("n > 1").select("ctx", F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    ranges = stored(found.where("kind = 0").select("ctx", "a", "b").unionByName(across).unionByName(whole), "repeat-ranges")
    back = (mixed.join(ranges, "ctx")
            .select("doc", "tag", (F.col("first") + F.col("a")).alias("a"),
                    F.coalesce(F.col("first") + F.col("b"), F.col("last") + width).alias("b")))
    return same.unionByName(back)


_RESULT = "kept binary, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>"


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans, spans``: every document's bytes without those that repeats cover."""
    @F.pandas_udf(_RESULT)
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, held in zip(texts, found):
            raw = text.encode()
            union = _unions([(int(x["a"]), int(x["b"])) for x in held]) if held is not None else []
            kept, at = [], 0
            for a, b in union:
                kept.append(raw[at:a])
                at = b
            out.append((b"".join([*kept, raw[at:]]), len(raw), sum(b - a for a, b in union),
                        [{"start": a, "length": b - a} for a, b in union]))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "spans"])

    rows = _rows(docs, id_col, text_col)
    held = spans(docs, width, id_col, text_col).groupBy("doc", "tag").agg(F.collect_set(F.struct("a", "b")).alias("held"))
    match = rows["doc"].eqNullSafe(held["doc"]) & (rows["tag"] == held["tag"])
    done = rows.join(held, match, "left").select(rows["doc"].alias("doc_id"), cut(rows["text"], F.col("held")).alias("r"))
    r = F.col("r")
    return done.select("doc_id", r["kept"].alias("kept"), r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"),
                       F.size(r["spans"]).cast("long").alias("n_spans"), r["spans"].alias("spans"))


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
