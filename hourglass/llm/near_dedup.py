"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes its set of distinct word shingles, held as sorted 64-bit hashes; the first ``SKETCH`` values are its
   sketch.  Texts with the same set (128-bit digest) form a class; only one row per class goes on.
2. Inverted lists of retained values generate overlaps.  A value held by more than ``LIST`` classes is common: a class
   is indexed under the first ``INDEXED`` of its ``RETAINED`` values, those that are not common first, then common ones,
   the rarest first.  Lists of values that are not common give all their pairs (``LIST`` squared at most).  A class with
   few such values (a large family of near copies, or a text of everyday shingles) is indexed under pairs of
   values as well.  Of these lists and those of common values short ones give all pairs, long ones link every
   member to a pivot picked by hash, a different one for each key, and the lists of the rarest four common values then to their ``HUBS``
   most central members, those most like the pivots they met on average: the text that a family was made from is one, and
   its copies may be alike through it alone.  So a family's rows grow with its size, not its square.
3. Lists carry 16 bits of each of their members' retained values: pairs that overlap in too few of them end where they are
   made.  The union sketch of each other pair (the smallest values of both) estimates the Jaccard similarity and drops clear misses.
4. The exact Jaccard similarity of the full sets confirms each link.
5. Components by neighbour minimum and pointer jumping, over classes, written to the shared folder each round.  The lists of
   the rarest common values come first; pivots of other lists and hubs only meet members that lie in another component by then
   (a link within a component connects nothing).
6. A long list whose members lie in more than one component is compared in full: blocks by size and component, each with
   each, without pairs that are connected already or differ too much in size; sketches first, then full sets.  Found
   links join the others, and the components are taken again.  That work grows with the square of what stays unconnected
   in one list.

A link of similarity 0.8 is found unless the two share none of the values they are indexed under.  The worst case is a text
whose private values are just those that are not common: with a fifth of them private, 15 or more of the 20 retained
ones are with a chance of 1.8e-7 (binomial), else a common value is indexed too.  Sets of at most ``RETAINED`` values share
one of their first ``INDEXED`` for certain.  The retained values of a linked pair overlap in 3 or fewer of 20 with a chance of 8e-10
(binomial; sets of up to ``RETAINED`` values are judged exactly), the sketch test loses 2e-8.  Members of a long list meet
through pivots and hubs, or in step 6.

Defined results: a text without words (null, empty) has an empty set, is linked with nothing and is its own component;
fewer words than a shingle make one shingle; repeated rows are one class; a null doc_id takes part, and the component
is named by the smallest id that is not null; ties go to the smallest doc_id; an empty table gives an empty result;
other columns are ignored by :func:`components` and carried by :func:`keep_one`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import stored

SKETCH = 64          # values kept of each set
RETAINED = 20        # of them, the values whose lists are counted
INDEXED = 15         # of those, the values a class is listed under: those that are not common first
LIST = 40            # longest list that gives all its pairs
FEW = 8              # with fewer values that are not common, a class is listed under pairs of values too
HUBS = 3             # central members of a long list that all others are compared with first
BLOCK = 512          # members of a long list compared with as many others in one task,
BLOCK_VALUES = 1 << 18   # fewer if their sets hold more values than this
OVERLAP = 4          # retained values (of 20) that a pair must share, at a similarity of 0.8
SURE = 0.5           # estimates below this are dropped: six standard errors under 0.8
_MUL, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.  Only A-Z are lowered; words are split by ASCII space."""
    from xxhash import xxh3_64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * _MUL + h[j:len(h) - width + 1 + j]
        acc ^= acc >> np.uint64(29)
    acc = (acc ^ (acc >> np.uint64(32))) * _ODD
    return np.unique(acc ^ (acc >> np.uint64(30)))


def _digest(values: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(values.tobytes())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("tag"))


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, tag, n, cls, sketch``: the size of each document's set, its 128-bit digest and its smallest values."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("tag"), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())], ["doc", "tag", "n", "cls", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc long, tag long, n int, cls binary, sketch binary")


def _postings(classes: DataFrame) -> DataFrame:
    """``value, cls, n``: the retained values of each class."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [np.frombuffer(s, np.int64)[:RETAINED] for s in batch.column("sketch").to_pylist()]
            at = np.repeat(np.arange(len(values)), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values) if len(values) else np.zeros(0, np.int64)), batch.column("cls").take(pa.array(at)),
                 batch.column("n").take(pa.array(at))], ["value", "cls", "n"])

    return classes.select("cls", "n", "sketch").mapInArrow(run, "value long, cls binary, n int")


def _keys(marked: DataFrame) -> DataFrame:
    """``key, kind, cls, n, mini``: what each class is listed under (kind 0: a value, 1: a common value that gets hubs, 2: a pair,
    3: a further common value); ``mini`` holds 16 bits of each retained value."""
    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            out = []
            for cls, n, held in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "held"))):
                mini = np.zeros(RETAINED, "<u2")
                mini[:len(held)] = [x["value"] & 0xFFFF for x in held]
                mini = mini.tobytes()
                # one order for all classes: values that are not common, then common ones, the rarest first
                held = sorted((x["c"], x["value"] & 0xFFFFFFFFFFFFFFFF) for x in held)[:INDEXED]
                own, often = [v for c, v in held if not c], [v for c, v in held if c]
                out += [(v, 0, cls, n, mini) for v in own]
                out += [(v, 1 if i < 4 else 3, cls, n, mini) for i, v in enumerate(often)]
                if len(own) < FEW:
                    mixed = sorted([*sorted(often)[:6], *own])[:6]
                    out += [((a * 0x9E3779B97F4A7C15 ^ b) & 0xFFFFFFFFFFFFFFFF, 2, cls, n, mini) for a, b in combinations(mixed, 2)]
            keys = np.array([x[0] for x in out], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()),
                 pa.array([x[3] for x in out], pa.int32()), pa.array([x[4] for x in out], pa.binary())], ["key", "kind", "cls", "n", "mini"])

    held = marked.groupBy("cls", "n").agg(F.collect_list(F.struct("value", "c")).alias("held"))   # RETAINED at most
    return held.mapInArrow(run, "key long, kind int, cls binary, n int, mini binary")


def _overlapping(n: list[np.ndarray], mini: list[np.ndarray], per_cent: int) -> np.ndarray:
    """Which pairs (two arrays of sizes, two of minis, a row a pair) may reach the similarity."""
    small, large = np.minimum(*n), np.maximum(*n)
    out = 100 * small.astype(np.int64) >= per_cent * large.astype(np.int64)
    at = np.flatnonzero(out)
    need = np.minimum(max(1, OVERLAP + (per_cent - 80) // 5), -(-per_cent * large[at].astype(np.int64) // 100))
    for i in range(0, len(at), 4_000):
        part = at[i:i + 4_000]
        held = [np.arange(RETAINED) < x[part, None] for x in n]
        same = (mini[0][part][:, :, None] == mini[1][part][:, None, :]) & held[0][:, :, None] & held[1][:, None, :]
        out[part] = same.any(axis=2).sum(axis=1) >= need[i:i + 4_000]
    return out


def _minis(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, RETAINED)


def _all_pairs(lists: DataFrame, per_cent: int) -> DataFrame:
    """Pairs within lists of at most ``LIST`` members, whose sizes and retained values allow the similarity."""
    def run(batches):
        import pyarrow as pa

        for held in (b.column("held").slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            ends, members = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            cls, n, mini = (members.field(c) for c in ("cls", "n", "mini"))
            n, mini, size = n.to_numpy(), _minis(mini), np.diff(ends)
            for m in np.unique(size).tolist():
                starts, (i, j) = ends[:-1][size == m], np.triu_indices(m, 1)
                step = max(1, 40_000 // len(i))
                for k in range(0, len(starts), step):
                    base = starts[k:k + step, None]
                    x, y = (base + i).ravel(), (base + j).ravel()
                    may = _overlapping([n[x], n[y]], [mini[x], mini[y]], per_cent)
                    x, y = (cls.take(pa.array(v[may])).to_pylist() for v in (x, y))
                    x, y = map(min, x, y), map(max, x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()), pa.array(list(y), pa.binary())], ["a", "b"])

    held = lists.groupBy("key").agg(F.collect_list(F.struct("cls", "n", "mini")).alias("held")).where(F.size("held") > 1)
    return held.select("held").mapInArrow(run, "a binary, b binary")


def _star(members: DataFrame, pivots: DataFrame, per_cent: int) -> DataFrame:
    return _starred(members.join(pivots, "key"), per_cent)


def _starred(met: DataFrame, per_cent: int) -> DataFrame:
    """``a, b``: the members of each key with its pivot, where sizes and retained values allow the similarity."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n", "pivot_n")]
            may = _overlapping(n, [_minis(batch.column(c)) for c in ("mini", "pivot_mini")], per_cent) if batch.num_rows else []
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    fits = F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * per_cent
    return (met.where(fits & (F.col("cls") != F.col("pivot.cls")))
            .select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b"), "n", F.col("pivot.n").alias("pivot_n"),
                    "mini", F.col("pivot.mini").alias("pivot_mini")).mapInArrow(run, "a binary, b binary"))


def listing(classes: DataFrame) -> DataFrame:
    """``key, kind, cls, n, mini``: the inverted lists."""
    posted = stored(_postings(classes), "near-postings")
    often = stored(posted.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LIST),
                   "near-common")
    marked = posted.join(often, "value", "left").withColumn("c", F.coalesce("c", F.lit(0)))     # 0: not common
    return stored(_keys(marked), "near-keys")


def lists_of(keys: DataFrame) -> DataFrame:
    """``key, c, pivot``: size and pivot of each list of common values and pairs."""
    pivot = F.min(F.struct(F.xxhash64("key", "cls").alias("h"), "cls", "n", "mini"))
    return stored(keys.where("kind > 0").groupBy("key").agg(F.count(F.lit(1)).alias("c"), pivot.alias("pivot")).where("c > 1"), "near-lists")


def first_candidates(classes: DataFrame, keys: DataFrame, stat: DataFrame, per_cent: int) -> DataFrame:
    """``a, b, est``: pairs of classes that short lists, and the pivots of the rarest common values, bring together."""
    extra = keys.where("kind > 0").select("key", "cls", "n", "mini")
    short = extra.join(stat.where(F.col("c") <= LIST).select("key"), "key").repartition("key")
    pivots = stat.where(F.col("c") > LIST).select("key", "pivot")
    pairs = (_all_pairs(keys.where("kind = 0"), per_cent).unionByName(_all_pairs(short, per_cent))
             .unionByName(_star(keys.where("kind = 1").select("key", "cls", "n", "mini"), pivots, per_cent)).distinct())
    return stored(_estimated(_both(pairs, classes, "sketch")), "near-first")


def further_candidates(classes: DataFrame, keys: DataFrame, stat: DataFrame, first: DataFrame, roots: DataFrame, per_cent: int) -> DataFrame:
    """``a, b, est``: members of long lists with further pivots and with hubs, where they lie in different components."""
    pivots = stat.where(F.col("c") > LIST).select("key", "pivot")
    more = keys.where("kind > 1").select("key", "cls", "n", "mini")
    # the most central member of each of HUBS random shares of a common value's list
    met = first.select(F.explode(F.array("a", "b")).alias("cls"), "est").groupBy("cls").agg(F.avg("est").alias("like"))
    common = keys.where("kind = 1").select("key", "cls", "n", "mini")
    central = F.max(F.struct("like", F.xxhash64("cls").alias("h"), "cls", "n", "mini"))
    hubs = stored(common.join(met, "cls").groupBy("key", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(HUBS)).alias("share"))
                  .agg(central.alias("pivot")).select("key", "pivot"), "near-hubs")
    of = lambda name: roots.select(F.col("cls").alias(name), F.col("root").alias(f"{name}_root"))

    def apart(members: DataFrame, pivots: DataFrame) -> DataFrame:
        members = members.join(of("cls"), "cls", "left").withColumn("cls_root", F.coalesce("cls_root", "cls"))
        pivots = pivots.withColumn("pivot_cls", F.col("pivot.cls")).join(of("pivot_cls"), "pivot_cls", "left")
        pivots = pivots.select("key", "pivot", F.coalesce("pivot_cls_root", "pivot_cls").alias("pivot_root"))
        return members.join(pivots, "key").where(F.col("cls_root") != F.col("pivot_root")).select(
            "key", "cls", "n", "mini", F.struct("pivot.cls", "pivot.n", "pivot.mini").alias("pivot"))

    met_already = first.select("a", "b")
    pairs = _starred(apart(more, pivots).unionByName(apart(common, hubs)), per_cent).distinct().join(met_already, ["a", "b"], "left_anti")
    return _estimated(_both(pairs, classes, "sketch"))


def _both(pairs: DataFrame, by: DataFrame, *names: str) -> DataFrame:
    """``pairs`` with the columns ``names`` of ``by`` (one row a class) for a and for b."""
    for side in ("a", "b"):
        pairs = pairs.join(by.select(F.col("cls").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names]), side)
    return pairs


def _estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity from the union sketch; exact if both sketches are whole sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[:SKETCH]
    shared = np.intersect1d(x, y, assume_unique=True)
    return np.searchsorted(shared, both[-1], "right") / len(both)


def _estimated(pairs: DataFrame) -> DataFrame:
    """``a, b, est``; pairs far from any link are left out here already."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            est = [_estimate(x, y) for x, y in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist())]
            out = batch.select(["a", "b"]).append_column("est", pa.array(est, pa.float64()))
            yield out.filter(pa.array([e >= SURE / 2 for e in est], pa.bool_()))

    return pairs.select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a binary, b binary, est double")


def _confirm(pairs: DataFrame, column: str, keep) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(f"a_{column}").to_pylist(), batch.column(f"b_{column}").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([keep(x, y) for x, y in zip(a, b)], pa.bool_()))

    return pairs.select("a", "b", f"a_{column}", f"b_{column}").mapInArrow(run, "a binary, b binary")


def _full_sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``cls, full``: the whole sets of the classes ``wanted`` (``cls``, one row each)."""
    # one document of each class gives its full set
    first = signed.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc", "tag")).alias("d"))
    from_docs = first.join(wanted, "cls", "left_semi").select("cls", "d.doc", "d.tag")

    def full(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(sets, pa.binary())], ["cls", "full"])

    rows = _rows(docs, id_col, text_col)
    match = rows["doc"].eqNullSafe(from_docs["doc"]) & (rows["tag"] == from_docs["tag"])
    return (rows.join(from_docs, match).select("cls", "text").dropDuplicates(["cls"])
            .mapInArrow(full, "cls binary, full binary"))


def links(docs: DataFrame, signed: DataFrame, pairs: DataFrame, words: int, per_cent: int, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``a, b``: the candidate ``pairs`` of classes whose exact similarity is at least ``per_cent`` per cent."""
    likely = stored(pairs.where(F.col("est") >= SURE).select("a", "b"), "near-likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _full_sets(docs, signed, wanted, words, id_col, text_col)

    def exact(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= per_cent * (len(x) + len(y) - shared)

    return stored(_confirm(_both(likely, stored(sets, "near-sets"), "full"), "full", exact), "near-links")


def _shared(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many values each set of ``a`` shares with each of ``b``: products of 0-1 matrices, exact below 2**24."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    at = [(np.repeat(np.arange(len(s)), [len(v) for v in s]), np.concatenate(s)) for s in (a, b)]
    both = np.intersect1d(np.unique(at[0][1]), np.unique(at[1][1]), assume_unique=True)
    if not len(both):
        return out
    sides = []
    for row, value in at:
        col = np.minimum(np.searchsorted(both, value), len(both) - 1)
        held = both[col] == value
        row, col = row[held], col[held]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    for c in range(0, len(both), columns):
        width, parts = min(columns, len(both) - c), []
        for (row, col), n in zip(sides, out.shape):
            some = slice(*np.searchsorted(col, [c, c + width]))
            m = np.zeros((n, width), np.float32)
            m[row[some], col[some] - c] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the square matrix ``linked`` connects, one fewer than members in each component."""
    seen, edges = np.zeros(len(linked), bool), []
    for start in np.flatnonzero(linked.any(axis=1)):
        todo = [] if seen[start] else [start]
        seen[start] = True
        while todo:
            u = todo.pop()
            new = np.flatnonzero(linked[u] & ~seen)
            seen[new] = True
            edges += [(u, v) for v in new]
            todo += list(new)
    return edges


def _apart(f, column: str):
    """The members of one pair of blocks: frames of both sides (one frame twice for a block with itself), their values in
    ``column``, and which pairs lie in different components and fit in size."""
    x = f[f["side"] == 0]
    y = f[f["side"] == 1] if (f["side"] == 1).any() else x
    values = [[np.frombuffer(v, np.uint64) for v in s[column]] for s in (x, y)]
    roots, code = np.unique(np.array([*x["root"], *y["root"]], object), return_inverse=True)
    a, b = code[:len(x)], code[len(x):]
    return x, y, values, a[:, None] != b[None, :]


def remaining(docs: DataFrame, signed: DataFrame, classes: DataFrame, keys: DataFrame, roots: DataFrame, words: int,
              per_cent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``a, b``: links that connect the components ``roots`` further, None if no long list holds more than one component.

    Every two members of a long list that lie in different components and fit in size are compared, block with block:
    by their sketches in the first of the lists that they share, then by their full sets.  A pair of blocks returns a
    forest of its links, so the rows grow with the members, not with the links."""
    base = max(100 / per_cent, 1.01)
    step = F.floor(F.log(F.col("n")) / float(np.log(base)) * 0.999).cast("int")      # sizes that fit are a step apart at most
    held = keys.where("kind IN (1, 3)").join(roots, "cls", "left")
    held = stored(held.select("key", "cls", "n", F.coalesce("root", "cls").alias("root"), step.alias("step")), "near-held")
    count = stored(held.groupBy("key", "step", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")), "near-held-counts")
    open_ = count.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most_"), F.sum("c").alias("all"), F.sum("n").alias("values"))
    open_ = open_.where((F.col("least") != F.col("most_")) & (F.col("all") > LIST))
    one_block = (F.col("all") <= BLOCK) & (F.col("values") <= BLOCK_VALUES)
    open_ = stored(open_.select("key", one_block.alias("whole")), "near-open")
    if open_.isEmpty():
        return None
    # blocks: a list that is no longer than one is one; else of one component if it fills some, or of several small ones
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.pow(F.lit(float(base)), F.col("step") + 1))))
    count = count.join(open_, "key").withColumn("most", most).withColumn("big", ~F.col("whole") & (F.col("c") > F.col("most")))
    pool = count.groupBy("key", "step").agg(F.sum(F.when(F.col("big"), 0).otherwise(F.col("c"))).alias("small"))
    parts = F.ceil(F.when(F.col("big"), F.col("c")).otherwise(F.col("small")) / F.col("most"))
    count = count.join(pool, ["key", "step"]).select(
        "key", "step", "root", "whole", F.when(F.col("big"), F.col("root")).otherwise(F.lit(b"")).alias("own"),
        F.when(F.col("whole"), 1).otherwise(F.greatest(F.lit(1), parts)).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("own") == F.lit(b""), F.col("root")).otherwise(F.col("cls")), F.lit(2)), F.col("parts"))
    level = F.when(F.col("whole"), 0).otherwise(F.col("step"))
    placed = held.join(stored(count, "near-parts"), ["key", "step", "root"]).withColumn("step", level)
    placed = stored(placed.select("key", F.concat_ws("/", "step", F.hex("own"), part).alias("block"), "cls", "n", "root", "step", "own"), "near-placed")
    lists = placed.groupBy("cls").agg(F.sort_array(F.collect_list("key")).alias("lists"))
    blocks = stored(placed.select("key", "block", "step", "own").distinct(), "near-blocks")
    one, two = (blocks.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "step", "own")]) for side in "xy")
    meet = one.join(two, "key").where((F.col("x_block") <= F.col("y_block")) & (F.abs(F.col("x_step") - F.col("y_step")) <= 1)
                                      & ((F.col("x_own") != F.col("y_own")) | (F.col("x_own") == F.lit(b""))))
    meet = stored(meet.select("key", "x_block", "y_block"), "near-meet")
    pair = ["key", "x_block", "y_block"]
    left = meet.withColumn("block", F.col("x_block")).withColumn("side", F.lit(0))
    right = meet.where("x_block <> y_block").withColumn("block", F.col("y_block")).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).join(placed, ["key", "block"]).select(*pair, "side", "cls", "n", "root")
    rows = dealt.join(classes.select("cls", "sketch").join(lists, "cls"), "cls")

    def by_sketch(f):
        import pandas as pd

        x, y, (a, b), like = _apart(f, "sketch")
        shared = _shared(a, b)
        size = [np.array([len(v) for v in s]) for s in (a, b)]
        n, m = x["n"].to_numpy(np.int64), y["n"].to_numpy(np.int64)
        like &= shared >= SURE * np.maximum(size[0][:, None], size[1][None, :])
        like &= 100 * np.minimum(n[:, None], m[None, :]) >= per_cent * np.maximum(n[:, None], m[None, :])
        if like.any():
            key = f["key"].iloc[0]
            earlier = [[np.array([v for v in held if v < key], np.int64).view(np.uint64) for held in s["lists"]] for s in (x, y)]
            like &= _shared(*earlier) == 0
        stay = [s[like.any(axis=i)] for s, i in ((x, 1), (y, 0))]
        stay = pd.concat(stay).drop_duplicates(["side", "cls"])
        return stay[[*pair, "side", "cls", "root"]]

    def by_set(f):
        import pandas as pd

        x, y, (a, b), like = _apart(f, "full")
        shared = _shared(a, b).astype(np.int64)
        size = [np.array([len(v) for v in s], np.int64) for s in (a, b)]
        like &= 100 * shared >= per_cent * (size[0][:, None] + size[1][None, :] - shared)
        if x is y:
            names = list(x["cls"])
        else:
            names, k = [*x["cls"], *y["cls"]], len(x)
            square = np.zeros((len(names), len(names)), bool)
            square[:k, k:], square[k:, :k] = like, like.T
            like = square
        edges = _forest(like)
        return pd.DataFrame({"a": [names[i] for i, _ in edges], "b": [names[j] for _, j in edges]})

    form = "key long, x_block string, y_block string, side int, cls binary, root binary"
    alike = rows.groupBy(*pair).applyInPandas(by_sketch, form)
    alike = stored(alike, "near-alike")
    sets = stored(_full_sets(docs, signed, alike.select("cls").distinct(), words, id_col, text_col), "near-sets")
    return stored(alike.join(sets, "cls").groupBy(*pair).applyInPandas(by_set, "a binary, b binary"), "near-more")


def connect(edges: DataFrame) -> DataFrame:
    """``cls, root`` of every linked class: the smallest class that it reaches."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    now = stored(both.select(F.col("a").alias("cls")).distinct().withColumn("root", F.col("cls")), "near-roots")
    while True:
        near = both.join(now.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        least = stored(now.join(near, "cls").select("cls", F.least("root", "near").alias("root"), F.col("root").alias("old")), "near-roots")
        up = least.select(F.col("cls").alias("root"), F.col("root").alias("up"))
        nxt = stored(least.join(up, "root").select("cls", F.col("up").alias("root"), "old"), "near-roots")
        if nxt.where(F.col("root") != F.col("old")).isEmpty():
            return nxt.select("cls", "root")
        now = nxt.select("cls", "root")


def joined_up(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` after the links ``more``: members hang on their roots, which is all that earlier links said."""
    if more.isEmpty():
        return roots
    return connect(roots.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(more))


def _signed_components(docs: DataFrame, words: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, tag, n, cls, component_id, first``: ``first`` is the one row key (doc, tag) that stands for the component."""
    signed = stored(signatures(docs, words, id_col, text_col), "near-signed")
    some = signed.where("n > 0")
    key = F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("tag")))
    classes = stored(some.groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), key.alias("first")), "near-classes")
    keys = listing(classes)
    stat = lists_of(keys)
    first = first_candidates(classes, keys, stat, per_cent)
    roots = connect(links(docs, signed, first, words, per_cent, id_col, text_col))
    further = further_candidates(classes, keys, stat, first, roots, per_cent)
    roots = joined_up(roots, links(docs, signed, further, words, per_cent, id_col, text_col))
    more = remaining(docs, signed, classes, keys, roots, words, per_cent, id_col, text_col)
    if more is not None:
        roots = joined_up(roots, more)
    named = classes.select("cls", "first").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = stored(named, "near-named")
    best = stored(named.groupBy("root").agg(F.min("first").alias("best")), "near-best")
    of_class = stored(named.join(best, "root").select("cls", F.col("best").alias("first")), "near-of-class")
    linked = some.drop("sketch").join(of_class, "cls").select("doc", "tag", "n", "cls", "first")
    alone = signed.where("n = 0").select("doc", "tag", "n", "cls", F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("tag")).alias("first"))
    return linked.unionByName(alone)


def components(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    rows = _signed_components(docs, words, per_cent, id_col, text_col)
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                       F.col("first.doc").alias("component_id"), F.col("doc").eqNullSafe(F.col("first.doc")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the smallest id; of repeated rows, one); texts without words stay."""
    rows = _signed_components(docs, words, per_cent, id_col, text_col)
    p = "__hourglass_"
    stay = rows.where("n > 0 AND doc <=> first.doc AND tag = first.tag").select(F.col("doc").alias(p + "doc"), F.col("tag").alias(p + "tag"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumns({p + "id": F.col(f"`{id_col}`").cast("long"), p + "key": F.xxhash64(text)})
    match = F.col(p + "id").eqNullSafe(F.col(p + "doc")) & (F.col(p + "key") == F.col(p + "tag"))
    wordless = ~F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")
    empty = keyed.where(F.coalesce(wordless, F.lit(True)))
    one = (keyed.where(~F.coalesce(wordless, F.lit(True))).join(stay.distinct(), match, "left_semi")
           .dropDuplicates([p + "id", p + "key"]))
    return one.unionByName(empty).select(*[F.col(f"`{c}`") for c in docs.columns])
