"""Substring dedup by content-defined chunks.

A gear rolling hash cuts each text (as UTF-8 bytes) into variable chunks: the cut depends on the last 20 bytes only, so
an insertion moves no later cut.  Chunks are compared by digest; the smallest doc_id that has a digest keeps it (its
first place in that text), all others are duplicates.  A run of consecutive duplicate chunks of at least
``min_run`` bytes is removed, so that a common phrase alone touches nothing.

Scale: digests meet in one aggregate with a map-side part (first document and count of each digest), and the digests seen
twice are joined back with the chunks.  Both sides of that join are plain shuffled tables, so a digest that a third of
all documents share is split by Spark's skew join; nothing is collected by digest.  A document's duplicate chunks meet
in one row, which is bounded by its own text.

Digests have 86 bits: among 3e12 chunks (100 TB) a chance match is expected 0.06 times, and it removes text only where it makes a run
long enough.  A row is known by its doc_id and 64 bits of its text's hash, so rows of one id, or of none, are told apart.
A passage loses its whole chunks; up to a chunk at either end stays.

Defined results: a null or empty text stays empty; a null doc_id orders after all others; rows that repeat a doc_id count
as the same document (equal rows keep equal texts), rows with one id and different texts are cut each on its own;
an empty table gives an empty result; other columns are ignored by :func:`dedup` and carried by :func:`dedup_documents`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.chunks import text_blocks
from hourglass.llm.common import stored

MEAN_CHUNK, MIN_GAP, MAX_CHUNK, MIN_RUN = 24, 8, 255, 100
WINDOW = 32                       # bytes summed; the bits compared depend on the last 20
_SHIFT, _BITS = 8, 12
_MORE = 22                        # bits of a digest beside the first 64
_LAST = (1 << 63) - 1             # orders null ids last


def gear_table(seed: int = 1) -> np.ndarray:
    """256 well-mixed 32-bit values from a multiply-xorshift rule, then a zero for the padding between texts."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return np.append((x >> np.uint64(32)).astype(np.uint32), np.uint32(0))


GEAR = gear_table()


def cut(texts: list[bytes], mean: int = MEAN_CHUNK, min_gap: int = MIN_GAP, max_chunk: int = MAX_CHUNK):
    """Chunks of several texts: arrays ``text number, start, length`` in order, and the chunks' digests (two columns of 64 and 22 bits).

    A position is a cut where the rolling hash is small and no such position lies within the ``min_gap`` bytes before it;
    longer gaps are cut every ``max_chunk`` bytes.
    """
    from xxhash import xxh3_128_digest

    pad = b"\0" * WINDOW
    raw = pad + b"".join(x + pad for x in texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + WINDOW) - size                              # where each text starts in raw
    code = np.frombuffer(raw, np.uint8).astype(np.int16)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + size, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    code[~inside] = 256
    h = GEAR[code]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    small = ((h >> np.uint32(_SHIFT)) & np.uint32((1 << _BITS) - 1)) < (1 << _BITS) // mean
    at = np.flatnonzero(small & inside) + 1                              # a cut after this byte
    at = at[np.diff(at, prepend=-min_gap) >= min_gap]
    has = size > 0
    starts, ends = first[has], (first + size)[has]
    cuts = np.unique(np.concatenate([at, starts, ends]))
    begin, end = cuts[:-1], cuts[1:]
    real = inside[begin] if len(begin) else np.zeros(0, bool)            # not the padding between texts
    begin, end = begin[real], end[real]
    parts = -(-(end - begin) // max_chunk)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = np.repeat(begin, parts) + k * max_chunk, np.repeat(end, parts)
    end = np.minimum(begin + max_chunk, end)
    digest = np.frombuffer(b"".join(xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())), "<i8").reshape(-1, 2).copy()
    digest[:, 1] &= (1 << _MORE) - 1
    owner = np.searchsorted(first, begin, "right") - 1
    return owner, begin - first[owner], end - begin, digest


def _keys(docs: DataFrame, id_col: str, text_col: str):
    """Columns doc (null ids last), tag (tells apart texts that share an id) and text (null: empty)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)), F.xxhash64(text), text


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_CHUNK) -> DataFrame:
    """``digest, doc, tag, place``: a row a chunk.  ``place`` packs the rest of the digest (22 bits), start (33), length (8) and a bit
    that tells that the same text has the chunk earlier."""
    def run(frames):
        import pyarrow as pa

        for batch in frames:
            for block in text_blocks(batch, size=4_000_000):
                owner, start, length, digest = cut([x.encode() for x in block.column("text").to_pylist()], mean)
                order = np.lexsort((start, digest[:, 1], digest[:, 0], owner))
                again = np.zeros(len(order), np.int64)
                same = (digest[order][1:] == digest[order][:-1]).all(axis=1) & (owner[order][1:] == owner[order][:-1])
                again[order[1:][same]] = 1
                place = digest[:, 1] << 42 | start << 9 | length << 1 | again
                doc, tag = (block.column(c).to_numpy()[owner] for c in ("doc", "tag"))
                for i in range(0, len(digest), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 200_000]) for x in (digest[:, 0], doc, tag, place)],
                                                     ["digest", "doc", "tag", "place"])

    doc, tag, text = _keys(docs, id_col, text_col)
    rows = docs.select(doc.alias("doc"), tag.alias("tag"), text.alias("text"))
    return rows.mapInArrow(run, "digest long, doc long, tag long, place long")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_CHUNK) -> DataFrame:
    """``doc, tag, start, length, first_doc``: the chunks that an earlier document, or the text itself, has before."""
    found, place = chunks(docs, id_col, text_col, mean), F.col("place")
    more = F.shiftrightunsigned(place, 42)
    twice = (found.groupBy("digest", more.alias("more")).agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    # written first, so that both sides of the join are shuffled for it alone and a hot digest can be split
    twice = stored(twice, "chunk-digests")
    return (found.join(twice, "digest").where(more == F.col("more"))
            .where((F.col("doc") > F.col("first_doc")) | (place.bitwiseAND(F.lit(1)) == 1))
            .select("doc", "tag", F.shiftright(place, 9).bitwiseAND(F.lit((1 << 33) - 1)).alias("start"),
                    F.shiftright(place, 1).bitwiseAND(F.lit(255)).alias("length"), "first_doc"))


def _runs(raw: bytes, chunks_, min_run: int) -> list[tuple[int, int, list[int]]]:
    """Maximal runs of adjoining chunks of ``min_run`` bytes or more, shrunk to whole characters, with their origins."""
    out, at, end, origin = [], None, None, set()
    for c in [*sorted((int(c["start"]), int(c["length"]), int(c["first_doc"])) for c in chunks_), (-1, 0, 0)]:
        if at is not None and c[0] == end:
            end += c[1]
            origin.add(c[2])
            continue
        if at is not None and end - at >= min_run:
            a, b = at, end
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            if b > a:
                out.append((a, b, sorted(origin)))
        at, end, origin = c[0], c[0] + c[1], {c[2]}
    return out


_RESULT = "kept string, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, origin_doc_ids array<long>"


def _cut_out(min_run: int):
    @F.pandas_udf(_RESULT)
    def cut_out(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, chunks_ in zip(texts, found):
            raw = text.encode()
            spans = _runs(raw, chunks_, min_run) if chunks_ is not None else []
            kept, at = [], 0
            for a, b, _ in spans:
                kept.append(raw[at:a])
                at = b
            rows.append((b"".join([*kept, raw[at:]]).decode(), len(raw), sum(b - a for a, b, _ in spans),
                         [{"start": a, "length": b - a} for a, b, _ in spans],
                         sorted({o for _, _, origin in spans for o in origin if o != _LAST})))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "spans", "origin_doc_ids"])

    return cut_out


def with_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_CHUNK,
             min_run: int = MIN_RUN, out: str = "cut") -> DataFrame:
    """``docs`` with a struct column ``out``: the text without its repeated passages, sizes, spans and origins."""
    p = "__hourglass_"
    doc, tag, text = _keys(docs, id_col, text_col)
    found = (duplicates(docs, id_col, text_col, mean).groupBy(F.col("doc").alias(p + "doc"), F.col("tag").alias(p + "tag"))
             .agg(F.collect_list(F.struct("start", "length", "first_doc")).alias(p + "found")))
    keyed = docs.withColumns({p + "doc": doc, p + "tag": tag})
    joined = keyed.join(found, [p + "doc", p + "tag"], "left")
    return joined.withColumn(out, _cut_out(min_run)(text, F.col(p + "found"))).select(*[F.col(f"`{c}`") for c in docs.columns], out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_CHUNK, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, spans, origin_doc_ids``: every document, without its repeated
    passages; ``origin_doc_ids`` are the documents that keep them."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    c = F.col("cut")
    return with_cut(rows, "doc_id", "text", mean, min_run).select(
        "doc_id", c["kept"].alias("text"), c["n_bytes"].alias("n_bytes"), c["n_removed"].alias("n_removed"),
        F.size(c["spans"]).cast("long").alias("n_spans"), c["spans"].alias("spans"), c["origin_doc_ids"].alias("origin_doc_ids"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                    mean: int = MEAN_CHUNK, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text_col``; ``chars_col`` follows, other columns stay."""
    kept = F.col("__hourglass_cut")["kept"]
    new = {text_col: kept.alias(text_col), chars_col: F.char_length(kept).cast("long").alias(chars_col)}
    rows = with_cut(docs, id_col, text_col, mean, min_run, "__hourglass_cut")
    return rows.select(*[new[c] if c in new else F.col(f"`{c}`") for c in docs.columns])
