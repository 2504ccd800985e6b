"""Byte-level BPE encoding by a pair occurrence index, and decoding.

Within a task, the distinct pre-tokens of a block of texts lie in one symbol array.  An index maps each mergeable
pair (by its merge rank) to all its positions; a heap gives the active ranks in ascending order.  Merging a rank
rewrites all its positions and adds the pairs that appear to their lists.  Ranks taken in ascending order over the
whole block give every pre-token the same merges as the usual loop on it alone.

Rows are mapped in place: no shuffle, so hot sources and copies make no difference.  Defined results: null and empty
texts have no ids and decode to the empty text; very long texts are encoded whole; repeated rows are repeated; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.chunks import REMEMBERED, WHITE, ChunkCoder, text_blocks, worker_coder
from hourglass.llm.common import text_rows

#: The published pre-token pattern of this vocabulary, white space spelled out (fixed values).
PRETOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
            rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BLOCK_BYTES = 500_000    # symbols indexed at a time


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = [ids[a] for a, _ in merges]
        self.right = [ids[b] for _, b in merges]
        self.made = [ids[a + b] for a, b in merges]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(zip(self.left, self.right)):
            self.rank.setdefault(a << 32 | b, r)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        first = self.of_byte.tolist()
        self.byte_rank = np.array([[self.rank.get(a << 32 | b, -1) for b in first] for a in first], np.int32)


def merge_all(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids (little-endian, 32 bits) of each pre-token, through one pair occurrence index over all of them."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    n = len(raw)
    nxt_np = np.arange(1, n + 1, dtype=np.int32)
    nxt_np[end[size > 0] - 1] = -1
    prv_np = np.arange(-1, n - 1, dtype=np.int32)
    prv_np[(end - size)[size > 0]] = -1
    inner = np.flatnonzero(nxt_np >= 0)
    rank0 = v.byte_rank[raw[inner], raw[inner + 1]]
    inner, rank0 = inner[rank0 >= 0], rank0[rank0 >= 0]
    order = np.argsort(rank0, kind="stable")
    ranks, starts = np.unique(rank0[order], return_index=True)
    index = {int(r): p.tolist() for r, p in zip(ranks, np.split(inner[order], starts[1:]))}
    sym, nxt, prv = (array("i", x.astype(np.int32).tobytes()) for x in (v.of_byte[raw], nxt_np, prv_np))
    heap = list(index)
    heapq.heapify(heap)
    rank_of, left, right, made = v.rank.get, v.left, v.right, v.made
    while heap:
        r = heapq.heappop(heap)
        a, b, c = left[r], right[r], made[r]
        for p in sorted(index.pop(r)):            # left to right: overlapping pairs of one symbol
            q = nxt[p]
            if sym[p] != a or q < 0 or sym[q] != b:
                continue                          # an earlier merge used it
            sym[p], sym[q] = c, -1
            after = nxt[p] = nxt[q]
            if after >= 0:
                prv[after] = p
                s = rank_of(c << 32 | sym[after])
                if s is not None:
                    if s in index:
                        index[s].append(p)
                    else:
                        index[s] = [p]
                        heapq.heappush(heap, s)
            before = prv[p]
            if before >= 0:
                s = rank_of(sym[before] << 32 | c)
                if s is not None:
                    if s in index:
                        index[s].append(before)
                    else:
                        index[s] = [before]
                        heapq.heappush(heap, s)
    done = np.frombuffer(sym, np.int32)
    live = done >= 0
    upto = np.concatenate([[0], np.cumsum(live)])
    flat = done[live].astype("<u4").tobytes()
    return [flat[4 * i:4 * j] for i, j in zip(upto[end - size].tolist(), upto[end].tolist())]


def index_coder(path: str, words: bool) -> ChunkCoder:
    """A chunk coder whose chunks are cut into pre-tokens and merged through :func:`merge_all`."""
    import regex

    v = Vocabulary(path)
    find = regex.compile(PRETOKEN).findall
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def encode_many(chunks: list[str]) -> list[bytes]:
        cut, ids = [], {t: np.array([i], "<u4").tobytes() for t, i in v.special.items()}
        for c in chunks:
            if special is not None and special.search(c):
                cut.append([y for x in special.split(c) if x for y in ([x] if x in v.special else find(x))])
            else:
                cut.append(find(c))
        new = list(dict.fromkeys(x for c in cut for x in c if x not in ids))
        raw = [x.encode() for x in new]
        size = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        bounds = np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + BLOCK_BYTES, BLOCK_BYTES)).tolist()
        for i, j in zip(bounds, [*bounds[1:], len(raw)]):
            if j > i:
                ids.update(zip(new[i:j], merge_all(raw[i:j], v)))
        return [b"".join(ids[x] for x in c) for c in cut]

    return ChunkCoder(encode_many, words, REMEMBERED // 2)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of every whole text as little-endian unsigned 32-bit integers."""
    def run(batches):
        import pyarrow as pa

        coder = worker_coder(path, False, index_coder)
        for batch in batches:
            for part in text_blocks(batch, size=4_000_000):
                ids = coder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


_VOCABULARY: dict[str, Vocabulary] = {}


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text`` from what :func:`encode` returns (special ids are kept as their strings)."""
    def run(batches):
        import pyarrow as pa

        if path not in _VOCABULARY:
            _VOCABULARY[path] = Vocabulary(path)
        of = _VOCABULARY[path].bytes.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [b"".join(map(of, np.frombuffer(x, "<u4").tolist())).decode(errors="replace")
                         for x in part.column("ids").to_pylist()]
                yield part.append_column("text", pa.array(texts, pa.string()))

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                          F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("decoded_sha256"))
