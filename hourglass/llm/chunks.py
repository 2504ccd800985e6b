"""Whole-text encoding by remembered chunks.

A text is cut where no pre-token can cross, each distinct chunk is encoded once, and the ids of a text are its
chunks' ids in order.  Frequent chunks stay in a bounded table for the life of a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the tokenizers' own patterns read ``\s`` (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
_TWO_WHITE = re.compile(f"[{WHITE}][{WHITE}]")
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

_MARK = "\x1f"            # cuts chunks; a text that holds it is cut by pattern

REMEMBERED = 600_000      # chunks kept between blocks
LONGEST_KEPT = 48         # longer chunks are encoded again


class ChunkCoder:
    """Texts to little-endian unsigned 32-bit ids.  ``encode_many`` maps distinct chunks to their ids' bytes.

    ``words=True``: white space is dropped by the tokenizer, so spaces and newlines only separate chunks.
    ``words=False``: a chunk is white space and the non-space run after it; a byte-level pre-token never
    goes on from a non-space character to white space, so that cut is exact.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], words: bool, remembered: int = REMEMBERED):
        self.encode_many, self.words, self.remembered, self.known = encode_many, words, remembered, {"": b""}

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """The chunks of each text.  With one white-space character at most between runs, cutting before each space
        and newline is enough; other texts are cut by pattern."""
        if self.words:
            return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        odd = {i for i, x in enumerate(texts) if _MARK in x or _TWO_WHITE.search(x)}
        plain = pa.array(["" if i in odd else x for i, x in enumerate(texts)] if odd else texts, pa.string())
        for white in " \n":
            plain = pc.replace_substring(plain, white, _MARK + white)
        cut = pc.split_pattern(plain, _MARK)
        if not odd:
            return cut
        order = np.arange(len(texts))
        found = sorted(odd)
        order[found] = len(texts) + np.arange(len(found))
        return pa.concat_arrays([cut, pa.array([_CHUNK.findall(texts[i]) for i in found], pa.list_(pa.string()))]).take(pa.array(order))

    def _learn(self, new: list[str]) -> list[str]:
        """Encode the distinct chunks of ``new``; returns all that the table got.

        A letter and a full stop or comma after it are never in one pre-token: such a chunk is its stem and its tail.
        """
        known, parts = self.known, []
        for w in new:
            stem = w.rstrip(".,")
            if stem != w and stem[-1:].lower().isalpha():     # some letters end in a mark when lowered
                parts.append((w, stem, w[len(stem):]))
        whole = {w for w, _, _ in parts}
        plain = dict.fromkeys(w for w in new if w not in whole)
        plain.update((x, None) for p in parts for x in p[1:] if x not in known)
        plain = list(plain)
        for i in range(0, len(plain), 50_000):
            known.update(zip(plain[i:i + 50_000], self.encode_many(plain[i:i + 50_000])))
        known.update((w, known[stem] + known[tail]) for w, stem, tail in parts)
        return [*plain, *whole]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        known, cut = self.known, self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        del cut
        chunks = coded.dictionary.to_pylist()
        new = [w for w in chunks if w not in known]
        got = self._learn(new) if new else []
        # the data of this array is the ids of all texts, one after another
        ids = pa.array([known[w] for w in chunks], pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] is not None else memoryview(b"")
        ends = ends[at].tolist()
        out = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
        over = len(known) - self.remembered
        for w in got[len(got) - over:] if over > 0 else ():
            known.pop(w, None)
        for w in got:
            if len(w) > LONGEST_KEPT:
                known.pop(w, None)
        return out


def library_coder(path: str, words: bool) -> ChunkCoder:
    """A coder over the tokenizers library; special strings inside a text get their special ids, as by default."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = sorted((t.content for t in tok.get_added_tokens_decoder().values() if t.special))

    def plain(chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_many(chunks: list[str]) -> list[bytes]:
        """Many chunks in one call, with a special string between them: the library never merges across it."""
        if not special:
            return plain(chunks)
        sep, sep_id = special[0], tok.token_to_id(special[0])
        out: list[bytes] = []
        for i in range(0, len(chunks), 20_000):
            part = chunks[i:i + 20_000]
            odd = [j for j, c in enumerate(part) if sep in c]
            for j, ids in zip(odd, plain([part[j] for j in odd])):
                part[j] = ids
            rest = [j for j, c in enumerate(part) if isinstance(c, str)]
            joined = [sep.join(part[j] for j in rest[k:k + 400]) + sep for k in range(0, len(rest), 400)]
            for k, e in enumerate(tok.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                raw, ends = ids.tobytes(), np.flatnonzero(ids == sep_id).tolist()
                at = 0
                for j, end in zip(rest[k * 400:], ends):
                    part[j] = raw[at * 4:end * 4]
                    at = end + 1
            out += part
        return out

    return ChunkCoder(encode_many, words)


_CODERS: dict[tuple, ChunkCoder] = {}


def worker_coder(path: str, words: bool, make=library_coder) -> ChunkCoder:
    """The coder of this Python worker for ``path``."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # one core a task
    key = (path, words, make.__name__)
    if key not in _CODERS:
        _CODERS[key] = make(path, words)
    return _CODERS[key]


def text_blocks(batch: pa.RecordBatch, text_col: str = "text", size: int = 16_000_000):
    """Row slices of an Arrow batch holding about ``size`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // size
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(i, j - i)
