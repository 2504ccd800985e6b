"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

File layout (all integers little-endian):

* data frames: the ids of whole documents, one after another, about ``FRAME_BYTES`` raw bytes a frame;
* one index frame: ``n_docs`` (8 bytes), id width in bytes (8), then arrays of doc_id (int64), has_id (uint8) and
  n_tokens (uint32);
* a skippable frame in the published seekable layout: compressed size, raw size and the low 32 bits of the xxh64
  of the raw bytes for every frame before it, then the frame count, a descriptor byte and a magic number.

Any zstandard reader can read the whole file; :class:`TokenFile` reads the tail, then only the frames it needs, and
checks each frame.  A file is written under a temporary name and moved into place, so a task that is run again
leaves one whole file.

Documents are range-partitioned by id (ties split by the text's hash), so no key gathers in one task; each partition is one
file, and the files in order hold the ids in ascending doc_id order.  Defined results: null ids come first, a null
text reads as empty, a very long text is one frame, repeated rows are kept (rows equal in id and text stay in one file), other columns
are ignored, an empty table makes no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourglass.llm.chunks import text_blocks, worker_coder
from hourglass.llm.common import shared_path, stored, text_rows

FRAME_BYTES = 1 << 18
#: Values of the published seekable layout.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, width: int, level: int = 3):
        import zstandard

        self.out, self.width, self.frames = out, width, []
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held_bytes:
            self._frame(b"".join(self.held))
        self.held, self.held_bytes = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.held.append(raw)
        self.held_bytes += len(raw)
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        if self.held_bytes >= FRAME_BYTES:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._frame(struct.pack("<qq", len(self.ids), self.width)
                    + np.array([x or 0 for x in self.ids], "<i8").tobytes()
                    + np.array([x is not None for x in self.ids], np.uint8).tobytes()
                    + np.array(self.sizes, "<u4").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table
                       + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class TokenFile:
    """Random access to one file: only the tail, the index and the frames asked for are read."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        f.seek(size - 9 - 12 * n)
        table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.at = np.cumsum(self.packed) - self.packed
        index = self.frame(n - 1)
        docs, self.width = struct.unpack_from("<qq", index)
        ids = np.frombuffer(index, "<i8", docs, 16)
        has = np.frombuffer(index, np.uint8, docs, 16 + 8 * docs)
        self.n_tokens = np.frombuffer(index, "<u4", docs, 16 + 9 * docs).astype(np.int64)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.first = np.cumsum(self.n_tokens) - self.n_tokens            # ids before each document
        self.frame_first = np.concatenate([[0], np.cumsum(self.raw[:-1])]) // self.width
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.f.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.packed[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file; its frame is the only one read."""
        if not self.n_tokens[i]:
            return np.zeros(0, "<u4")
        k = int(np.searchsorted(self.frame_first, self.first[i], "right")) - 1
        if self._last[0] != k:
            self._last = (k, self.frame(k))
        at = int(self.first[i] - self.frame_first[k]) * self.width
        return np.frombuffer(self._last[1], f"<u{self.width}", int(self.n_tokens[i]), at).astype("<u4")


def write(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write one file a partition under ``folder``; the manifest has a row for each file."""
    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from tokenizers import Tokenizer

        part, writer, out, n_docs, n_tokens = TaskContext.get().partitionId(), None, None, 0, 0
        fs, root = _file_system(folder)
        name = f"{root}/tokens-{part:08d}.zst"
        draft = f"{root}/_draft-{part:08d}-{uuid.uuid4().hex}"
        for batch in batches:
            coder = worker_coder(path, False)
            for block in text_blocks(batch):
                if writer is None:
                    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(draft, compression=None)
                    writer = TokenWriter(out, 2 if size <= 1 << 16 else 4)
                for doc_id, raw in zip(block.column("doc_id").to_pylist(), coder.encode(block.column("text").to_pylist())):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    writer.add(doc_id, ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/{name.rsplit('/', 1)[1]}", "n_docs": n_docs, "n_tokens": n_tokens}],
                                             pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = (text_rows(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie"))
    return ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back file by file.

    ``start`` counts the ids of all documents before it: the files' totals (a row a file) are summed in file order.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for file, base in zip(frame["file"], frame["base"]):
                fs, name = _file_system(file)
                with fs.open_input_file(name) as f:
                    t = TokenFile(f, f.size())
                    for i in range(0, len(t.doc_ids), 20_000):
                        k = range(i, min(i + 20_000, len(t.doc_ids)))
                        yield pd.DataFrame({
                            "doc_id": pd.array([t.doc_ids[j] for j in k], "Int64"), "start": t.first[k.start:k.stop] + base,
                            "n_tokens": t.n_tokens[k.start:k.stop],
                            "ids_crc32": np.fromiter((zlib.crc32(t.document(j).tobytes()) for j in k), np.int64, len(k))})

    n = max(1, manifest.count())
    return files.repartition(n, "part").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = shared_path(spark, "token-files")
    return read(stored(write(docs, path, folder, end_id), "token-manifest"))
