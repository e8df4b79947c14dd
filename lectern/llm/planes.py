"""Token-id files with bit-plane shuffling.

File format (little endian):

    "LTP1"                                   magic
    chunk*                                   zstandard frames, one per plane
    index                                    JSON: dtype bits, block, chunks, docs frame
    index length (u32) "LTP1"

Ids are cut into blocks of ``block`` ids (the last may be shorter, its planes
padded with zero bits).  A block is transposed into planes: plane *b* holds
bit *b* of every id (``bits`` layout) or byte *b* (``bytes`` layout).  Planes
that are all zero take no room.  Each plane is one zstandard frame; the index
has, for each chunk, its offset, its number of ids and the sizes of its
planes, so any range of ids can be read without the rest.  The ``docs`` frame
holds (doc_id, null flag, number of ids) of the file's documents in order.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import scratch_path
from .common import arrow_schema, open_fs, ranged, shuffle_parts, write_file, written
from .tokenizing import encoder, text_batches

MAGIC = b"LTP1"
BLOCK = 1 << 16
END_ID = 1


def to_planes(ids: np.ndarray, width: int, layout: str) -> list[bytes]:
    """The planes of one block of unsigned ids below ``2 ** width``."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if layout == "bytes":
        return [raw[:, b].tobytes() for b in range((width + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=width)
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(width)]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if layout == "bytes":
        for b, p in enumerate(planes):
            out[:, b] = np.frombuffer(p, np.uint8)
        return out.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), np.uint8)
    for b, p in enumerate(planes):
        if p:
            bits[:, b] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Streams a file: ``add`` documents, iterate ``flush`` for bytes to write."""

    def __init__(self, width: int, layout: str = "bits", block: int = BLOCK, level: int = 1):
        import zstandard

        self.width, self.layout, self.block = width, layout, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.chunks: list[list] = []
        self.docs: list[tuple[int, int, int]] = []
        self.at = len(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents and their ids, in a row."""
        self.docs += [(doc or 0, doc is None, n) for doc, n in zip(doc_ids, counts.tolist(), strict=True)]
        self.held.append(ids)
        self.n_held += len(ids)

    def flush(self, last: bool = False):
        """Whole blocks, and with ``last`` the rest, the index and the end."""
        if self.n_held >= self.block or last:
            ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
            whole = len(ids) if last else len(ids) - len(ids) % self.block
            for lo in range(0, whole, self.block):
                part = ids[lo : min(lo + self.block, whole)]
                packed = [self.packer.compress(p) if any(p) else b"" for p in to_planes(part, self.width, self.layout)]
                self.chunks.append([self.at, len(part), [len(p) for p in packed]])
                self.at += sum(map(len, packed))
                yield b"".join(packed)
            self.held, self.n_held = [ids[whole:]], len(ids) - whole
        if last:
            docs = np.array([(d, int(null), n) for d, null, n in self.docs], "<i8").reshape(-1, 3).tobytes()
            frame = self.packer.compress(docs)
            index = {"width": self.width, "layout": self.layout, "block": self.block, "chunks": self.chunks}
            index |= {"docs": [self.at, len(frame)]}
            tail = json.dumps(index).encode()
            yield frame + tail + struct.pack("<I", len(tail)) + MAGIC


def read_index(f, size: int) -> dict:
    f.seek(size - 8)
    n, magic = struct.unpack("<I4s", f.read(8))
    if magic != MAGIC:
        raise ValueError("not a plane file")
    f.seek(size - 8 - n)
    return json.loads(f.read(n))


def read_chunk(f, index: dict, k: int) -> np.ndarray:
    import zstandard

    at, n, sizes = index["chunks"][k]
    f.seek(at)
    raw, planes, lo = f.read(sum(sizes)), [], 0
    unpack = zstandard.ZstdDecompressor()
    empty = bytes(n) if index["layout"] == "bytes" else b""
    for s in sizes:
        planes.append(unpack.decompress(raw[lo : lo + s]) if s else empty)
        lo += s
    return from_planes(planes, n, index["layout"])


def read_docs(f, index: dict) -> np.ndarray:
    import zstandard

    at, n = index["docs"]
    f.seek(at)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(n)), "<i8").reshape(-1, 3)


FILES_SCHEMA = "part int, path string, bytes long, n_docs long, n_ids long"


def write_planes(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, layout: str = "bits") -> DataFrame:
    """Encode ``doc_id, text`` and write plane files under ``path`` (shared).

    Documents lie in ascending doc_id order (null ids first, repeated ids by
    the hash of their text), each file a range of them, the files in order of
    ``part``.  Null and empty texts hold the end id alone.  Returns the list
    of files; the number of files follows the shuffle partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    dealt = ranged(rows, "doc_id", "tie").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        enc = encoder(tokenizer)
        width = max(int(enc.tok.get_vocab_size() - 1).bit_length(), int(end_id).bit_length())
        out = PlaneWriter(width, layout)
        part = TaskContext.get().partitionId()
        uri = f"{path}/part-{part:06d}.ltp"
        n_ids = 0

        def stream():
            nonlocal n_ids
            yield MAGIC
            for batch in batches:
                docs, texts = batch.column(0), batch.column(1)
                for lo, hi in text_batches(texts):
                    ids, counts = enc.ended(texts[lo:hi].to_pylist(), end_id)
                    out.add(docs[lo:hi].to_pylist(), counts, ids)
                    n_ids += len(ids)
                    yield from out.flush()
            yield from out.flush(last=True)

        size = write_file(uri, stream())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": uri, "bytes": size, "n_docs": len(out.docs), "n_ids": n_ids}],
            schema=arrow_schema(FILES_SCHEMA),
        )

    return written(dealt.mapInArrow(write, FILES_SCHEMA), "plane-files").where("n_docs > 0")


DOCS_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_planes(files: DataFrame) -> DataFrame:
    """Documents read back: ``doc_id, start`` (ids of all documents before
    it), ``n_tokens``, ``ids_crc32`` (of its ids as little-endian unsigned
    32-bit integers).  One task a file; a task holds one chunk at a time."""
    # one row a file: the running sum over the list of files is small
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    dealt = listed.repartition(shuffle_parts(files.sparkSession), "part")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(row["path"], row["first"], pa, arrow_schema(DOCS_SCHEMA))

    return dealt.mapInArrow(read, DOCS_SCHEMA)


def _read_file(uri: str, first: int, pa, schema):
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        index = read_index(f, f.size())
        docs = read_docs(f, index)
        crcs = np.zeros(len(docs), np.int64)
        ends = np.cumsum(docs[:, 2])
        doc, at = 0, 0
        for k in range(len(index["chunks"])):
            raw = memoryview(read_chunk(f, index, k).tobytes())
            lo, n = 0, len(raw) // 4
            while lo < n:
                hi = min(n, int(ends[doc]) - at)
                crcs[doc] = zlib.crc32(raw[4 * lo : 4 * hi], int(crcs[doc]))
                lo = hi
                if at + hi == ends[doc] and doc + 1 < len(docs):
                    doc += 1
            at += n
        ids = pa.array(docs[:, 0], mask=docs[:, 1].astype(bool))
        cols = [ids, pa.array(first + ends - docs[:, 2]), pa.array(docs[:, 2]), pa.array(crcs)]
        whole = pa.RecordBatch.from_arrays(cols, schema=schema)
        for lo in range(0, whole.num_rows, 8192):
            yield whole.slice(lo, 8192)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "planes")
    return read_planes(write_planes(docs, tokenizer, path))
