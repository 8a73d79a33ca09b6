"""Token-id files with shuffled planes.

A shard holds the ids of the documents of one range of ids, in ascending order. Ids are cut into blocks of a
fixed size; a block is transposed into byte planes (or bit planes), each plane is compressed with zstandard, and
an index at the end of the file says where each block begins and how long its planes are, so any block can be
read alone. Layout (little-endian)::

    magic "DLPLANE1"
    planes of block 0, planes of block 1, ...
    zstandard-compressed JSON index: plane kind, block size, blocks [offset, ids, [plane bytes, ...]]
    zstandard-compressed document table: int64 doc_id, int64 tokens, one after the other
    int64 index offset, int64 index bytes, int64 table bytes, magic
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import NO_ID, id_key, new_folder, stage
from ._tokens import encoded

MAGIC = b"DLPLANE1"
BLOCK = 65_536


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of one block, lowest first, without those above the largest id."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 0
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(used)]
    bits = np.unpackbits(raw[:, :used], axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class ShardWriter:
    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 1):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held = out.write(MAGIC) or len(MAGIC), [], 0
        self.at, self.blocks, self.docs, self.n_ids = len(MAGIC), [], [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs += (doc_id, len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            data = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(data) // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(data[k : k + self.block])
            self.held, self.n_held = [data[whole:].tobytes()], len(data) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._put(np.frombuffer(b"".join(self.held), "<u4"))
        index = self.zip.compress(json.dumps({"planes": self.kind, "block": self.block, "blocks": self.blocks}).encode())
        table = self.zip.compress(np.array(self.docs, "<i8").tobytes())
        self.out.write(index + table + struct.pack("<qqq", self.at, len(index), len(table)) + MAGIC)


class ShardReader:
    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - 24 - len(MAGIC))
        tail = source.read(24 + len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        at, n_index, n_table = struct.unpack("<qqq", tail[:24])
        source.seek(at)
        self.index = json.loads(self.unzip.decompress(source.read(n_index)))
        table = np.frombuffer(self.unzip.decompress(source.read(n_table)), "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = table[:, 0], table[:, 1]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][k]
        self.source.seek(at)
        return from_planes([self.unzip.decompress(self.source.read(s)) for s in sizes], n, self.index["planes"])

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order; holds a document and a block at a time."""
        rest, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, rest[:n]
            rest = rest[n:]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, planes: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encodes every text and writes plane files under ``folder``; returns the manifest
    (shard int, path string, n_docs long, n_ids long, start long): one row per file, in ascending order of doc_id,
    ``start`` being the ids in all files before it.

    Documents are dealt by ranges of doc_id and sorted within a range; a file is written under an attempt's own
    name and then renamed, so a task that runs again leaves one whole file. NULL text is empty; a row without
    doc_id comes first; rows that repeat a doc_id are each written, in the order of their texts' hashes; an empty
    table gives an empty manifest."""

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        path, own = f"shard-{shard:06d}.plane", f"{base}/.{shard}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            w = ShardWriter(out, planes, block)
            while first is not None:
                for doc_id, ids in zip(first.column(0).to_pylist(), encoded(tokenizer_path, first.column(1).to_pylist(), end_id), strict=True):
                    w.add(doc_id, ids)
                first = next(batches, None)
            w.close()
        store.move(own, f"{base}/{path}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(w.docs) // 2], "n_ids": [w.n_ids]})

    rows = docs.select(id_key(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stage(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-manifest")
    # A row per file, not per document.
    found, start, out = sorted(manifest.collect()), 0, []
    for r in found:
        out.append((r.shard, r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return docs.sparkSession.createDataFrame(out, "shard int, path string, n_docs long, n_ids long, start long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, an array of int)."""

    def read(batches):
        store, base = _store(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as source:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, ids in ShardReader(source).documents():
                        raw = np.ascontiguousarray(ids, "<u4")
                        rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(raw.tobytes()), raw.astype(np.int32) if with_ids else None))
                        start += len(ids)
                        held += len(ids) if with_ids else 1
                        if held >= 500_000 or len(rows) >= 20_000:
                            yield _batch(rows, with_ids)
                            rows, held = [], 0
                    yield _batch(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = manifest.select("path", "start")
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
    data = {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols, strict=False)}
    if with_ids:
        data["ids"] = pa.array(list(cols[4]), pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(data)


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files and reads them back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, folder, tokenizer_path, **options))
