"""Token ids in files of fixed-width bits.

A shard holds consecutive documents. Layout, all little-endian:

- head, 32 bytes: magic, bits per id, ids per block;
- blocks: ``block`` ids each (the last may be shorter), every id in the fewest bits that
  hold the vocabulary, lowest bit first, each block from a whole byte on;
- tail: doc_ids (int64), one byte each that says whether the doc_id is there, starts of
  the documents counted in ids (n + 1 int64), byte offsets of the blocks (int64);
- foot, 40 bytes: place of the tail, documents, ids, blocks, magic.

Any range of ids is read by seeking to its blocks and unpacking them as whole arrays.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, file_system, read_documents, slices, texts, utf8
from oddsgraph.llm.tokens import AT_ONCE_BYTES, byte_bpe, encoder
from oddsgraph.session import checkpoint_folder

MAGIC = b"FIXBITS1"
BLOCK = 1 << 16
READ_IDS = 1 << 20
_HEAD = struct.Struct("<8sIIxxxxxxxxxxxxxxxx")
_FOOT = struct.Struct("<qqqq8s")
_MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits == 16:  # the same layout, without going through single bits
        return ids.astype("<u2").tobytes()
    single = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(single.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    single = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = single
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Writes one shard as documents come; holds one block and a few numbers for each document."""

    def __init__(self, path: str, bits: int, block: int = BLOCK) -> None:
        store, inner = file_system(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(inner)
        self.bits, self.block = bits, block
        self.out.write(_HEAD.pack(MAGIC, bits, block))
        self.place, self.n_ids = _HEAD.size, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.docs: list[int | None] = []
        self.starts, self.offsets = [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(self.n_waiting // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for at in range(0, n, self.block):
            data = pack(ids[at : min(n, at + self.block)], self.bits)
            self.offsets.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(bytes(d is not None for d in self.docs))
        self.out.write(np.array(self.starts, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(_FOOT.pack(self.place, len(self.docs), self.n_ids, len(self.offsets), MAGIC))
        self.out.close()


class Shard:
    """A written shard: its documents, and any range of its ids."""

    def __init__(self, path: str) -> None:
        store, inner = file_system(path)
        self.file = store.open_input_file(inner)
        magic, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        size = self.file.size()
        tail, docs, self.n_ids, blocks, end = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        rest = self.file.read_at(size - _FOOT.size - tail, tail)
        self.doc_ids = np.frombuffer(rest, "<i8", docs)
        self.named = np.frombuffer(rest, np.uint8, docs, docs * 8).astype(bool)
        self.starts = np.frombuffer(rest, "<i8", docs + 1, docs * 9)
        self.offsets = np.append(np.frombuffer(rest, "<i8", blocks, docs * 9 + (docs + 1) * 8), tail)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        place = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - place, place)
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            a = int(self.offsets[k]) - place
            parts.append(unpack(data[a : a + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, most: int = READ_IDS) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, read ``most`` ids at a time; longer ones alone."""
        for a, b in slices(self.starts, most):
            base = int(self.starts[a])
            ids = self.ids(base, int(self.starts[b]))
            for k in range(a, b):
                start, stop = int(self.starts[k]), int(self.starts[k + 1])
                yield int(self.doc_ids[k]) if self.named[k] else None, start, ids[start - base : stop - base]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Write all documents in ascending doc_id order, a shard for each range of ids; the manifest is returned.

    Null doc_ids come first; rows with one doc_id stay beside each other, ordered by their
    text's hash. The manifest (shard, file, n_docs, n_ids) lists the file of the one attempt
    of each task that was committed; files of lost attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        path, writer = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bits", None
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(utf8(column)[1], AT_ONCE_BYTES):
                for doc_id, got in zip(ids.slice(a, b - a).to_pylist(), codec.encode(column.slice(a, b - a).to_pylist()), strict=True):
                    writer = writer or ShardWriter(path, width(codec.vocabulary), block)
                    writer.add(doc_id, np.append(np.frombuffer(got, "<u4"), np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}, schema=_MANIFEST
            )

    keys = ["doc_id", F.xxhash64("text")]
    ordered = texts(docs).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {name: [] for name in _READ.names}
                for doc_id, start, ids in Shard(row["file"]).documents():
                    for name, value in zip(_READ.names, (doc_id, row["shard"], start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_READ)

    # One row for each shard: the running count stays small whatever the corpus.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    spread = manifest.select("shard", "file").repartitionByRange(max(1, manifest.count()), "shard")
    found = spread.mapInArrow(run, "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op1_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/bits-{uuid.uuid4().hex}"
    return read_shards(write_shards(read_documents(spark, sf_dir), folder, byte_bpe(), end_id=0))
