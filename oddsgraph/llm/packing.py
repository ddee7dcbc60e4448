"""Packing documents into sequences by the sum-of-squares rule.

With N(g) open sequences that have g places left, a piece goes where the sum of all
N(g)^2 becomes smallest; a new one is opened only where none has room. That keeps the gaps
varied, so later (shorter) pieces find one that fits exactly. Pieces are dealt at random
into groups of bounded size, each packed on its own; what a group leaves open is packed
again, as if each open sequence were one piece, among the leavings of many groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, over_slices, read_documents, texts
from oddsgraph.llm.tokens import AT_ONCE_BYTES, byte_bpe, encoder

CAPACITY = 1024
GROUP = 50_000
"""Pieces a task packs together, on average."""
_NEVER = np.iinfo(np.int64).max
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


class SumOfSquares:
    """Open sequences by gap; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        capacity, counts = self.capacity, self.counts
        # Change of the sum: leaving gap g takes 2N(g) - 1 away, reaching gap r adds 2N(r) + 1; gap 0 is closed.
        reached = 2 * counts[: capacity + 1 - size] + 1
        reached[0] = 0
        change = reached.copy()
        change[: capacity - size] += 1 - 2 * counts[size:capacity]
        full = counts[size:capacity] == 0
        change[: capacity - size][full] = _NEVER
        if not full.all():
            change[capacity - size] = _NEVER
        left = int(change.argmin())  # on a tie the tighter place
        gap = left + size
        if gap == capacity:
            sequence = len(self.used)
            self.used.append(0)
        else:
            sequence = self.open[gap].pop()
            counts[gap] -= 1
        offset = self.used[sequence]
        self.used[sequence] = offset + size
        if left:
            self.open[left].append(sequence)
            counts[left] += 1
        return sequence, offset


def _packed(capacity: int, names: list[str], schema: pa.Schema):
    """For mapInArrow over one group: adds sequence (unique over groups), offset and fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in names]])
        packer, base = SumOfSquares(capacity), TaskContext.get().partitionId() << 32
        spots = [packer.place(n) for n in table.column("length").to_pylist()]
        sequence = np.array([s for s, _ in spots], np.int64)
        table = table.append_column("sequence", pa.array(sequence + base))
        table = table.append_column("offset", pa.array([o for _, o in spots], pa.int64()))
        table = table.append_column("fill", pa.array(np.array(packer.used, np.int64)[sequence]))
        yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=10_000)

    return run


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    n = max(1, -(-rows.count() // GROUP))
    return rows.repartition(n, F.xxhash64(*keys))


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``keys`` and length, 1 to ``capacity``) with sequence_id and offset.

    ``keys`` name a piece; ties are broken by them, repeated rows are separate pieces.
    No sequence is overfull, offsets have no gaps and every row comes out once.
    """
    types = dict(pieces.dtypes)
    columns = [*keys, "length"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    first = pa.schema([*[(c, arrow[types[c]]) for c in columns], ("sequence", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
    ddl = ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence long, offset long, fill long"
    once = cut(_groups(pieces.select(*columns), *keys).mapInArrow(_packed(capacity, keys, first), ddl))
    loose = once.where((F.col("offset") == 0) & (F.col("fill") < capacity)).select("sequence", F.col("fill").alias("length"))
    loose = loose.withColumnRenamed("sequence", "inner")
    second = pa.schema([("inner", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])
    again = _groups(cut(loose), "inner").mapInArrow(_packed(capacity, ["inner"], second), "inner long, sequence long, offset long")
    again = again.select("inner", (F.col("sequence") + F.lit(1 << 60)).alias("outer"), F.col("offset").alias("base"))
    placed = once.join(again, once["sequence"] == again["inner"], "left")
    return placed.select(
        *columns,
        F.coalesce("outer", "sequence").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only where longer than a sequence.

    The first piece takes what the whole ones leave, so that only it can be shorter.
    """

    def run(ids: list[int], bodies: list[str]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in _PIECES.names}
        end = int(end_id).to_bytes(4, "little")
        for doc_id, got in zip(ids, encoder(tokenizer).encode(bodies), strict=True):
            data = got + end
            n = len(data) // 4
            stops = range((n - 1) % capacity + 1, n + 1, capacity)
            start = 0
            for k, stop in enumerate(stops):
                for name, value in zip(_PIECES.names, (doc_id, k, start, stop - start, zlib.crc32(data[start * 4 : stop * 4])), strict=True):
                    out[name].append(value)
                start = stop
        return out

    return texts(docs).mapInArrow(over_slices(run, _PIECES, AT_ONCE_BYTES), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null and empty texts are the end id alone; an empty table gives no rows.
    """
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    placed = pack(cut(pieces(docs, tokenizer, end_id, capacity)), keys, capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), byte_bpe(), end_id=2)
