"""Blocks: documents dealt by hash, packed once, and asked about in sorted key batches.

Three operators share one shape of job:

1. ``pack`` deals documents to ``n`` blocks by a hash of id and text and moves each
   text once, compressed, to its block.
2. A block sends every shard one row: its distinct keys for that shard, sorted
   and delta coded (so a hot key crosses the network once per block, not once
   per occurrence).
3. A shard answers with one row per block, and ``answer`` brings these rows back
   to the block's texts.

All per-task memory is bounded by a block or a shard, both of which shrink as
``spark.sql.shuffle.partitions`` grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
PACKED = "block int, payload binary"


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack(docs: DataFrame, columns: list[str], n: int, block: Column | None = None) -> DataFrame:
    """Rows ``(block, payload)``: Arrow tables of ``columns``, dealt to ``n`` blocks by a hash of them all (or as ``block`` says).

    So rows without an id, or with one id, are dealt by their texts; only equal rows meet.
    """
    block = F.pmod(F.xxhash64(*columns), F.lit(n)) if block is None else block
    dealt = docs.select(block.cast("int").alias("_block"), *columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("_block").combine_chunks()
            block = table["_block"].to_numpy()
            ids, starts = np.unique(block, return_index=True)
            ends = [*starts[1:], len(block)]
            rows = table.drop_columns(["_block"])
            payloads = [_ipc(rows.slice(s, e - s)) for s, e in zip(starts, ends)]
            return pa.record_batch([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= BATCH_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return dealt.mapInArrow(packed, PACKED).repartition(n, "block")


def pieces(table: pa.Table) -> Iterator[pa.Table]:
    """Row ranges of about ``CHUNK_BYTES`` of text (a longer text comes alone)."""
    sizes = np.zeros(table.num_rows, np.int64)
    for name in table.column_names:
        if pa.types.is_string(table[name].type):
            sizes += pc.fill_null(pc.binary_length(table[name]), 0).to_numpy().astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > CHUNK_BYTES:
            yield table.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < table.num_rows:
        yield table.slice(start)


def documents(payloads: list[bytes]) -> Iterator[pa.Table]:
    """The documents of a block, in pieces."""
    for payload in payloads:
        yield from pieces(unpack(payload))


def per_block(packed: DataFrame, fn: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn(block, payloads)`` for every block of a dealt frame, without another shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(block, []).append(payload)
        for block in sorted(held):
            yield from fn(block, held.pop(block))

    return packed.mapInArrow(run, schema)


def answer(packed: DataFrame, replies: DataFrame, fn: Callable[[int, list[bytes], pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(block, payloads, replies)`` where ``replies`` has a column ``block``; every block is visited."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(key[0].as_py(), left["payload"].to_pylist(), right)

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


_ENCODER_LEVEL = 1


def encode(values: np.ndarray) -> bytes:
    """A fixed-width array as zstd over its byte planes (high planes of small numbers vanish)."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=_ENCODER_LEVEL).compress(np.ascontiguousarray(raw.T).tobytes())


def decode(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values, as deltas."""
    return encode(np.diff(values, prepend=values.dtype.type(0)))


def decode_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(decode(blob, dtype), dtype=dtype)


def by_shard(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each non-empty shard in an ascending shard array: ids and edges."""
    edges = np.searchsorted(shard, np.arange(n + 1))
    return np.flatnonzero(np.diff(edges)), edges


class Lookup:
    """A sorted array of evenly spread 64-bit hashes with a directory on their leading bits."""

    def __init__(self, ordered: np.ndarray) -> None:
        bits = max(1, int(len(ordered)).bit_length())
        self.ordered = np.append(ordered, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.shift = np.uint64(64 - bits)
        self.head = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.size = len(ordered)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each value (of the next larger one if it is not there), and whether it is there."""
        at = self.head[(values >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.ordered[at] < values)
        while len(behind):
            at[behind] += 1
            behind = behind[self.ordered[at[behind]] < values[behind]]
        there = (self.ordered[at] == values) & (at < self.size)
        return np.minimum(at, max(0, self.size - 1)), there
