"""Exact duplicates by two passes over Bloom filters.

Pass 1 takes 64-bit hashes only.  Each task makes its own distinct (a hot text is
one hash a task) and deals them to shards by their leading bits.  A shard streams
its hashes through a filter of what it has seen; a hash that meets itself there is
possibly repeated and goes into the shard's second filter, sized by what it holds.
Pass 2 tests every row against the second filters: a row that is not in them has no
equal and passes straight through; only the others shuffle, and are compared by the
SHA-256 of their whole normalised texts.

The second filters of all shards together never exceed ``FILTER_BYTES``, which is
what makes them fit to be broadcast.  With more repeated texts than fit, filters grow
fuller and let more unrepeated rows into the shuffle; they never lose a repeated one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm import runtime

#: Bound of the filters that are broadcast, over all shards.
FILTER_BYTES = 64 << 20
BITS_A_KEY = 16
MAX_PROBES = 4
HOT = 1000
_FLUSH = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column | str) -> Column:
    """SHA-256 (binary) of a text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), 256))


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _places(h: np.ndarray, bits, probe: int) -> np.ndarray:
    """Bit of one probe in a filter of ``bits`` bits (one number, or one a hash)."""
    step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (h + np.uint64(probe) * (step ^ (step >> np.uint64(29)))) % bits


def _fill(cells: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(cells, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))


def _test(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Seen:
    """The filter of the first pass: what a shard has met so far."""

    def __init__(self, keys: int) -> None:
        self.bits = np.uint64(max(64, BITS_A_KEY * keys))
        self.cells = np.zeros(int(self.bits) // 8 + 1, np.uint8)

    def again(self, h: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes may have been met before; then they have been."""
        met = np.ones(len(h), bool)
        for probe in range(MAX_PROBES):
            at = _places(h, self.bits, probe)
            met &= _test(self.cells, at)
        for probe in range(MAX_PROBES):
            _fill(self.cells, _places(h, self.bits, probe))
        return met


class Found:
    """A set of hashes that grows: sorted whenever it has doubled."""

    def __init__(self) -> None:
        self.held, self.new, self.size = np.zeros(0, np.uint64), [], 0

    def add(self, h: np.ndarray) -> None:
        self.new.append(h)
        self.size += len(h)
        if self.size > max(_FLUSH, len(self.held)):
            self.distinct()

    def distinct(self) -> np.ndarray:
        self.held, self.new, self.size = np.unique(np.concatenate([self.held, *self.new])), [], 0
        return self.held


def _own_distinct(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(_shard(h, n).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(times > 1)], ["shard", "h", "twice"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= _FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _repeated_of(n: int, keys: int, cap_bits: int):
    """Streams a shard; gives its second filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Seen] = {}
        found: dict[int, Found] = {}
        for batch in batches:
            shards, hashes, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s in np.unique(shards).tolist():
                mine = shards == s
                h, back = np.unique(hashes[mine].view(np.uint64), return_inverse=True)
                more = np.bincount(back, minlength=len(h)) > 1
                more[back[twice[mine]]] = True
                more |= seen.setdefault(s, Seen(keys)).again(h)
                if more.any():
                    found.setdefault(s, Found()).add(h[more])
        for s in found:
            h = found[s].distinct()
            bits = np.uint64(min(max(64, BITS_A_KEY * len(h)), cap_bits))
            probes = int(np.clip(round(float(bits) / len(h) * 0.69), 1, MAX_PROBES))
            cells = np.zeros(int(bits) // 8 + 1, np.uint8)
            for probe in range(probes):
                _fill(cells, _places(h, bits, probe))
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([int(bits)], pa.int64()), pa.array([probes], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["shard", "bits", "probes", "cells"])

    return run


def possibly_repeated(hashes: DataFrame, filter_bytes: int = FILTER_BYTES):
    """First pass over a frame of one bigint column: a function of a hash column that is true for every repeated hash.

    False is certain; true is not.  Hashes are not null.
    """
    spark = hashes.sparkSession
    n = min(runtime.partitions(spark), max(1, filter_bytes // 64))
    keys = 1 + hashes.count() // n
    own = hashes.mapInArrow(_own_distinct(n), "shard int, h bigint, twice boolean")
    parts = own.repartitionById(n, "shard").mapInArrow(_repeated_of(n, keys + keys // 4, max(64, filter_bytes * 8 // n)), "shard int, bits bigint, probes int, cells binary").collect()
    bits, probes, start = np.ones(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    cells, size = [], 0
    for p in parts:
        bits[p["shard"]], probes[p["shard"]], start[p["shard"]] = p["bits"], p["probes"], size * 8
        cells.append(p["cells"])
        size += len(p["cells"])
    held = spark.sparkContext.broadcast((bits, probes, start, np.frombuffer(b"".join(cells) or b"\0", np.uint8)))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        bits, probes, start, cells = held.value
        h = h.to_numpy().view(np.uint64)
        shard = _shard(h, len(bits)).astype(np.int64)
        out = probes[shard] > 0
        for probe in range(MAX_PROBES):
            asked = np.flatnonzero(out & (probes[shard] > probe))
            s = shard[asked]
            out[asked] = _test(cells, start[s] + _places(h[asked], bits[s], probe))
        return pd.Series(out)

    return maybe


def _hash() -> Column:
    return F.xxhash64("sha")


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their groups.  Groups of a HOT-th of the rows, HOT at most, are broadcast, and their rows do not shuffle."""
    large = F.col("group_size") * HOT >= rows.count()
    hot = rows.join(F.broadcast(groups.where(large)), "sha", "left")
    return hot.where("group_size is not null").unionByName(hot.where("group_size is null").drop("group_size", "last").join(groups.where(~large), "sha"))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.
    Of equal texts the row with the largest id stays (a row without id only if none has
    one); of equal rows just one does.  Other columns are ignored, an empty table gives
    no rows.  Texts are read once: their digests are written, and both passes read these.
    """
    rows = runtime.settled(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("sha")))
    maybe = possibly_repeated(rows.select(_hash().alias("h")), filter_bytes)
    tested = rows.withColumn("maybe", maybe(_hash()))
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    repeated = runtime.settled(tested.where("maybe").drop("maybe")).withColumn("place", F.monotonically_increasing_id())
    groups = runtime.settled(repeated.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "place")).alias("last")))
    together = _joined(repeated, groups).select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("last.place")).alias("kept"), "sha")
    return alone.unionByName(together).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: rows not in the filter never shuffle.

    Of equal texts the row with the largest id stays, and of those the one with the
    largest text as it was written.  Rows are taken whole, so any column names will do.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest(text).alias("sha"))
    maybe = possibly_repeated(whole.select(_hash().alias("h")), filter_bytes)
    tested = whole.withColumn("maybe", maybe(_hash()))
    order = F.struct(F.col(f"row.`{doc_id}`"), F.col(f"row.`{text}`"))
    last = tested.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return tested.where("not maybe").select("row").unionByName(last.select("row")).select("row.*")
