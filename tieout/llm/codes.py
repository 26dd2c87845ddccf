"""Vector codes: product quantisation, its codebooks trained by Lloyd rounds with Hamerly's bounds.

Vectors are packed once into chunks (``CHUNK`` vectors a row), which never shuffle.  A
round maps chunks to chunks: each part of each vector keeps its entry, an upper bound
of the distance to it and a lower bound of the distance to any other.  Entries that
have moved loosen the bounds; only parts whose upper bound is not strictly below the
lower one (or half the way to the next entry) measure their own entry again, and only
those that still fail scan the codebook, in whole integers, ties to the lower index.
Bounds are rounded outwards to 32 bits, so a part that skips the scan has one nearest
entry and no tie.

A chunk also carries its sums by entry, mended by what has moved, so a round's new
codebooks are sums over one small column; only these sums (entries times dimensions)
reach the driver.  The chunks of the round before are deleted when the next are written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import runtime

CHUNK = 4096
#: Sums by label are broadcast up to so many labels.
FEW_LABELS = 100_000


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: parts, entries of a codebook, components of a part."""

    parts: int
    entries: int
    width: int

    @property
    def dims(self) -> int:
        return self.parts * self.width


def _up(x: np.ndarray) -> np.ndarray:
    """The next 32-bit number that is not below x, and one more for what rounding has lost."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (points x entries), in integers."""
    out = np.empty((len(points), len(book)), np.int64)
    for k, entry in enumerate(book):
        gap = points - entry
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _scan(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals), upper bound, lower bound of every other entry."""
    squares = _squares(points, book)
    nearest = squares.argmin(axis=1)
    at = np.arange(len(points))
    upper = _up(np.sqrt(squares[at, nearest].astype(np.float64)))
    if len(book) == 1:
        return nearest.astype(np.uint8), upper, np.full(len(points), np.inf, np.float32)
    second = np.partition(squares, 1, axis=1)[:, 1]
    return nearest.astype(np.uint8), upper, _down(np.sqrt(second.astype(np.float64)))


class Bounds:
    """Entry and bounds of one part of the vectors of a chunk."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.entry, self.upper, self.lower = entry, upper, lower

    def moved(self, points: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Follows the entries to where they have moved; which parts have measured the whole codebook."""
        drift = _up(np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)))
        others = np.array([max([0.0, *np.delete(drift, k)]) for k in range(len(new))], np.float32)
        apart = np.sqrt(_squares(new, new).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        half = _down(apart.min(axis=1) / 2)
        self.upper = _up(self.upper.astype(np.float64) + drift[self.entry])
        self.lower = _down(self.lower.astype(np.float64) - others[self.entry])
        limit = np.maximum(half[self.entry], self.lower)
        loose = np.flatnonzero(~(self.upper < limit))
        gap = points[loose] - new[self.entry[loose]]
        self.upper[loose] = _up(np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64)))
        failed = loose[~(self.upper[loose] < limit[loose])]
        self.entry[failed], self.upper[failed], self.lower[failed] = _scan(points[failed], new)
        return failed


def _summed(points: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Sums and counts by entry (the count last)."""
    out = np.zeros((entries, points.shape[1] + 1), np.int64)
    for k in np.unique(entry):
        mine = points[entry == k]
        out[k, :-1], out[k, -1] = mine.sum(axis=0), len(mine)
    return out


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                vectors = np.floor(flat.reshape(-1, dims) * 4096)
                vectors = vectors.astype(np.int16 if np.abs(vectors).max() < 2**15 else np.int32)
                labels = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([part.schema.field(0), part.schema.field(1)]))
                labels.write_batch(part.select([0, 1]))
                labels.close()
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_bytes(vectors)], pa.binary()), pa.array([vectors.dtype.itemsize], pa.int32())], ["rows", "vectors", "width"])

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Chunks one by one, so that one at a time is taken apart."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _points(vectors: bytes, width: int, shape: Shape) -> np.ndarray:
    """(parts, vectors, components) as 64-bit integers."""
    flat = np.frombuffer(vectors, np.int16 if width == 2 else np.int32).reshape(-1, shape.parts, shape.width)
    return flat.transpose(1, 0, 2).astype(np.int64)


def _first(shape: Shape, books: np.ndarray):
    """Every part measures the whole codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                points = _points(row["vectors"], row["width"], shape)
                found = [_scan(points[p], books[p]) for p in range(shape.parts)]
                sums = np.stack([_summed(points[p], found[p][0], shape.entries) for p in range(shape.parts)])
                yield _chunk(row, *(np.stack([f[i] for f in found]) for i in range(3)), sums, found[0][0].size * shape.parts)

    return run


def _next(shape: Shape, old: np.ndarray, new: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                points = _points(row["vectors"], row["width"], shape)
                entry = np.frombuffer(row["entry"], np.uint8).reshape(shape.parts, -1).copy()
                upper, lower = (np.frombuffer(row[n], np.float32).reshape(shape.parts, -1).copy() for n in ("upper", "lower"))
                sums = np.frombuffer(row["sums"], np.int64).reshape(shape.parts, shape.entries, -1).copy()
                scanned = 0
                for p in range(shape.parts):
                    held, before = Bounds(entry[p], upper[p], lower[p]), entry[p].copy()
                    scanned += len(held.moved(points[p], old[p], new[p]))
                    entry[p], upper[p], lower[p] = held.entry, held.upper, held.lower
                    other = np.flatnonzero(entry[p] != before)
                    sums[p] += _summed(points[p][other], entry[p][other], shape.entries) - _summed(points[p][other], before[other], shape.entries)
                yield _chunk(row, entry, upper, lower, sums, scanned)

    return run


_CHUNKS = "rows binary, vectors binary, width int, entry binary, upper binary, lower binary, sums binary, scanned bigint"


def _chunk(row: dict, entry, upper, lower, sums, scanned: int) -> pa.RecordBatch:
    values = [row["rows"], row["vectors"], row["width"], *map(_bytes, (entry, upper, lower, sums)), scanned]
    types = [pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 4, pa.int64()]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in _CHUNKS.split(", ")])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the chunks of a task, one row a number."""
    total = None
    for batch in batches:
        for sums in batch.column(0).to_pylist():
            numbers = np.frombuffer(sums, np.int64)
            total = numbers.copy() if total is None else total + numbers
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])


def _moved(chunks: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floor(sum / count); unused entries stay."""
    rows = chunks.select("sums").mapInArrow(_added, "at int, value bigint").groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(shape.parts * shape.entries * (shape.width + 1), np.int64)
    for r in rows:
        sums[r["at"]] = r["value"]
    sums = sums.reshape(shape.parts, shape.entries, shape.width + 1)
    counts = sums[:, :, -1:]
    return np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)


def _coded(shape: Shape, books: np.ndarray):
    """Rows of the last chunks: code and squared distances, with labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                points = _points(row["vectors"], row["width"], shape)
                entry = np.frombuffer(row["entry"], np.uint8).reshape(shape.parts, -1)
                error = np.zeros(entry.shape[1], np.int64)
                for p in range(shape.parts):
                    gap = points[p] - books[p][entry[p]]
                    error += np.einsum("ij,ij->i", gap, gap)
                code = [c.tobytes().hex() for c in np.ascontiguousarray(entry.T)]
                keys = pa.ipc.open_stream(row["rows"]).read_all().combine_chunks().to_batches()[0]
                yield pa.record_batch([keys.column(0), keys.column(1), pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


class Training:
    """Chunks below one folder, a folder a round; only the newest is kept."""

    def __init__(self, spark: SparkSession) -> None:
        runtime.shared_folder(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/codes-{uuid.uuid4().hex}"
        self.kept: str | None = None

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        path, gone = f"{self.root}/{name}", self.kept
        rows.write.option("compression", "none").parquet(path)
        if gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(gone)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.kept = path
        return self.spark.read.parquet(path)


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embeddings.where(F.col(vector).isNotNull() & ~F.exists(vector, bad)).where(F.size(vector) > 0)


def encode(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Components become floor(4096 x).  Codebooks start from the parts of the vectors with
    the least ids (of equal ids the lesser vectors), and there are fewer entries if there
    are fewer vectors.  Vectors must have the length of the first of these, a multiple of
    ``parts``: others, and empty ones, are left out.  Components whose squared distances
    could leave the 64 bits of an error (46,000 at 64 components) raise.  Repeated rows
    each have their row; an id may be null (the least); other columns are ignored.  No
    usable vector: no rows.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vec_id", "vector")
    types = dict(rows.dtypes)
    ordered = rows.where(F.size("vector") % parts == 0).orderBy("vec_id", "vector")
    first = ordered.select(F.size("vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dims = first["n"]
    seeds = [r[0] for r in ordered.where(F.size("vector") == dims).limit(entries).select("vector").collect()]
    largest = min(2.0**18, (2.0**63 / dims) ** 0.5 / 8192)
    over = F.exists("vector", lambda x: F.abs(x) >= largest)
    rows = rows.where(F.size("vector") == dims).withColumn("vector", F.when(over, F.raise_error(F.lit(f"a component from {largest:.0f} on"))).otherwise(F.col("vector")))
    shape = Shape(parts, len(seeds), dims // parts)
    books = np.floor(np.array(seeds, np.float64) * 4096).astype(np.int64).reshape(-1, parts, shape.width).transpose(1, 0, 2)
    training = Training(spark)
    packed = rows.mapInArrow(_packed(dims), "rows binary, vectors binary, width int")
    chunks = training.written(packed.mapInArrow(_first(shape, books), _CHUNKS), "0")
    for r in range(1, rounds + 1):
        new = _moved(chunks, shape, books)
        chunks = training.written(chunks.mapInArrow(_next(shape, books, new), _CHUNKS), str(r))
        books = new
    coded = chunks.mapInArrow(_coded(shape, books), f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")
    by_label = runtime.settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    by_label = F.broadcast(by_label) if by_label.count() <= FEW_LABELS else by_label
    told = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    joined = coded.alias("c").join(by_label.alias("l"), F.expr("c.label <=> l.label")).select("c.*", "l.label_error")
    return joined.withColumn("codebooks_sha256", F.lit(told))
