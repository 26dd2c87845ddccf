"""Interpolated modified Kneser-Ney byte n-gram models, counted by Spark.

The units are UTF-8 bytes, so an n-gram of up to five fits a 64-bit key exactly
(no hash collisions, no unknown word) and the suffix and the context of a key
are a mask and a shift.  Texts are padded with ``\\x02`` and closed by ``\\x03``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks
from tieout.llm.words import mix

ORDER = 5
UNITS = 257  # bytes and the end of text
COUNTS = "model string, key bigint, n bigint"


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams that end at each byte and at the end of each text, and where each text's begin."""
    pad = b"\x02" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + t + b"\x03" for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    key = np.zeros(max(0, len(data) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(8)) | data[i : i + len(key)]
    begin = np.cumsum(sizes) - sizes
    # Keys that reach over into the next text's padding are left out.
    keep = np.ones(len(key), bool)
    over = (begin + sizes + np.arange(len(texts)) * (ORDER - 1))[:-1]
    for i in range(ORDER - 1):
        keep[over + i] = False
    return key[keep], begin


def by_model(table: pa.Table) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """The texts of a piece of documents by the model that scores them, with their row numbers."""
    names = np.array(table["model"].to_pylist(), dtype=object)
    texts = table["text"].cast(pa.binary()).to_pylist()
    for name in sorted(set(names)):
        rows = np.flatnonzero(names == name)
        yield name, rows, [texts[i] or b"" for i in rows]


def summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n (or the number of rows) of each."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.argsort(key) if n is not None else None
    key = np.sort(key) if n is None else key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.diff(start, append=len(key)) if n is None else np.add.reduceat(n[order], start)
    return key[start], total


def count(packed: DataFrame, trusted: DataFrame, trains: Callable[[str], str] = lambda model: model) -> DataFrame:
    """ORDER-gram counts by model over the packed documents whose id is in ``trusted`` (block, doc_id).

    A document that is scored by a model counts for the model ``trains(model)``.
    """

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        ids = set(replies["doc_id"].to_pylist())
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for table in blocks.documents(payloads) if ids else ():
            chosen = table.filter(pa.array([i in ids for i in table["doc_id"].to_pylist()]))
            for scorer, _, texts in by_model(chosen):
                model = trains(scorer)
                key, n = summed(ngrams(texts)[0])
                if model in found:
                    key, n = np.concatenate([found[model][0], key]), np.concatenate([found[model][1], n])
                    key, n = summed(key, n)
                found[model] = key, n
        return pa.table(
            {
                "model": pa.array([model for model, (key, _) in found.items() for _ in range(len(key))], pa.string()),
                "key": pa.array(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found.values())]).astype(np.int64), pa.int64()),
                "n": pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, n in found.values())]).astype(np.int64), pa.int64()),
            }
        )

    return blocks.answer(packed, trusted, run, COUNTS).groupBy("model", "key").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame) -> DataFrame:
    """(model, rank, key, n) for every order: raw counts on top, below it the number of distinct left neighbours."""
    levels = [counts.select("model", F.lit(ORDER).alias("rank"), "key", "n")]
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (8 * order)) - 1)
        # The filter holds for every row; it keeps n in the plan, so that both uses of a level share one exchange.
        lower = levels[-1].where("n > 0").groupBy("model", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count("*").alias("n"))
        levels.append(lower.select("model", F.lit(order).alias("rank"), "key", "n"))
    return reduce(DataFrame.unionByName, levels)


def discounts(model: DataFrame) -> DataFrame:
    """(model, rank, d1, d2, d3): modified Kneser-Ney discounts from the counts of counts."""
    times = [F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)]
    t1, t2, t3, t4 = (F.greatest(F.col(f"t{i}"), F.lit(0.5)) for i in (1, 2, 3, 4))
    y = t1 / (t1 + 2 * t2)
    held = lambda d, most: F.least(F.greatest(d, F.lit(0.1)), F.lit(most))
    return (
        model.groupBy("model", "rank")
        .agg(*times)
        .select("model", "rank", held(1 - 2 * y * t2 / t1, 0.95).alias("d1"), held(2 - 3 * y * t3 / t2, 1.9).alias("d2"), held(3 - 4 * y * t4 / t3, 2.9).alias("d3"))
    )


class KneserNey:
    """Log probabilities from the tables of one model (or from the part of them that a shard holds)."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], cuts: dict[int, tuple[float, float, float]]) -> None:
        self.seen: dict[int, tuple[blocks.Lookup, np.ndarray]] = {}
        self.back: dict[int, tuple[blocks.Lookup, np.ndarray]] = {}
        for order in sorted(levels):
            key, n = levels[order]
            by_key = np.argsort(key)
            key, n = key[by_key], n[by_key].astype(np.float64)
            context = key >> np.uint64(8)
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), context[1:] != context[:-1]]))
            per = np.diff(start, append=len(key))
            share, rest = self._smoothed(n, start, per, cuts.get(order))
            lower = np.full(len(key), 1 / UNITS) if order == 1 else np.exp(self._at(order - 1, key & np.uint64((1 << (8 * (order - 1))) - 1)))
            p = share + np.repeat(rest, per) * lower
            self.seen[order] = self._held(key, np.log(p))
            self.back[order] = self._held(context[start], np.log(np.maximum(rest, 1e-12)))

    @staticmethod
    def _smoothed(n: np.ndarray, start: np.ndarray, per: np.ndarray, cuts) -> tuple[np.ndarray, np.ndarray]:
        """Each n-gram's own share of its context, and what the context leaves to the lower order."""
        cut = np.minimum(np.where(n >= 3, cuts[2], np.where(n == 2, cuts[1], cuts[0])), n)
        total = np.add.reduceat(n, start)
        return (n - cut) / np.repeat(total, per), np.add.reduceat(cut, start) / total

    @staticmethod
    def _held(key: np.ndarray, value: np.ndarray) -> tuple[blocks.Lookup, np.ndarray]:
        """Sorted hashes with their values; mix() is one to one, so equal hashes are equal keys."""
        hashed = mix(key)
        order = np.argsort(hashed)
        return blocks.Lookup(hashed[order]), value[order].astype(np.float32)

    def _at(self, order: int, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.float32)
        rest = np.arange(len(key))
        while len(rest):
            if order == 0 or order not in self.seen:
                out[rest] -= np.float32(np.log(UNITS)) if order == 0 else 0
                if order == 0:
                    break
                order, key = order - 1, key & np.uint64((1 << (8 * (order - 1))) - 1)
                continue
            lookup, value = self.seen[order]
            at, there = lookup.find(mix(key))
            out[rest[there]] += value[at[there]]
            rest, key = rest[~there], key[~there]
            lookup, value = self.back[order]
            at, there = lookup.find(mix(key >> np.uint64(8)))
            out[rest[there]] += value[at[there]]
            order, key = order - 1, key & np.uint64((1 << (8 * (order - 1))) - 1)
        return out

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last byte of each ORDER-gram, given the bytes before it."""
        return self._at(ORDER, key)


def models(rows: pa.Table, kind: type[KneserNey] = KneserNey) -> dict[str, KneserNey]:
    """By name, from rows (model, rank, key, n) and, under rank -order, the discounts d1, d2, d3 of an order (if there are any)."""
    out = {}
    names = rows["model"].to_numpy(zero_copy_only=False)
    rank, key, n = (rows[c].to_numpy() for c in ("rank", "key", "n"))
    cuts = [rows[c].to_numpy(zero_copy_only=False) for c in ("d1", "d2", "d3") if c in rows.column_names]
    for model in set(names):
        own = names == model
        levels, held = {}, {}
        for order in range(1, ORDER + 1):
            at, cut = np.flatnonzero(own & (rank == order)), np.flatnonzero(own & (rank == -order))
            if len(at) and (len(cut) or not cuts):
                levels[order] = key[at].astype(np.uint64), n[at]
                held[order] = tuple(c[cut[0]] for c in cuts)
        if levels:
            out[model] = kind(levels, held)
    return out
