"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document is contaminated by an item if some stretch of its words is within
``floor(tolerance * words)`` word edits of the item (words in lower case, without
punctuation).

1. Windows.  An item is searched for by ``ceil(words / 8)`` pieces that begin evenly
   spread over it, the last 8 words before its end; edits that spoil one piece leave
   another.  Every word of every document begins a window.
2. Embedding.  A window walks through ``STEPS`` steps: at each it stays or goes on to
   the next word by a random bit of repetition, step and word, so that windows
   within a small edit distance agree in most steps.
3. Bit sampling.  A repetition has its own walk, and hashes ``SAMPLES`` sampled steps.
   The hashes of the pieces make one table for each repetition, which every
   window probes; equal hashes make the item and the place a candidate.
   Items of each length have as many repetitions as their own class needs: they are
   added until items of that length, among other words and with the largest allowed
   number of random edits or of substitutions, are met with the target recall at 95 %
   confidence (measured on a fresh copy of each kind of every item, or on ``TRIES``
   of each kind if the class has fewer items).  A class that ``REPEATS`` repetitions
   do not bring there has them all.
4. Verification.  Of the candidates that hold enough of the item's words, the exact
   edit distance of the item to the best stretch around the place.  Words are
   compared by their number in the items' vocabulary, not by a hash.

Items of fewer than ``MIN_WORDS`` words are found word for word (no edits), by
windows of each such length.

The benchmark is the query set: it is dealt to blocks of at most about ``ITEMS``
items and ``ITEM_BYTES`` of text, tasks build the tables of a block, and the blocks
are broadcast.  Every document row passes the blocks one after the other, without
any shuffle.

Defined results: an item without words, and null and empty texts, match nothing;
equal items are reported by each id; a null item id counts but is not listed;
every input row has one output row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks
from tieout.llm.words import PUNCTUATION, Words, mix, window_hash, words_of

ITEMS = 20_000
ITEM_BYTES = 64 << 20
MIN_WORDS = 8
STEPS = 2 * MIN_WORDS
SAMPLES = 3
REPEATS = 256
TRIES = 1000
_FILTER_BITS = 20


def normal_words(column: pa.ChunkedArray) -> Words:
    return words_of(pc.utf8_lower(column), between=PUNCTUATION)


def _plans() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each repetition: the salt of its walk, the sampled steps in order, and factors to hash them."""
    random = np.random.default_rng(10)
    steps = np.array([np.sort(random.choice(STEPS, SAMPLES, replace=False)) for _ in range(REPEATS)])
    odd = lambda *shape: random.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(REPEATS), steps, odd(REPEATS, SAMPLES)


_SALT, _SAMPLED, _FACTOR = _plans()


def embedded(digest: np.ndarray, number: np.ndarray, repeat: int) -> np.ndarray:
    """The hash of the sampled steps of the walk from each place of a word sequence on.

    ``digest`` holds a 64-bit value for each distinct word and ``number`` the word at each place.
    """
    n = len(number)
    padded = np.concatenate([number, np.full(STEPS, len(digest), number.dtype)])
    value = np.append(digest, np.uint64(0))
    bits = mix(value ^ _SALT[repeat])[padded]
    value = value[padded]
    at = np.arange(n)
    out = np.zeros(n, np.uint64)
    place = 0
    with np.errstate(over="ignore"):
        for step in range(int(_SAMPLED[repeat][-1]) + 1):
            if step == _SAMPLED[repeat][place]:
                out += value[at] * _FACTOR[repeat][place]
                place += 1
            at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return mix(out)


def pieces_of(n: int) -> list[int]:
    """Where the pieces of an item of n words begin."""
    m = -(-n // MIN_WORDS)
    return [i * (n - MIN_WORDS) // (m - 1) for i in range(m)] if m > 1 else [0]


@dataclass
class Model:
    """A block of items, ready to be searched for."""

    ids: list
    words: list[np.ndarray]  # numbers in the vocabulary
    edits: list[int]
    vocabulary: pa.Array
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # per repetition: filter, hashes, items, offsets
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hashes and items


def _edited(words: np.ndarray, k: int, random: np.random.Generator, fresh: int) -> np.ndarray:
    """The words with k random edits; new words are numbers from ``fresh`` on."""
    out = words.tolist()
    for i in range(k):
        at, kind = int(random.integers(len(out))), random.integers(3)
        if kind == 0:
            out[at] = fresh + i
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, fresh + i)
    return np.array(out, np.int64)


def _misses(tries: int, target: float) -> int:
    """Most misses of so many tries that leave a recall below the target unlikely (5 %); -1 if none do."""
    rare, chance, most = 0.0, (target) ** tries, -1
    while rare + chance <= 0.05:
        rare, most = rare + chance, most + 1
        chance *= (tries - most) / (most + 1) * (1 - target) / target
    return most


def _found_in(own: list[np.ndarray], other: list[np.ndarray], digest: np.ndarray, repeat: int) -> np.ndarray:
    """Which items share a piece's hash with some window of their own text."""
    gap = np.full(STEPS, len(digest), np.int64)
    mine = embedded(digest, np.concatenate([x for w in own for x in (w, gap)]), repeat)
    theirs = embedded(digest, np.concatenate(other), repeat)
    begin = np.cumsum([0, *(len(w) + STEPS for w in own)])[:-1]
    named = lambda value, row: mix(value ^ mix(row.astype(np.uint64) + np.uint64(1)))
    held = np.unique(named(theirs, np.repeat(np.arange(len(other)), [len(w) for w in other])))
    row = np.repeat(np.arange(len(own)), [len(pieces_of(len(w))) for w in own])
    at = np.concatenate([b + np.array(pieces_of(len(w))) for b, w in zip(begin, own)])
    out = np.zeros(len(own), bool)
    out[row[np.isin(named(mine[at], row), held)]] = True
    return out


def length_class(n: int) -> int:
    """Items of one class need about as many repetitions: each length to 31, then by powers of two."""
    return n if n < 32 else 32 + n.bit_length()


def repeats_for(words: list[np.ndarray], edits: list[int], digest: np.ndarray, target: float) -> int:
    """Fewest repetitions that meet the target on items of one class, for random edits and for substitutions alone."""
    random = np.random.default_rng(3)
    fresh = len(digest)
    more = np.concatenate([digest, mix(np.arange(1, max(edits) + 2 * STEPS + 2, dtype=np.uint64))])
    every = np.arange(max(TRIES, len(words))) % len(words)
    own, other = [], []
    for kind in (0, 1):
        for i in every:
            if kind:
                changed = words[i].copy()
                changed[random.choice(len(changed), edits[i], replace=False)] = fresh + np.arange(edits[i])
            else:
                changed = _edited(words[i], edits[i], random, fresh)
            around = fresh + max(edits) + 1 + random.permutation(2 * STEPS)
            own.append(words[i])
            other.append(np.concatenate([around[:STEPS], changed, around[STEPS:]]).astype(np.int32))
    open_, allowed = np.arange(2 * len(every)), _misses(len(every), target)
    for repeat in range(REPEATS):
        cuts = np.split(open_, range(2 * TRIES, len(open_), 2 * TRIES))
        open_ = np.concatenate([cut[~_found_in([own[i] for i in cut], [other[i] for i in cut], more, repeat)] for cut in cuts])
        if max((open_ < len(every)).sum(), (open_ >= len(every)).sum()) <= allowed:
            return repeat + 1
    return REPEATS


def build(rows: pa.Table, tolerance: float, target: float) -> Model | None:
    """The searchable form of rows (item_id, text)."""
    found = normal_words(rows["text"])
    names = rows["item_id"].to_pylist()
    digest = np.zeros(len(found.distinct), np.uint64)
    digest[found.ids] = found.hash
    ids, words, edits = [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for i, name in enumerate(names):
        own = found.ids[found.first[i] : found.first[i + 1]]
        if not len(own):
            continue
        if len(own) < MIN_WORDS:
            value = window_hash(digest[own], len(own))[0]
            short.setdefault(len(own), []).append((int(value), len(ids)))
        ids.append(name)
        words.append(own.astype(np.int64))
        edits.append(int(tolerance * len(own)) if len(own) >= MIN_WORDS else 0)
    if not ids:
        return None
    tables = []
    long = [i for i, w in enumerate(words) if len(w) >= MIN_WORDS]
    classes: dict[int, list[int]] = {}
    for i in long:
        classes.setdefault(length_class(len(words[i])), []).append(i)
    needed = {c: repeats_for([words[i] for i in held], [edits[i] for i in held], digest, target) for c, held in classes.items()}
    for repeat in range(max(needed.values(), default=0)):
        hashes, items, offsets = [], [], []
        for i in long:
            if needed[length_class(len(words[i]))] <= repeat:
                continue
            at = pieces_of(len(words[i]))
            hashes.append(embedded(digest, words[i], repeat)[at])
            items.append(np.full(len(at), i))
            offsets.append(at)
        value, item, offset = (np.concatenate(x) for x in (hashes, items, offsets))
        order = np.argsort(value)
        some = np.zeros(1 << _FILTER_BITS, bool)
        some[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        tables.append((np.packbits(some), value[order], item[order], offset[order]))
    by_length = {}
    for n, rows_ in short.items():
        rows_.sort()
        by_length[n] = np.array([r[0] for r in rows_], np.uint64), np.array([r[1] for r in rows_])
    return Model(ids, words, edits, found.distinct, tables, by_length)


def edit_distances(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits between the item and any stretch of each region (rows; a number that is not in the item pads)."""
    rows, n = regions.shape
    step = np.arange(n + 1)
    last = np.zeros((rows, n + 1), np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(last)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(last[:, :-1] + (regions != word), last[:, 1:] + 1)
        last = np.minimum.accumulate(new - step, axis=1) + step
    return last.min(axis=1)


def _pairs(value: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of a sorted table with equal hashes."""
    lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, side="right")
    n = hi - lo
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(at, n), row


def candidates(words: Words, number: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, item, place of the item's first word) that some table meets."""
    digest = np.zeros(len(words.distinct), np.uint64)
    digest[words.ids] = words.hash
    out = [np.zeros((3, 0), np.int64)]
    for repeat, (packed, hashes, items, offsets) in enumerate(model.tables):
        some = np.unpackbits(packed).view(bool)
        value = embedded(digest, words.ids, repeat)
        hit = np.flatnonzero(some[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at, row = _pairs(value[hit], hit, hashes)
        out.append(np.unique(np.stack([words.doc[at], items[row], at - offsets[row]]), axis=1))
    for n, (hashes, items) in model.short.items():
        value = window_hash(words.hash, n)
        whole = np.flatnonzero(words.left(n)[: len(value)])
        at, row = _pairs(value[whole], whole, hashes)
        out.append(np.stack([words.doc[at], items[row], at]))
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def _region(words: Words, number: np.ndarray, doc: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Word numbers from ``begin`` on, n in a row, -2 outside of the document."""
    at = begin[:, None] + np.arange(n)
    inside = (at >= words.first[doc][:, None]) & (at < words.first[doc + 1][:, None])
    return np.where(inside, number[np.clip(at, 0, len(number) - 1)], -2)


def matches(table: pa.Table, model: Model) -> dict[int, set[int]]:
    """Items found in each text of a piece of documents: row -> item places."""
    words = normal_words(table["text"])
    out: dict[int, set[int]] = {}
    if not len(words.doc):
        return out
    known = pc.fill_null(pc.index_in(words.distinct, value_set=model.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    number = known[words.ids]
    doc, item, start = candidates(words, number, model)
    for i in np.unique(item):
        own, k = model.words[i], model.edits[i]
        chosen = np.flatnonzero(item == i)
        width = len(own) + 2 * k
        for cut in range(0, len(chosen), max(1, (1 << 20) // width)):
            part = chosen[cut : cut + max(1, (1 << 20) // width)]
            region = _region(words, number, doc[part], start[part] - k, width)
            enough = np.flatnonzero(np.isin(region, own).sum(axis=1) >= len(own) - k)
            near = part[enough[edit_distances(own, region[enough]) <= k]] if len(enough) else enough
            for row in np.unique(doc[near]) if len(near) else ():
                out.setdefault(int(row), set()).add(int(i))
    return out


def _finder(model):
    """Adds a block's finds to ``hits`` and ``item_ids``; every other column passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pickle.loads(model.value)
        for batch in batches:
            for table in blocks.pieces(pa.Table.from_batches([batch])):
                found = matches(table, items) if items else {}
                hits = [n + len(found.get(i, ())) for i, n in enumerate(table["hits"].to_pylist())]
                ids = [sorted({*old, *(items.ids[j] for j in found.get(i, ()))} - {None}) for i, old in enumerate(table["item_ids"].to_pylist())]
                held = {c: table[c].combine_chunks() for c in table.column_names} | {"hits": pa.array(hits, pa.int64()), "item_ids": pa.array(ids, pa.list_(pa.int64()))}
                yield pa.record_batch(list(held.values()), list(held))

    return run


def find(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, target: float = 0.99, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids for every row of ``docs``, and the columns ``carry`` of the row."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-total // ITEMS), -(-(size or 0) // ITEM_BYTES))

    def built(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        return pa.table({"p": pa.array([key[0].as_py()], pa.int64()), "model": pa.array([pickle.dumps(build(rows, tolerance, target))], pa.binary())})

    models = items.withColumn("p", F.pmod(F.xxhash64("text"), F.lit(passes)).cast("bigint")).groupBy("p").applyInArrow(built, "p bigint, model binary")
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("hits"), F.array().cast("array<bigint>").alias("item_ids")]
    found = docs.select(*own, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    for row in models.orderBy("p").toLocalIterator():
        found = found.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(bytes(row["model"]))), found.schema)
    carried = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c not in ("doc_id", "contaminated", "n_items", "item_ids")]
    return found.select("doc_id", (F.col("hits") > 0).alias("contaminated"), F.col("hits").alias("n_items"), "item_ids", *carried)
