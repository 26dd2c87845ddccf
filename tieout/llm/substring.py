"""Exact substring deduplication over word windows with fixed-block anchors.

A window is ``window`` consecutive words of one document.  A word is removed
when a window covers it whose word sequence also starts in a document with a
smaller ``doc_id``.

Method.  With anchors of ``a = (window + 1) // 2`` words laid end to end from
the first word on, every window holds one whole anchor of its document.

1. Index and probe.  Each block sends its anchors (the index) and every rolling
   ``a``-word window (the probes) as sorted 32-bit keys to shards; a shard marks
   the keys that are an anchor somewhere and occur in two documents.
2. Extend.  Around every marked place all ``window``-word windows are taken, one
   word further at a time as far as marked keys reach.  Their digests (96 bits, and
   the shard index from 32 others) go to shards with the smallest document that
   has them; a window whose smallest document is another one is a hit.  Chained
   hits with one owner are the maximal repeats.
3. Compare.  The words of each maximal repeat go, once per block, to the block of
   their owner, where every window is compared with the owner's words.  Equal
   digests of different words stop the job (pass another ``key``); a result is
   never given on digests alone.
4. Cut.  Blocks look their windows up in what came back and drop covered words.

A key crosses the network once per block however often it occurs, and nothing
is paired, so hot passages cost a row per block.

Defined results: a null or empty text has no words and stays (kept text empty);
a null ``doc_id`` is neither smaller nor larger than any other, so such a row
keeps all of its words and removes none elsewhere; repeated rows and rows with
equal ids count as one document for the comparison and all stay in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks, runtime
from tieout.llm.words import Words, exact_groups, mix, segment_any, window_hash, words_of

_PROBES = "shard int, block int, n int, keys binary, anchor binary, several binary"
_MARKS = "block int, shard int, marks binary"
_REPEATS = "shard int, block int, keys binary, more binary, least binary, most binary"
_OWNERS = "block int, shard int, keys binary, more binary, owners binary, homes binary"
_CLAIMS = "block int, payload binary"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _shard(value: np.ndarray, n: int) -> np.ndarray:
    return ((value >> _32) * np.uint64(n)) >> _32


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["doc_id"]
    return pc.fill_null(ids, 0).to_numpy().astype(np.int64), ids.is_valid().to_numpy()


def _short_keys(words: Words, known: np.ndarray, a: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole a-word windows and their keys: shard in the high half, 32 hash bits in the low."""
    value = window_hash(words.hash, a)
    at = np.flatnonzero(words.left(a)[: len(value)] & known[words.doc[: len(value)]])
    value = value[at]
    return at, (_shard(value, n) << _32) | (value & _LOW)


def _probes(window: int, n: int, salt: int):
    a = (window + 1) // 2

    def run(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, docs, heads = [], [], []
        for table in blocks.documents(payloads):
            ids, known = _ids(table)
            words = words_of(table["text"], key=salt)
            at, key = _short_keys(words, known, a, n)
            keys.append(key)
            docs.append(ids[words.doc[at]])
            heads.append((at - words.first[words.doc[at]]) % a == 0)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        if not len(key):
            return
        order = np.argsort(key)
        key, doc, head = key[order], np.concatenate(docs)[order], np.concatenate(heads)[order]
        start = np.flatnonzero(np.diff(key, prepend=~key[0]))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        anchor = np.logical_or.reduceat(head, start)
        key = key[start]
        shards, edges = blocks.by_shard((key >> _32).astype(np.int64), n)
        rows = [(int(s), block, int(edges[s + 1] - edges[s]), slice(edges[s], edges[s + 1])) for s in shards]
        yield pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([blocks.encode_sorted((key[r[3]] & _LOW).astype(np.uint32)) for r in rows], pa.binary()),
                pa.array([np.packbits(anchor[r[3]]).tobytes() for r in rows], pa.binary()),
                pa.array([np.packbits(several[r[3]]).tobytes() for r in rows], pa.binary()),
            ],
            ["shard", "block", "n", "keys", "anchor", "several"],
        )

    return run


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _mark(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of a shard's keys: which are an anchor in some document and occur in another one too."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([blocks.decode_sorted(r["keys"], np.uint32) for r in rows])
    order = np.argsort(keys)
    start = np.flatnonzero(np.diff(keys[order].astype(np.int64), prepend=-1))
    anchor = np.logical_or.reduceat(np.concatenate([_bits(r["anchor"], r["n"]) for r in rows])[order], start)
    several = np.logical_or.reduceat(np.concatenate([_bits(r["several"], r["n"]) for r in rows])[order], start)
    times = np.diff(start, append=len(keys))
    mark = np.empty(len(keys), bool)
    mark[order] = np.repeat(anchor & (several | (times > 1)), times)
    marks = np.split(mark, np.cumsum(sizes)[:-1])
    return pa.table({"block": table["block"], "shard": table["shard"], "marks": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())})


def _candidates(window: int, n: int, salt: int, payloads: list[bytes], replies: pa.Table, emit) -> None:
    """Calls emit(words, ids, places) with the windows that hold a marked key."""
    a = (window + 1) // 2
    marks = {r["shard"]: r["marks"] for r in replies.to_pylist()}
    keys = [np.zeros(0, np.uint64)]
    for table in blocks.documents(payloads):  # words are taken again below: those of a whole block are several times its text
        keys.append(_short_keys(words_of(table["text"], key=salt), _ids(table)[1], a, n)[1])
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key)
    ordered = key[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1]]))
    shards, edges = blocks.by_shard((ordered[start] >> _32).astype(np.int64), n)
    mark = np.zeros(len(start), bool)
    for s in shards:
        if s in marks:
            mark[edges[s] : edges[s + 1]] = _bits(marks[s], edges[s + 1] - edges[s])
    marked = np.empty(len(key), bool)
    marked[order] = np.repeat(mark, np.diff(start, append=len(key)))
    del key, order, ordered
    done = 0
    for table in blocks.documents(payloads):
        ids, known = _ids(table)
        words = words_of(table["text"], key=salt)
        at, _ = _short_keys(words, known, a, n)
        hit = np.zeros(len(words.doc), bool)
        hit[at] = marked[done : done + len(at)]
        done += len(at)
        size = max(0, len(words.doc) - window + 1)
        # Window p holds a marked key if one starts in [p, p + window - a].
        span = window - a + 1
        held = segment_any(hit[::-1], span)[::-1][:size]
        place = np.flatnonzero(held & words.left(window)[:size] & known[words.doc[:size]])
        emit(words, ids, place)


def _digests(words: Words, window: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: 64 bits, 32 more, and its shard from another 32."""
    other = window_hash(words.twin, window)
    return window_hash(words.hash, window), (other & _LOW).astype(np.uint32), _shard(other, n).astype(np.int64)


def _repeats(window: int, n: int, salt: int):
    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        found = []

        def emit(words, ids, place):
            found.append((*(x[place] for x in _digests(words, window, n)), ids[words.doc[place]]))

        _candidates(window, n, salt, payloads, replies, emit)
        rows = []
        if sum(len(f[0]) for f in found):
            value, more, shard, doc = (np.concatenate([f[i] for f in found]) for i in range(4))
            order = np.lexsort((more, value, shard))
            value, more, shard, doc = value[order], more[order], shard[order], doc[order]
            new = np.ones(len(value), bool)
            new[1:] = (np.diff(shard) != 0) | (value[1:] != value[:-1]) | (more[1:] != more[:-1])
            start = np.flatnonzero(new)
            least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            value, more, shard = value[start], more[start], shard[start]
            ids, edges = blocks.by_shard(shard, n)
            for s in ids:
                cut = slice(edges[s], edges[s + 1])
                rows.append((int(s), block, blocks.encode_sorted(value[cut]), blocks.encode(more[cut]), blocks.encode(least[cut]), blocks.encode(most[cut] - least[cut])))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["shard", "block", "keys", "more", "least", "most"])

    return run


def _first_owner(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block of a shard: its keys that a smaller document has, with that document and its block."""
    rows = table.to_pylist()
    keys = [blocks.decode_sorted(r["keys"], np.uint64) for r in rows]
    more = [blocks.decode(r["more"], np.uint32) for r in rows]
    least = [blocks.decode(r["least"], np.int64) for r in rows]
    most = [blocks.decode(r["most"], np.int64) + m for r, m in zip(rows, least)]
    every, other, docs = np.concatenate(keys), np.concatenate(more), np.concatenate(least)
    homes = np.repeat(np.array([r["block"] for r in rows], np.int32), [len(k) for k in keys])
    order = np.lexsort((docs, other, every))
    first = np.concatenate([[True], (every[order][1:] != every[order][:-1]) | (other[order][1:] != other[order][:-1])])
    winner = np.empty(len(every), np.int64)
    winner[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(every)), 0))]
    out, at = [], 0
    for row, key_, rest, top in zip(rows, keys, more, most):
        own = winner[at : at + len(key_)]
        at += len(key_)
        keep = docs[own] < top
        if keep.any():
            out.append((row["block"], row["shard"], blocks.encode_sorted(key_[keep]), blocks.encode(rest[keep]), blocks.encode(docs[own[keep]]), blocks.encode(homes[own[keep]])))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["block", "shard", "keys", "more", "owners", "homes"])


class _Owners:
    """What came back to a block: digests of windows that a smaller document has."""

    def __init__(self, replies: pa.Table) -> None:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        with np.errstate(over="ignore"):
            for r in replies.to_pylist():
                key = blocks.decode_sorted(r["keys"], np.uint64) ^ (np.uint64(r["shard"]) * _SPREAD)
                parts.append((key, blocks.decode(r["more"], np.uint32), blocks.decode(r["owners"], np.int64), blocks.decode(r["homes"], np.int32)))
        key, more, owner, home = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((more, key))
        self.key, self.more, self.owner, self.home = blocks.Lookup(key[order]), more[order], owner[order], home[order]

    def __len__(self) -> int:
        return self.key.size

    def hits(self, words: Words, ids: np.ndarray, known: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of a piece: whether a smaller document has it, and the place of its owner."""
        value, more, shard = _digests(words, window, n)
        with np.errstate(over="ignore"):
            value ^= shard.astype(np.uint64) * _SPREAD
        at, there = self.key.find(value)
        wrong = np.flatnonzero(there & (self.more[at] != more))
        while len(wrong):  # equal in 64 bits and not in the rest
            at[wrong] += 1
            there[wrong] = self.key.ordered[at[wrong]] == value[wrong]
            there[wrong] &= at[wrong] < len(self)
            at[wrong] = np.minimum(at[wrong], len(self) - 1)
            wrong = wrong[there[wrong] & (self.more[at[wrong]] != more[wrong])]
        doc = words.doc[: len(value)]
        return there & words.left(window)[: len(value)] & known[doc] & (self.owner[at] < ids[doc]), at


def _claims(window: int, n: int, salt: int):
    """The words of each maximal repeat with one owner, for the block of the owner."""

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        owners = _Owners(replies)
        spans: dict[int, set[tuple[int, bytes]]] = {}
        for table in blocks.documents(payloads) if len(owners) else ():
            ids, known = _ids(table)
            words = words_of(table["text"], key=salt)
            if len(words.doc) < window:
                continue
            hit, at = owners.hits(words, ids, known, window, n)
            place = np.flatnonzero(hit)
            if not len(place):
                continue
            owner, home, doc = owners.owner[at[place]], owners.home[at[place]], words.doc[place]
            start = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(doc) != 0)]))
            end = np.append(start[1:], len(place)) - 1
            texts: dict[int, list[bytes]] = {}
            for a, b in zip(start.tolist(), end.tolist()):
                d = int(doc[a])
                if d not in texts:
                    texts = {d: table["text"][d].as_py().encode().split()}
                low = int(place[a] - words.first[d])
                spans.setdefault(int(home[a]), set()).add((int(owner[a]), b" ".join(texts[d][low : low + int(place[b] - place[a]) + window])))
        rows = []
        for home, own in sorted(spans.items()):
            own = sorted(own)
            rows.append((home, blocks._ipc(pa.table([pa.array([o for o, _ in own], pa.int64()), pa.array([t for _, t in own], pa.binary())], ["doc_id", "text"]))))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "payload"])

    return run


def differing(docs: pa.Table, claims: pa.Table, window: int, salt: int = 0) -> int:
    """Windows of the claimed texts that no document of the claimed id holds word for word."""
    texts = pa.chunked_array([*docs["text"].cast(pa.binary()).chunks, *claims["text"].chunks], pa.binary())
    owner = np.concatenate([docs["doc_id"].to_numpy(), claims["doc_id"].to_numpy()])
    words = words_of(texts, key=salt)
    size = max(0, len(words.doc) - window + 1)
    place = np.flatnonzero(words.left(window)[:size])
    whose = owner[words.doc[place]]
    with np.errstate(over="ignore"):
        value = window_hash(words.hash, window)[place] + mix(whose.astype(np.uint64))
    rows = words.rows(window)
    order, new = exact_groups(value, lambda at: np.column_stack([whose[at], rows(place[at])]))
    group = np.empty(len(place), np.int64)
    group[order] = np.cumsum(new) - 1
    claimed = words.doc[place] >= docs.num_rows
    held = np.zeros(len(place), bool)
    held[group[~claimed]] = True
    return int((~held[group[claimed]]).sum())


def _compared(window: int, salt: int):
    """No rows; stops where a claim's words are not its owner's."""

    def run(block: int, payloads: list[bytes], table: pa.Table) -> pa.Table:
        if table.num_rows:
            parts = [blocks.unpack(p) for p in table["payload"].to_pylist()]
            claims = pa.concat_tables(parts).group_by(["doc_id", "text"]).aggregate([])
            owners = pc.unique(claims["doc_id"])
            held = pa.concat_tables([t.select(["doc_id", "text"]).filter(pc.is_in(t["doc_id"], owners)) for t in blocks.documents(payloads)])
            # Rows that share an id are one document, so all texts of an owner are looked at together.
            size = pc.fill_null(pc.binary_length(held["text"]), 0).to_numpy()
            order = np.argsort(held["doc_id"].to_numpy(), kind="stable")
            ids = held["doc_id"].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // blocks.CHUNK_BYTES)) + 1
            cuts = sorted({int(np.searchsorted(ids, ids[c])) for c in cuts} | {0, len(ids)})
            for low, high in zip(cuts, cuts[1:]):
                docs = held.take(order[low:high])
                if differing(docs, claims.filter(pc.is_in(claims["doc_id"], pc.unique(docs["doc_id"]))), window, salt):
                    raise ValueError("different words have equal digests; run again with another key")
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 4], ["block", "shard", "keys", "more", "owners", "homes"])

    return run


def _cut(window: int, n: int, salt: int, names: list[str]):
    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        owners = _Owners(replies)
        out = []
        for table in blocks.documents(payloads):
            ids, known = _ids(table)
            words = words_of(table["text"], hashed=bool(len(owners)), key=salt)
            covered = np.zeros(len(words.doc), bool)
            if len(owners) and len(words.doc) >= window:
                repeat, _ = owners.hits(words, ids, known, window, n)
                covered = segment_any(np.concatenate([repeat, np.zeros(window - 1, bool)]), window)
            raw = table["text"].cast(pa.binary()).to_pylist()
            first = words.first
            gone = np.diff(np.concatenate([[0], np.cumsum(covered)])[first])
            kept = []
            for i, text in enumerate(raw):
                parts = (text or b"").split()
                if gone[i]:
                    parts = compress(parts, (~covered[first[i] : first[i + 1]]).tolist())
                kept.append(b" ".join(parts))
            columns = {name: table[name] for name in names}
            columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
            columns["n_words"] = pa.array(np.diff(first), pa.int64())
            columns["n_removed"] = pa.array(gone, pa.int64())
            out.append(pa.table(columns))
        return pa.concat_tables(out)  # replies only ever name blocks that hold documents

    return run


def remove_repeats(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = (), key: int = 0) -> DataFrame:
    """``docs`` with repeated windows cut: doc_id, carried columns, text, n_words, n_removed.

    ``text`` holds the kept words joined by one space.  Columns to ``carry`` that
    are named like one of the operator's own are left out.
    """
    spark = docs.sparkSession
    n = runtime.partitions(spark)
    names = ["doc_id", *(c for c in carry if c not in ("doc_id", "text", "n_words", "n_removed"))]
    packed = blocks.pack(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), [*names, "text"], n)
    marks = blocks.per_block(packed, _probes(window, n, key), _PROBES).groupBy("shard").applyInArrow(_mark, _MARKS)
    owners = blocks.answer(packed, marks, _repeats(window, n, key), _REPEATS).groupBy("shard").applyInArrow(_first_owner, _OWNERS)
    claims = blocks.answer(packed, owners, _claims(window, n, key), _CLAIMS)
    compared = blocks.answer(packed, claims, _compared(window, key), _OWNERS)
    shape = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *names[1:], F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed")).schema
    return blocks.answer(packed, owners.unionByName(compared), _cut(window, n, key, names), shape)
