"""Exact byte-level repeats from a distributed merge sort of sampled suffixes.

Every byte covered by a ``length``-byte string that also starts anywhere else
(the same document included) is removed; strings are judged on the input.

Method.  A suffix array over every byte would move each byte hundreds of times,
so the suffixes are sampled by content: a suffix starts at each position whose
``seed``-byte hash is the least of some ``length``-byte string around it.  Equal
strings choose the same start, so every repeated string is *owned* by a suffix
in each of its copies and the sample loses none.

1. Blocks send the distinct seeds (32-bit keys) to shards, which mark those that
   occur twice.  Only suffixes with a marked seed go on.
2. Each block sorts its suffixes (``length`` bytes at most; the bytes before the
   start follow as a tie break), merges equal ones, and sends them front coded
   to ranges of the suffix order whose bounds come from a sample of documents.
3. A range merges its runs with a loser tree that holds, for each contender, the
   prefix it shares with the last suffix put out, and compares only what follows
   it.  The merge yields the common prefix of neighbours, which bounds the owned
   strings that can repeat; of these, strings with equal hashes are compared byte
   by byte.
4. Bits for the owned strings go back to the blocks, which cut the bytes.

Suffixes that share their seed with a range bound may lie on both sides of it.
Their owned strings are told apart by 128-bit XXH3 digests over shards instead, so a
seed with a third of all rows is spread over the cluster.

In a stretch that repeats a unit of up to ``PERIODS`` bytes every string but those at
its ends starts again a unit later: it is marked as it stands, and only suffixes near
the ends are sampled, so a long line of dashes costs no more than a short one.

Defined results: a null text counts as empty; texts shorter than ``length`` keep
every byte; repeated rows are copies of each other; a null ``doc_id`` takes part
like any other.  ``kept`` is binary, since a cut may divide a character.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks, runtime
from tieout.llm.words import mix, raw_bytes, segment_any

SAMPLE_DOCS = 64
SAMPLE_KEYS = 200_000
GROUPED = 4096
PERIODS = 8
_CELL = 128
_SEEDS = "shard int, block int, n int, keys binary, several binary"
_MARKS = "block int, stage int, shard int, marks binary"
_RUNS = "stage int, target int, block int, n int, data binary"
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_HASHES = [
    (np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base)
    for s, base in ((71, 0xA0761D6478BD642F), (72, 0xE7037ED1A0B428DB))
]


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or largest) of every w values in a row."""
    fold, pad = (np.minimum, _MAX) if least else (np.maximum, np.uint64(0))
    size = len(x) - w + 1
    full = np.concatenate([x, np.full(-len(x) % w, pad, np.uint64)]).reshape(-1, w)
    ahead = fold.accumulate(full, axis=1).reshape(-1)
    behind = fold.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return fold(behind[:size], ahead[w - 1 : w - 1 + size])


class Suffixes:
    """Sampled suffix starts of a piece of documents."""

    def __init__(self, column: pa.ChunkedArray, length: int, seed: int) -> None:
        self.data, self.ends = raw_bytes(column)
        data, ends = self.data, self.ends
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        span = length - seed + 1
        self.length, self.span = length, span
        n = len(data) - seed + 1
        long = np.flatnonzero(ends - self.starts >= length)
        self.at = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        self.sure: list[tuple[int, int]] = []  # begins of strings that a periodic stretch is known to repeat
        if not len(long):
            return
        edge = np.zeros(len(data) + 1, np.int8)
        edge[self.starts[long]] += 1
        edge[ends[long] - seed + 1] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        eight = np.zeros(len(data) - 7, np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | data[i : len(data) - 7 + i]
        with np.errstate(over="ignore"):
            value = np.zeros(n, np.uint64)
            for at in (*range(0, seed - 7, 8), seed - 8):
                value = value * np.uint64(0x9FB21C651E98DF25) + (eight[at : at + n] ^ (eight[at : at + n] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            value = mix(value)
        value[~valid] = _MAX
        least = _sliding(np.concatenate([value, np.full(span - 1, _MAX, np.uint64)]), span, True)
        top = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), least]), span, False)
        chosen = valid & (value == top)
        for a, b in self._periodic():
            self.sure.append((a, b - length + 1))
            chosen[a + length + 4 * PERIODS : max(a, b - length - 4 * PERIODS)] = False
        self.at = np.flatnonzero(chosen)
        self.hash = value[self.at]
        # Half of each hash is enough here: an equal half at worst adds strings to compare.
        self.least = (least >> _32).astype(np.uint32)

    def _periodic(self) -> list[tuple[int, int]]:
        """Long stretches (begin, end) of one document that repeat a unit of 1 to PERIODS bytes."""
        out: list[tuple[int, int]] = []
        for k in range(1, PERIODS + 1):
            same = self.data[:-k] == self.data[k:]
            for back in range(k + 1):  # no stretch reaches over the end of a document
                at = self.ends - back
                same[at[(at >= 0) & (at < len(same))]] = False
            cells = same[: len(same) // _CELL * _CELL].reshape(-1, _CELL).all(axis=1)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], cells, [False]]).astype(np.int8)))
            for a, b in zip((edges[::2] * _CELL).tolist(), (edges[1::2] * _CELL).tolist()):
                if b - a >= 3 * self.length and not any(x <= a and b <= y for x, y in out):
                    out.append((a, b))
        return out

    def owned(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the chosen suffixes: start, and the range of left parts (lo..hi) of the strings they own."""
        at, value = self.at[chosen], (self.hash[chosen] >> _32).astype(np.uint32)
        doc = np.searchsorted(self.ends, at)
        lo = np.zeros(len(at), np.int64)
        hi = np.full(len(at), -1, np.int64)
        left = np.arange(self.span)
        for cut in range(0, len(at), 4096):
            a = at[cut : cut + 4096, None]
            begin = a - left
            inside = (begin >= self.starts[doc[cut : cut + 4096], None]) & (begin + self.length <= self.ends[doc[cut : cut + 4096], None])
            own = inside & (self.least[np.maximum(begin, 0)] == value[cut : cut + 4096, None])
            some = own.any(axis=1)
            lo[cut : cut + 4096] = np.argmax(own, axis=1)
            hi[cut : cut + 4096] = np.where(some, self.span - 1 - np.argmax(own[:, ::-1], axis=1), -1)
        keep = hi >= 0
        return at[keep], lo[keep], hi[keep]

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, int]]]:
        """Starts, and for each (suffix followed by the reversed bytes before it, bytes of the suffix)."""
        at, lo, hi = self.owned(chosen)
        data = self.data.tobytes()
        return at, [(data[a : a + self.length - x] + data[a - y : a][::-1], self.length - x) for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())]


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` at least."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    return at + ((n - at) * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Loser tree over sorted runs of (strings, prefix shared with the one before in the run).

    Yields (string, run, place in the run, prefix shared with the string before)
    in order.  A contender's known prefix is never compared again: of two that
    share different lengths with the last winner, the longer is the smaller.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    known = [0 if h is not None else -1 for h in head]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = head[a], head[b]
        if x is None or y is None:
            return a, b
        at = shared(x, y, known[a])
        first, second = (a, b) if x[at:] <= y[at:] else (b, a)
        known[second] = at
        return first, second

    def build(node: int) -> int:
        if node >= k:
            return node - k
        first, second = play(build(2 * node), build(2 * node + 1))
        loser[node] = second
        return first

    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        yield head[winner], winner, place[winner], known[winner]
        place[winner] += 1
        strings, prefixes = runs[winner]
        if place[winner] < len(strings):
            head[winner], known[winner] = strings[place[winner]], prefixes[place[winner]]
        else:
            head[winner], known[winner] = None, -1
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def _front_code(entries: list[tuple[bytes, int, bool]]) -> bytes:
    sizes = np.zeros((len(entries), 4), np.uint16)
    rest, last = [], b""
    for i, (key, right, several) in enumerate(entries):
        at = shared(last, key)
        sizes[i] = at, len(key), right, several
        rest.append(key[at:])
        last = key
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(rest))


def _front_decode(blob: bytes, n: int) -> tuple[list[bytes], list[int], list[int], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.uint16, n * 4).reshape(n, 4)
    prefixes, lengths, rights, several = (sizes[:, i].tolist() for i in range(4))
    keys, at, last = [], n * 8, b""
    for prefix, length in zip(prefixes, lengths):
        last = last[:prefix] + raw[at : at + length - prefix]
        at += length - prefix
        keys.append(last)
    return keys, prefixes, rights, several


def _window_hashes(keys: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every owned string of the keys: key index, left part, and two hashes (left part included in the first)."""
    data = np.frombuffer(b"".join(key[right:][::-1] + key[:right] for key, right in keys), np.uint8)
    sizes = np.fromiter((len(key) for key, _ in keys), np.int64, len(keys))
    highs = np.fromiter((len(key) - right for key, right in keys), np.int64, len(keys))
    counts = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    index = np.repeat(np.arange(len(keys)), counts)
    offset = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = highs[index] - offset
    begin = base[index] + offset
    out = []
    with np.errstate(over="ignore"):
        for table, odd in _HASHES:
            powers = np.full(len(data) + 1, odd, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            inverse = np.full(len(data) + 1, pow(odd, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            inverse = np.cumprod(inverse, dtype=np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * powers[:-1], dtype=np.uint64)])
            out.append(mix((total[begin + length] - total[begin]) * inverse[begin]))
        out[0] = mix(out[0] + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return index, left, out[0], out[1]


def _digests(keys: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every owned string of the keys: key index, left part, and its 128-bit XXH3 digest in two halves.

    The left part goes with the string, since only strings that their seed cuts alike can be equal.
    """
    index, left, digests = [], [], []
    for i, (key, right) in enumerate(keys):
        text, high, n = key[right:][::-1] + key[:right], len(key) - right, len(key) - length + 1
        index.append(np.full(n, i, np.int32))
        left.append(np.arange(high, high - n, -1, dtype=np.int16))
        digests.extend(xxhash.xxh3_128_digest(text[o : o + length], seed=high - o) for o in range(n))
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(index, np.int32), join(left, np.int16), halves[:, 0].copy(), halves[:, 1].copy()


def _in_slices(keys: list[tuple[bytes, int]], length: int, size: int = 2048):
    """_window_hashes of many keys, a slice at a time."""
    parts = [_window_hashes(keys[i : i + size], length) for i in range(0, len(keys), size)]
    parts = [(p[0].astype(np.int32) + np.int32(i * size), p[1].astype(np.int16), p[2], p[3]) for i, p in enumerate(parts)]
    kinds = (np.int32, np.int16, np.uint64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, kind), *(p[j] for p in parts)]) for j, kind in enumerate(kinds))


def _seed_rows(length: int, seed: int, n: int):
    def run(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [Suffixes(table["text"], length, seed).hash for table in blocks.documents(payloads)]
        value = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield from _packed_keys(block, _short(value, n), n)

    return run


def _short(value: np.ndarray, n: int) -> np.ndarray:
    return ((((value >> _32) * np.uint64(n)) >> _32) << _32) | (value & _LOW)


def _packed_keys(block: int, key: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    key = np.sort(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.diff(start, append=len(key)) > 1
    key = key[start]
    shards, edges = blocks.by_shard((key >> _32).astype(np.int64), n)
    cuts = [slice(edges[s], edges[s + 1]) for s in shards]
    yield pa.record_batch(
        [
            pa.array(shards, pa.int32()),
            pa.array([block] * len(shards), pa.int32()),
            pa.array([c.stop - c.start for c in cuts], pa.int32()),
            pa.array([blocks.encode_sorted((key[c] & _LOW).astype(np.uint32)) for c in cuts], pa.binary()),
            pa.array([np.packbits(several[c]).tobytes() for c in cuts], pa.binary()),
        ],
        ["shard", "block", "n", "keys", "several"],
    )


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _twice(keys: list[np.ndarray], several: list[np.ndarray]) -> list[np.ndarray]:
    """For distinct keys of each block: which of them occur twice over all blocks."""
    every = np.concatenate(keys)
    order = np.argsort(every) if every.ndim == 1 else np.lexsort((every[:, 1], every[:, 0]))
    ordered = every[order].reshape(len(every), -1)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), (ordered[1:] != ordered[:-1]).any(axis=1)]))
    times = np.diff(start, append=len(every))
    mark = np.empty(len(every), bool)
    mark[order] = np.repeat((times > 1) | np.logical_or.reduceat(np.concatenate(several)[order], start), times)
    return np.split(mark, np.cumsum([len(k) for k in keys])[:-1])


def _marks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    marks = _twice([blocks.decode_sorted(r["keys"], np.uint32) for r in rows], [_bits(r["several"], r["n"]) for r in rows])
    return _reply([(r["block"], 0, r["shard"], np.packbits(m).tobytes()) for r, m in zip(rows, marks)])


def _reply(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["block", "stage", "shard", "marks"])


class _Entries:
    """Distinct suffix keys of a block with a marked seed, in order, and where they occur."""

    def __init__(self, length: int, seed: int, n: int, payloads: list[bytes], replies: list[dict], bounds: list[bytes]) -> None:
        marks = {r["shard"]: r["marks"] for r in replies if r["stage"] == 0}
        self.pieces = [(table, Suffixes(table["text"], length, seed)) for table in blocks.documents(payloads)]
        value = np.concatenate([s.hash for _, s in self.pieces]) if self.pieces else np.zeros(0, np.uint64)
        key = _short(value, n)
        order = np.argsort(key)
        ordered = key[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1]]))
        shards, edges = blocks.by_shard((ordered[start] >> _32).astype(np.int64), n)
        mark = np.zeros(len(start), bool)
        for s in shards:
            if s in marks:
                mark[edges[s] : edges[s + 1]] = _bits(marks[s], edges[s + 1] - edges[s])
        chosen = np.empty(len(key), bool)
        chosen[order] = np.repeat(mark, np.diff(start, append=len(key)))
        where: dict[tuple[bytes, int], list[tuple[int, int]]] = {}  # piece and start of each copy
        done = 0
        for i, (_, s) in enumerate(self.pieces):
            at, keys = s.keys(np.flatnonzero(chosen[done : done + len(s.at)]))
            done += len(s.at)
            s.least = None  # the largest part; not needed any more
            for a, k in zip(at.tolist(), keys):
                where.setdefault(k, []).append((i, a))
        zone = {b[:seed] for b in bounds}
        keys = sorted(where)
        self.where = where
        self.plain = [k for k in keys if k[0][:seed] not in zone]
        self.zone = [k for k in keys if k[0][:seed] in zone]
        self.part = np.fromiter((bisect_right(bounds, k[0]) for k in self.plain), np.int64, len(self.plain))

    def zone_keys(self, length: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the owned strings of zone keys: key index, left part, shard, and digest (two columns)."""
        index, left, one, two = _digests(self.zone, length)
        return index, left, (((two >> _32) * np.uint64(n)) >> _32).astype(np.int64), np.column_stack([one, two])


def _ordered(shard: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard and digest, and where a new digest begins in it."""
    order = np.lexsort((digest[:, 1], digest[:, 0], shard))
    held, own = digest[order], shard[order]
    return order, np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1) | (np.diff(own) != 0)]))


def _packed_digests(digest: np.ndarray) -> bytes:
    first = blocks.encode_sorted(np.ascontiguousarray(digest[:, 0]))
    return len(first).to_bytes(4, "little") + first + blocks.encode(np.ascontiguousarray(digest[:, 1]))


def _unpacked_digests(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.column_stack([blocks.decode_sorted(data[4 : 4 + n], np.uint64), blocks.decode(data[4 + n :], np.uint64)])


def _runs(length: int, seed: int, n: int, bounds):
    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        entries = _Entries(length, seed, n, payloads, replies.to_pylist(), bounds.value)
        rows = []
        for part in np.unique(entries.part):
            lo, hi = np.searchsorted(entries.part, [part, part + 1])
            run = [(*k, len(entries.where[k]) > 1) for k in entries.plain[lo:hi]]
            rows.append((0, int(part), block, len(run), _front_code(run)))
        index, _, shard, value = entries.zone_keys(length, n)
        if len(value):
            many = np.fromiter((len(entries.where[k]) > 1 for k in entries.zone), bool, len(entries.zone))[index]
            order, start = _ordered(shard, value)
            value, shard, many = value[order], shard[order], many[order]
            several = (np.diff(start, append=len(value)) > 1) | np.logical_or.reduceat(many, start)
            value, shard = value[start], shard[start]
            ids, edges = blocks.by_shard(shard, n)
            for s in ids:
                cut = slice(edges[s], edges[s + 1])
                bits = np.packbits(several[cut]).tobytes()
                rows.append((1, int(s), block, int(cut.stop - cut.start), bits + _packed_digests(value[cut])))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["stage", "target", "block", "n", "data"])

    return run


def _confirmed(keys: list[tuple[bytes, int]], length: int, index: np.ndarray, left: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the owned strings (key, left part, hashes) occur twice; strings with equal hashes are compared byte by byte."""
    order = np.lexsort((two, one))
    equal = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    near = np.flatnonzero(equal)
    a, b = index[order[near]].astype(np.int64), index[order[near + 1]].astype(np.int64)
    pairs, which = np.unique(a * len(keys) + b, return_inverse=True)
    right, behind = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for i, pair in enumerate(pairs.tolist()):
        (x, m), (y, n) = keys[pair // len(keys)], keys[pair % len(keys)]
        right[i], behind[i] = shared(x[:m], y[:n]), shared(x[m:], y[n:])
    which = which.reshape(-1)
    l = left[order[near]]
    true = (l == left[order[near + 1]]) & (length - l <= right[which]) & (l <= behind[which])
    hit = np.zeros(len(order), bool)
    hit[near[true] + 1] = True
    hit[near[true]] = True
    run = np.cumsum(np.concatenate([np.ones(min(1, len(order)), bool), ~equal]))
    for r in np.unique(run[near[~true]]):  # different strings with equal hashes
        places = np.flatnonzero(run == r)
        strings = [keys[index[o]][0][keys[index[o]][1] :][: left[o]][::-1] + keys[index[o]][0][: length - left[o]] for o in order[places]]
        hit[places] = [strings.count(x) > 1 for x in strings]
    return order[hit]


def _merged(length: int, seed: int, rows: list[dict]) -> list[np.ndarray]:
    """Bits of the owned strings that repeat, for the entries of each run of one range."""
    span = length - seed + 1
    decoded = [_front_decode(r["data"], r["n"]) for r in rows]
    out = [np.zeros((r["n"], span), bool) for r in rows]
    classes: list[tuple[bytes, int]] = []
    members: list[list[tuple[int, int]]] = []
    times: list[int] = []
    common: list[int] = []  # with the class before
    last, last_right = None, -1
    for key, run, place, prefix in merge_runs([(keys, prefixes) for keys, prefixes, _, _ in decoded]):
        right = decoded[run][2][place]
        if last is None or prefix < len(key) or len(key) != len(last) or right != last_right:
            classes.append((key, right))
            members.append([])
            times.append(0)
            common.append(prefix if last is not None else 0)
        members[-1].append((run, place))
        times[-1] += 1 + decoded[run][3][place]
        last, last_right = key, right
    near = np.array(common + [0])
    reach = np.maximum(near[:-1], near[1:])
    count = np.array(times)
    rights = np.fromiter((r for _, r in classes), np.int64, len(classes))
    sizes = np.fromiter((len(k) for k, _ in classes), np.int64, len(classes))
    lo, hi = length - rights, sizes - rights
    repeat = np.zeros((len(classes), span), bool)
    column = np.arange(span)
    whole = count > 1
    repeat[whole] = (column >= lo[whole, None]) & (column <= hi[whole, None])
    # Only suffixes with a common seed can own equal strings; such groups are compared a few thousand at a time.
    open_ = np.flatnonzero(reach >= seed)
    heads = np.flatnonzero(near[open_] < seed)
    cuts = [0, *(h for h, nxt in zip(heads, heads[1:]) if h // GROUPED != nxt // GROUPED), len(open_)]
    for low, high in zip(cuts, cuts[1:]):
        group = open_[low:high]
        index, left, one, two = _in_slices([classes[i] for i in group], length)
        possible = left >= length - reach[group[index]]
        index, left, one, two = index[possible], left[possible], one[possible], two[possible]
        chosen = _confirmed([classes[i] for i in group], length, index, left, one, two)
        repeat[group[index[chosen]], left[chosen]] = True
    for i in np.flatnonzero(repeat.any(axis=1)):
        for run, place in members[i]:
            out[run][place] = repeat[i]
    return out


def _verdicts(length: int, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        stage, target = rows[0]["stage"], rows[0]["target"]
        if stage == 0:
            blobs = [zstandard.compress(np.packbits(m, axis=1).tobytes(), 3) for m in _merged(length, seed, rows)]
        else:
            sizes = [(r["n"] + 7) // 8 for r in rows]
            keys = [_unpacked_digests(r["data"][s:]) for r, s in zip(rows, sizes)]
            blobs = [np.packbits(m).tobytes() for m in _twice(keys, [_bits(r["data"][:s], r["n"]) for r, s in zip(rows, sizes)])]
        return _reply([(r["block"], stage + 1, target, blob) for r, blob in zip(rows, blobs)])

    return run


def _cut(length: int, seed: int, n: int, bounds):
    span = length - seed + 1

    def run(block: int, payloads: list[bytes], table: pa.Table) -> pa.Table:
        replies = table.to_pylist()
        entries = _Entries(length, seed, n, payloads, replies, bounds.value)
        begins: list[list[np.ndarray]] = [[] for _ in entries.pieces]

        def found(key: tuple[bytes, int], left: np.ndarray) -> None:
            for piece, at in entries.where[key]:
                begins[piece].append(at - left.astype(np.int64))

        for r in replies:
            if r["stage"] == 1:
                lo, hi = np.searchsorted(entries.part, [r["shard"], r["shard"] + 1])
                width = (span + 7) // 8
                bits = np.frombuffer(zstandard.decompress(r["marks"]), np.uint8).reshape(hi - lo, width)
                for i in np.flatnonzero(bits.any(axis=1)):
                    found(entries.plain[lo + i], np.flatnonzero(np.unpackbits(bits[i], count=span)))
        index, left, shard, value = entries.zone_keys(length, n)
        if len(value):
            order, start = _ordered(shard, value)
            _, edges = blocks.by_shard(shard[order][start], n)
            mark = np.zeros(len(start), bool)
            for r in replies:
                if r["stage"] == 2:
                    lo, hi = edges[r["shard"]], edges[r["shard"] + 1]
                    mark[lo:hi] = _bits(r["marks"], hi - lo)
            hit = np.empty(len(value), bool)
            hit[order] = np.repeat(mark, np.diff(start, append=len(value)))
            for i in np.unique(index[hit]):
                own = slice(*np.searchsorted(index, [i, i + 1]))
                found(entries.zone[i], left[own][hit[own]])
        out = []
        for (docs, s), begin in zip(entries.pieces, begins):
            flag = np.zeros(len(s.data) + 1, bool)
            if begin:
                flag[np.concatenate(begin)] = True
            for a, b in s.sure:
                flag[a:b] = True
            covered = segment_any(flag, length)
            total = np.concatenate([[0], np.cumsum(covered)])
            edge = np.concatenate([[0], np.cumsum(np.diff(covered.astype(np.int8), prepend=0) == 1)])
            data = s.data.tobytes()
            removed = total[s.ends] - total[s.starts]
            kept = []
            for a, b, gone in zip(s.starts.tolist(), s.ends.tolist(), removed.tolist()):
                kept.append(data[a:b] if not gone else s.data[a:b][~covered[a:b]].tobytes())
            out.append(
                pa.table(
                    [docs["doc_id"], pa.array(s.ends - s.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(edge[s.ends] - edge[s.starts], pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )
            )
        return pa.concat_tables(out)

    return run


def _bounds(docs: DataFrame, length: int, seed: int, n: int) -> list[bytes]:
    """Bounds of ``n`` ranges of the suffix order, from suffixes of one document in SAMPLE_DOCS.

    (Of all documents where there are few.)  They only balance the ranges.  At most
    SAMPLE_KEYS keys reach the driver.
    """
    every = max(1, min(SAMPLE_DOCS, docs.count() // 2000))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Suffixes(pa.chunked_array([batch.column(0)]), length, seed)
            _, found = s.keys(np.arange(len(s.at)))
            yield pa.record_batch([pa.array(sorted({k for k, _ in found}), pa.binary())], ["key"])

    sampled = docs.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(every)) == 0).select("text").mapInArrow(keys, "key binary")
    rows = sampled.orderBy(F.xxhash64("key"), "key").limit(min(SAMPLE_KEYS, 40 * n)).collect()
    ordered = sorted(bytes(r[0]) for r in rows)
    picked = sorted({ordered[i * len(ordered) // n] for i in range(1, n)}) if ordered else []
    return picked


def remove_repeated_bytes(docs: DataFrame, length: int = 200, seed: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    spark = docs.sparkSession
    n = runtime.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = spark.sparkContext.broadcast(_bounds(docs, length, seed, n))
    packed = blocks.pack(docs, ["doc_id", "text"], n)
    marks = blocks.per_block(packed, _seed_rows(length, seed, n), _SEEDS).groupBy("shard").applyInArrow(_marks, _MARKS)
    runs = blocks.answer(packed, marks, _runs(length, seed, n, bounds), _RUNS)
    verdicts = runs.groupBy("stage", "target").applyInArrow(_verdicts(length, seed), _MARKS)
    return blocks.answer(packed, marks.unionByName(verdicts), _cut(length, seed, n, bounds), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
