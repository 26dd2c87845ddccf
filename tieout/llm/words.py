"""Vectorised words over the UTF-8 bytes of many documents at once.

Within a piece of documents a word has an exact number (``ids``): equal numbers
are equal words.  Between pieces words are told apart by a 128-bit XXH3 digest
in two halves.  Operators find candidates by digests and compare words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same rule as bytes.split() uses, so bytes.split() gives the same words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MUL = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MUL
    x ^= x >> np.uint64(32)
    x *= _MUL
    x ^= x >> np.uint64(32)
    return x


def raw_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts back to back (null: empty) with a space after each, and the end of each text."""
    texts = column.cast(pa.binary()).to_pylist()
    joined = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    return joined, np.cumsum(lengths + 1) - 1


@dataclass
class Words:
    """Words of a piece of documents: byte range, document, exact number and digest of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document: index of its first word, and of the end at last
    ids: np.ndarray  # equal numbers are equal words
    hash: np.ndarray
    twin: np.ndarray  # the other half of the digest
    distinct: pa.LargeBinaryArray  # the word of each number

    def left(self, n: int) -> np.ndarray:
        """For each word: whether n words from it on are within its document."""
        return np.arange(len(self.doc)) + n <= self.first[self.doc + 1]

    def rows(self, n: int) -> Callable[[np.ndarray], np.ndarray]:
        """The numbers of the n words from each place on, as rows."""
        step = np.arange(n)
        return lambda at: self.ids[at[:, None] + step]


#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """The words of a dictionary as bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    raw = words.buffers()[2].to_pybytes() if len(words) else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def digests(words: list[bytes], key: int = 0) -> np.ndarray:
    """128-bit XXH3 digests, two 64-bit halves in a row each."""
    raw = b"".join([xxh3_128_digest(w, key) for w in words])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def words_of(column: pa.ChunkedArray, hashed: bool = True, between: np.ndarray = _SPACE, key: int = 0) -> Words:
    """Maximal runs of bytes that are not ``between`` words (white space), per document."""
    data, ends = raw_bytes(column)
    space = between[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[end > 0] if len(end) and end[0] == 0 else end
    doc = np.searchsorted(ends, start, side="left")
    first = np.searchsorted(doc, np.arange(len(ends) + 1))
    ids, value, distinct = np.zeros(0, np.int32), np.zeros((0, 2), np.uint64), pa.array([], pa.large_binary())
    if hashed and len(start):
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        every = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
        encoded = every.dictionary_encode()
        ids, distinct = encoded.indices.to_numpy(), encoded.dictionary
        value = digests(listed(distinct), key)[ids]
    return Words(data, start, end, doc, first, ids, value[:, 0], value[:, 1], distinct)


def window_hash(value: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes (a multilinear form of the words in order)."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    size = len(value) - n + 1
    factors = np.random.default_rng([20260302, seed]).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += value[i : i + size] * factors[i]
        return mix(out + np.uint64(n + seed))


def exact_groups(value: np.ndarray, rows: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal items are neighbours, and where another item than the one before begins.

    ``value`` is a hash of each item; ``rows`` gives what the items at some places
    really are.  Items with equal hashes are compared, and told apart if they differ.
    """
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    near = np.flatnonzero(ordered[1:] == ordered[:-1])
    new = np.ones(len(order), bool)
    new[near + 1] = False
    wrong = near[(rows(order[near]) != rows(order[near + 1])).any(axis=1)] if len(near) else near
    for hashed in np.unique(ordered[wrong]):
        cut = slice(np.searchsorted(ordered, hashed), np.searchsorted(ordered, hashed, side="right"))
        _, own = np.unique(rows(order[cut]), axis=0, return_inverse=True)
        by = np.argsort(own.reshape(-1), kind="stable")
        order[cut] = order[cut][by]
        new[cut] = np.diff(own.reshape(-1)[by], prepend=-1) != 0
    return order, new


def segment_any(flag: np.ndarray, n: int) -> np.ndarray:
    """For each i: whether any of flag[i - n + 1 .. i] holds."""
    total = np.concatenate([[0], np.cumsum(flag)])
    at = np.arange(1, len(flag) + 1)
    return total[at] - total[np.maximum(at - n, 0)] > 0
