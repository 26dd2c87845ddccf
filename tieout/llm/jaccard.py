"""n-gram Jaccard join with a MinHash LSH forest.

Texts are sets of ``shingle``-word n-grams (a text of fewer words is one n-gram).
Equal sets are collapsed first: one text, with the number of its documents.  A
text is known by its set key (a 128-bit BLAKE2b digest of its n-grams, and their
number), and within the job by its place in the order of least id and key, so the
least text of a class has its least id.

1. Forest.  Each text has ``trees`` labels of ``depth`` MinHashes.  All labels are
   sorted by tree and label in one range shuffle, which cuts a hot label like any
   other run: neighbours in that order are neighbours in the tree's prefix trie,
   and the prefix they share is read off the two labels.
2. Prefixes.  How long a prefix must match is measured on all of the table's own
   texts: each gets partners at the least similarity that counts (one, or as many as
   make ``PROBES`` in a small table), in the pass that takes its labels, and matched
   prefixes are shortened one level at a time from ``depth`` on until the probes
   meet in some tree with the target recall (one miss is added to those counted).
   Texts whose labels share a prefix of that length are candidates.
3. Clusters.  Runs of the trie are chained into clusters (connected components
   over one edge per text and tree, never over pairs).
4. Refinement (with ``refine``).  A cluster of more than one tile may hang together by candidates that
   are no links, such as pages with one template.  Unless half of the pairs in a sample
   are links (then little work could be saved), its texts are cut to prefixes: the
   n-grams of a text in an order that is fixed for the cluster, rare ones first (as
   counted in about ``SAMPLE`` of its texts; any order is right, a better one only
   saves work).  Of two texts at the threshold the smaller one's index prefix and the
   larger one's probe prefix share an n-gram, so texts chained by such n-grams make
   up the clusters that go on, and no link is lost.
5. Verification.  A text moves to its cluster once per tile.  Clusters are cut into
   tiles of about ``TILE`` texts and ``TILE_GRAMS`` n-grams and each pair of tiles is
   one task, so a group with a third of all texts is spread over the cluster.  A
   tile pair compares the words of equal n-gram hashes, takes exact Jaccard
   similarities by a matrix product over the n-grams that two of its texts share,
   and emits a row per text: its links, and the least text it is chained to.
   Pairs are never emitted.

Result: one row per document with ``class_id`` (the least id of the chained
documents), ``n_links`` (other documents at the threshold or above, copies
included) and ``n_text_links`` (different texts among them).

Defined results: documents without words and rows without id link to nothing
(class_id is the own id); rows with equal ids and different texts are one node
and share a class; repeated rows count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.llm import blocks, runtime
from tieout.llm.components import SALTS, components
from tieout.llm.words import Words, exact_groups, mix, window_hash, words_of

TREES = 24
DEPTH = 8
TARGET_RECALL = 0.999
PROBES = 4000
TILE = 1024
TILE_GRAMS = 500_000
#: About so many texts, and n-grams, of a large cluster are looked at to order its n-grams.
SAMPLE = 256
SAMPLE_GRAMS = 250_000
#: A cluster is compared as it is if at least this share of its sample's pairs are links.
DENSE = 0.5
_SKETCH = "doc_id bigint, h1 bigint, h2 bigint, size int, labels array<binary>, met array<int>"


def ngrams(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of all texts: place of the first word, number of words, and two hashes."""
    count = np.diff(words.first)
    size = max(0, len(words.doc) - shingle + 1)
    at = np.flatnonzero(words.left(shingle)[:size])
    few = np.flatnonzero((count > 0) & (count < shingle))
    place = np.concatenate([at, words.first[few]])
    length = np.concatenate([np.full(len(at), shingle), count[few]])
    halves = []
    for value in (words.hash, words.twin):
        short = np.array([window_hash(value[words.first[i] : words.first[i + 1]], int(count[i]))[0] for i in few], np.uint64)
        halves.append(np.concatenate([window_hash(value, shingle)[at], short]))
    return place, length, *halves


def shingles(column: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text in order (and their other halves), and where each text's begin."""
    words = words_of(column)
    place, _, value, twin = ngrams(words, shingle)
    doc = words.doc[place]
    order = np.lexsort((twin, value, doc))
    value, twin, doc = value[order], twin[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (twin[1:] != twin[:-1]) | (doc[1:] != doc[:-1])
    value, twin, doc = value[new], twin[new], doc[new]
    return value, twin, np.searchsorted(doc, np.arange(len(words.first)))


def set_keys(value: np.ndarray, twin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The digest of each text's n-grams in two halves (0 for none)."""
    both = np.column_stack([value, twin])
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        if b > a:
            out[i] = np.frombuffer(blake2b(both[a:b].tobytes(), digest_size=16).digest(), np.uint64)
    return out


class Signer:
    """MinHashes: the least of each scrambled n-gram hash, ``trees`` x ``depth`` of them."""

    def __init__(self, trees: int, depth: int) -> None:
        random = np.random.default_rng(4)
        self.trees, self.depth = trees, depth
        self.masks = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
        self.factors = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least(self, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The MinHashes of the sets that begin at ``begin``, a row each."""
        out = np.zeros((len(begin), len(self.masks)), np.uint64)
        with np.errstate(over="ignore"):
            for i, (mask, factor) in enumerate(zip(self.masks, self.factors)):
                out[:, i] = np.minimum.reduceat((value ^ mask) * factor, begin)
        return out

    def labels(self, least: np.ndarray) -> np.ndarray:
        """16 bits of each MinHash, big endian, so that labels sort by their bytes: sets x trees x depth."""
        return (mix(least) >> np.uint64(48)).astype(">u2").reshape(-1, self.trees, self.depth)


def met_prefixes(signer: Signer, least: np.ndarray, labels: np.ndarray, size: np.ndarray, seed: np.ndarray, threshold: float, partners: int) -> np.ndarray:
    """Of each set and partner the longest prefix that they share in some tree; -1 for sets too small for a partner.

    A partner is the set and as many new n-grams as leave the similarity at the
    threshold or just above; the set's seed says which.
    """
    more = (size / threshold - size + 1e-9).astype(np.int64)
    some = np.flatnonzero(more)
    out = np.full((len(size), partners), -1, np.int32)
    if not len(some):
        return out
    more = more[some]
    begin = np.cumsum(more) - more
    step = (np.arange(more.sum()) - np.repeat(begin, more)).astype(np.uint64)
    for p in range(partners):
        base = mix(mix(seed[some]) ^ mix(np.full(1, p + 1, np.uint64)))
        with np.errstate(over="ignore"):
            new = mix(np.repeat(base, more) + step)
        equal = np.logical_and.accumulate(labels[some] == signer.labels(np.minimum(least[some], signer.least(new, begin))), axis=2)
        out[some, p] = equal.any(axis=1).sum(axis=1)
    return out


def _sketch(shingle: int, threshold: float, partners: int, trees: int, depth: int):
    signer = Signer(trees, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in blocks.pieces(pa.Table.from_batches([batch])):
                value, twin, first = shingles(table["text"], shingle)
                size = np.diff(first)
                keys = set_keys(value, twin, first)
                some = np.flatnonzero(size)
                least = signer.least(value, first[some]) if len(value) else np.zeros((0, trees * depth), np.uint64)
                labels = signer.labels(least)
                # Copies of a text get partners of their own.
                ids = pc.fill_null(table["doc_id"], 0).to_numpy().astype(np.int64).view(np.uint64)
                met = np.full((table.num_rows, partners), -1, np.int32)
                met[some] = met_prefixes(signer, least, labels, size[some], keys[some, 0] ^ mix(ids[some]), threshold, partners)
                raw = pa.Array.from_buffers(pa.binary(), len(labels) * trees, [None, pa.py_buffer(np.arange(len(labels) * trees + 1, dtype=np.int32) * np.int32(2 * depth)), pa.py_buffer(labels.tobytes())])
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, trees, 0))])
                yield pa.record_batch(
                    [
                        table["doc_id"].combine_chunks(),
                        pa.array(keys[:, 0].view(np.int64)),
                        pa.array(keys[:, 1].view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), raw),
                        pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1) * partners, pa.int32()), pa.array(met.ravel())),
                    ],
                    ["doc_id", "h1", "h2", "size", "labels", "met"],
                )

    return run


def probed(sets: list[np.ndarray], threshold: float, partners: int, trees: int, depth: int, seed: int = 0) -> np.ndarray:
    """By length 1..depth: how many (set, partner) pairs share a prefix of that length in some tree; and all pairs."""
    signer, size = Signer(trees, depth), np.array([len(s) for s in sets])
    least = signer.least(np.concatenate(sets), np.cumsum(size) - size)
    met = met_prefixes(signer, least, signer.labels(least), size, np.arange(len(sets), dtype=np.uint64) + np.uint64(seed), threshold, partners)
    return np.array([*((met >= level).sum() for level in range(1, depth + 1)), (met >= 0).sum()])


def prefix_length(met: list[int], pairs: int, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which the probes are met with the target recall."""
    depth = len(met)
    while depth > 1 and (pairs - met[depth - 1] + 1) / (pairs + 1) > 1 - target:
        depth -= 1
    return depth


def _measured(sketch: DataFrame, depth: int, target: float) -> int:
    """Prefix length from the probes of all documents; only their counts by length reach the driver."""
    rows = sketch.select(F.explode("met").alias("met")).where("met >= 0").groupBy("met").count().collect()
    met = [sum(r["count"] for r in rows if r["met"] >= level) for level in range(depth + 1)]
    # Without one pair to probe (no text of four n-grams) only the shortest prefix is safe.
    return prefix_length(met[1:], met[0], target) if met[0] else 1


_RUNS = "u bigint, v bigint, part int, tree int, label binary, text bigint"


def _chained(width: int, flagged: bool):
    """Edges of each text to the first of its run; and the first and the last row of a partition of the sorted labels.

    A run has equal first ``width`` bytes.  With ``flagged`` the next byte is a flag, and
    a run counts if it begins with flag 0.  The first run of a partition may have begun
    before it: where its own first flag is not 0, its edges carry the label they depend
    on, and end rows carry the first flag of their run within the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RUNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        first = last = None
        held = None  # tree, prefix, first text and first flag of the run that is open
        opening = True  # the open run is the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            part, tree, text = (batch.column(c).to_numpy() for c in ("part", "tree", "text"))
            label = batch.column("label")
            at = np.frombuffer(label.buffers()[1], np.int32)[label.offset : label.offset + len(label) + 1]
            rows = np.frombuffer(label.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(label), -1)
            new = np.ones(len(text), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (rows[1:, :width] != rows[:-1, :width]).any(axis=1)
            going_on = held is not None and held[0] == tree[0] and held[1] == rows[0, :width].tobytes()
            opening &= held is None or going_on
            run = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
            head = text[run]
            flag = rows[run, width] if flagged else np.zeros(len(text), np.uint8)
            if going_on:
                head = np.where(run == 0, held[2], head)
                flag = np.where(run == 0, held[3], flag)
            unsure = (run == 0) & (flag != 0) & opening
            edge = (text != head) & ((flag == 0) | unsure)
            opening &= not new[1:].any()
            held = int(tree[-1]), rows[-1, :width].tobytes(), int(head[-1]), int(flag[-1])
            tail = held[1] + bytes([held[3]]) if flagged else rows[-1].tobytes()
            first = first or (int(part[0]), int(tree[0]), rows[0].tobytes(), int(text[0]))
            last = int(part[-1]), int(tree[-1]), tail, int(text[-1])
            begun = rows[0, :width].tobytes()
            depends = pa.array([begun if u else None for u in unsure[edge]], pa.binary())
            yield pa.record_batch([pa.array(text[edge], pa.int64()), pa.array(head[edge], pa.int64()), pa.nulls(len(depends), kinds[2]), pa.nulls(len(depends), kinds[3]), depends, pa.nulls(len(depends), kinds[5])], names)
        bounds = [first, last] if first else []
        yield pa.record_batch([pa.nulls(len(bounds), kinds[0]), pa.nulls(len(bounds), kinds[1]), *(pa.array([e[i] for e in bounds], k) for i, k in enumerate(kinds[2:]))], names)

    return run


def chained(labelled: DataFrame, width: int, flagged: bool = False) -> DataFrame:
    """(u, v): texts of ``labelled`` (tree, label, text) with equal first ``width`` bytes in a tree, chained along the sorted labels.

    With ``flagged`` only where one of them has 0 in the byte that follows.
    """
    n = runtime.partitions(labelled.sparkSession)
    ordered = labelled.repartitionByRange(n, "tree", "label", "text").sortWithinPartitions("tree", "label", "text")
    runs = runtime.settled(ordered.select(F.spark_partition_id().alias("part"), "tree", "label", "text").mapInArrow(_chained(width, flagged), _RUNS))
    # Runs that go over partition bounds: two rows a partition are looked at in order.
    ends = runs.where("text is not null")
    order = W.orderBy("tree", "label", "text")
    head = lambda c: F.substring(c, 1, width)
    before = ends.select("tree", "label", "text", F.lag(F.struct("tree", "label", "text")).over(order).alias("b"))
    over = before.where((F.col("b.tree") == F.col("tree")) & (head(F.col("b.label")) == head(F.col("label")))).select(F.col("text").alias("u"), F.col("b.text").alias("v"), head(F.col("label")).alias("label"))
    within = runs.where("u is not null")
    if not flagged:
        return within.select("u", "v").unionByName(over.drop("label"))
    counts = ends.where(F.substring("label", width + 1, 1) == F.lit(b"\0")).select(head(F.col("label")).alias("label")).distinct()
    unsure = within.where("label is not null").select("u", "v", "label").unionByName(over)
    return within.where("label is null").select("u", "v").unionByName(unsure.join(F.broadcast(counts), "label", "left_semi").select("u", "v"))


def edges_of(texts: DataFrame, prefix: int) -> DataFrame:
    """(u, v): ``texts`` (text, labels) whose labels share a prefix of that length in some tree, chained."""
    return chained(texts.select("text", F.posexplode("labels").alias("tree", "label")), 2 * prefix)


def _asked(payloads: list[bytes], replies: pa.Table, shingle: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, str]]:
    """Each row of ``replies`` with the n-gram hashes of its text, their other halves, and the text."""
    wanted = {(r["h1"], r["h2"], r["size"]): r for r in replies.to_pylist()}
    ids = {r["least"] for r in wanted.values()}
    for table in blocks.documents(payloads) if wanted else ():
        chosen = table.filter(pa.array([i in ids for i in table["doc_id"].to_pylist()]))
        if not chosen.num_rows:
            continue
        value, twin, first = shingles(chosen["text"], shingle)
        keys = set_keys(value, twin, first).view(np.int64).tolist()
        for (h1, h2), a, b, text in zip(keys, first.tolist(), first[1:].tolist(), chosen["text"].to_pylist()):
            r = wanted.pop((h1, h2, b - a), None)
            if r is not None:  # else a repeated row, or another text under the same id
                yield r, value[a:b], twin[a:b], text


_SAMPLED = "cluster bigint, grams binary"
_COMMON = "cluster bigint, grams binary, times binary, share double"
_PREFIXES = "tree int, label binary, text bigint"


def _sampled(shingle: int):
    """The n-gram hashes of sampled texts."""

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        rows = [(r["cluster"], value.tobytes()) for r, value, _, _ in _asked(payloads, replies, shingle)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cluster", "grams"])

    return run


def _common(threshold: float):
    """The n-grams that a cluster's sample has more than once, how often, and the share of its pairs that are links."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        grams, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times > 1
        pairs = len(sets) * (len(sets) - 1)
        share = float(similar(sets, threshold).sum() / pairs) if pairs else 0.0
        out = [blocks.encode_sorted(grams[often]), blocks.encode(times[often].astype(np.uint32))] if often.any() else [None, None]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([o], pa.binary()) for o in out), pa.array([share])], ["cluster", "grams", "times", "share"])

    return run


def prefix_sizes(size: int, threshold: float) -> tuple[int, int]:
    """How many of a text's n-grams are in its index prefix and in its probe prefix."""
    beyond = lambda share: size - math.ceil(share * size - 1e-6) + 1
    return beyond(2 * threshold / (1 + threshold)), beyond(threshold)


def _prefixes(shingle: int, threshold: float):
    """A row for each n-gram of each text's probe prefix: its hash within the cluster, and flag 0 if in the index prefix."""

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        lists = replies.filter(replies["grams"].is_valid())
        common = {r["cluster"]: (blocks.decode_sorted(r["grams"], np.uint64), blocks.decode(r["times"], np.uint32)) for r in lists.to_pylist()}
        texts, labels = [], []
        for r, value, twin, _ in _asked(payloads, replies.filter(replies["text"].is_valid()), shingle):
            count = np.zeros(len(value), np.uint32)
            if r["cluster"] in common:
                grams, times = common[r["cluster"]]
                at = np.minimum(np.searchsorted(grams, value), len(grams) - 1)
                count = np.where(grams[at] == value, times[at], 0)
            index, probe = prefix_sizes(len(value), threshold)
            rare = value[np.lexsort((twin, value, count))[:probe]]
            label = np.zeros((len(rare), 9), np.uint8)
            with np.errstate(over="ignore"):
                label[:, :8] = mix(rare ^ mix(np.array([r["cluster"]], np.uint64))).astype(">u8").view(np.uint8).reshape(-1, 8)
            label[index:, 8] = 1
            texts.append(np.full(len(rare), r["text"], np.int64))
            labels.append(label)
        text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        raw = np.concatenate(labels).tobytes() if labels else b""
        offsets = pa.py_buffer(np.arange(len(text) + 1, dtype=np.int32) * np.int32(9))
        label = pa.Array.from_buffers(pa.binary(), len(text), [None, offsets, pa.py_buffer(raw)])
        return pa.table([pa.array(np.zeros(len(text), np.int32)), label, pa.array(text)], ["tree", "label", "text"])

    return run


def _with_tiles(clusters: DataFrame) -> DataFrame:
    """Adds ``tiles`` to the rows of each cluster; large clusters are met in SALTS tasks."""
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_GRAMS)).cast("int")
    every = F.ceil(F.greatest(F.count("*") / SAMPLE, F.sum("size") / SAMPLE_GRAMS)).cast("bigint")
    large = clusters.groupBy("cluster").agg(tiles.alias("tiles"), every.alias("every")).where("tiles > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    return salted.join(large, ["cluster", "salt"], "left").drop("salt").withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def refined(packed: DataFrame, clusters: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(text, cluster) of smaller clusters that hold every link within ``clusters``.

    Clusters of one tile, and those in whose sample at least DENSE of the pairs are
    links, stay as they are; of the others, texts that cannot link are left out.
    """
    large = clusters.where("tiles > 1")
    if large.isEmpty():
        return clusters.select("text", "cluster")
    sample = large.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.col("every")) == 0)
    common = runtime.settled(blocks.answer(packed, sample, _sampled(shingle), _SAMPLED).groupBy("cluster").applyInArrow(_common(threshold), _COMMON))
    dense = common.where(F.col("share") >= DENSE).select("cluster", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    cut = salted.where("tiles > 1").join(dense, ["cluster", "salt"], "left_anti").drop("salt")
    if cut.isEmpty():
        return clusters.select("text", "cluster")
    cut = runtime.settled(cut)
    lists = cut.select("cluster", "block").distinct().join(common.where("grams is not null").drop("share"), "cluster")
    asked = cut.drop("every", "tiles").unionByName(lists, allowMissingColumns=True)
    prefixes = runtime.settled(blocks.answer(packed, asked, _prefixes(shingle, threshold), _PREFIXES))
    parts = components(chained(prefixes, 8, flagged=True)).select(F.col("node").alias("text"), F.col("root").alias("cluster"))
    whole = salted.where("tiles > 1").join(dense, ["cluster", "salt"], "left_semi").unionByName(salted.where("tiles = 1"))
    return parts.unionByName(whole.select("text", "cluster"))


_SETS = "cluster bigint, a int, b int, side int, text bigint, copies bigint, words string"


def _sets(shingle: int):
    """Rows with the text for each tile pair of its cluster."""

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        out = []
        for r, _, _, text in _asked(payloads, replies, shingle):
            for other in range(r["tiles"]):
                a, b = sorted((r["tile"], other))
                out.append((r["cluster"], a, b, int(r["tile"] != a), r["text"], r["copies"], text))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["cluster", "a", "b", "side", "text", "copies", "words"])

    return run


_LINKS = "text bigint, links bigint, text_links bigint, root bigint"


def gram_numbers(column: pa.ChunkedArray, shingle: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as numbers: equal numbers are equal words in order."""
    words = words_of(column)
    place, length, value, _ = ngrams(words, shingle)
    padded = np.concatenate([words.ids, np.full(shingle, -1, words.ids.dtype)])
    step = np.arange(shingle)
    order, new = exact_groups(value, lambda at: np.where(step < length[at][:, None], padded[place[at][:, None] + step], -1))
    number = np.empty(len(value), np.int64)
    number[order] = np.cumsum(new) - 1
    doc = words.doc[place]
    pairs = np.unique(doc.astype(np.int64) << 32 | number)
    return np.split(pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(1, len(words.first) - 1)))


def similar(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Matrix of pairs at the threshold; with ``left`` (a mask) only between the two sides."""
    size = np.array([len(s) for s in sets], np.float64)
    text = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, text = gram[order], text[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    times = np.diff(start, append=len(gram))
    shared = np.repeat(times > 1, times)
    column = (np.cumsum(times > 1) - 1).repeat(times)[shared]
    text = text[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, (4 << 20) // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[text[lo:hi], column[lo:hi] - low] = 1
        common += part @ part.T
    either = size[:, None] + size[None, :] - common
    linked = common / np.maximum(either, 1) >= threshold
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    return linked


def _verify(threshold: float, shingle: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("text")
        side = table["side"].to_numpy()
        a, b = key[1].as_py(), key[2].as_py()
        linked = similar(gram_numbers(table["words"], shingle), threshold, side == 0 if a != b else None)
        copies = table["copies"].to_numpy()
        text = table["text"].to_numpy()
        root = np.arange(len(text))
        while True:
            near = np.minimum(root, np.where(linked, root[None, :], len(text)).min(axis=1))
            near = near[near]
            if (near == root).all():
                break
            root = near
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table(
            [
                pa.array(text[some], pa.int64()),
                pa.array((linked @ copies)[some], pa.int64()),
                pa.array(linked.sum(axis=1)[some], pa.int64()),
                pa.array(text[root[some]], pa.int64()),
            ],
            ["text", "links", "text_links", "root"],
        )

    return run


def join(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, refine: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links for every row of ``docs``; ``refine`` saves work on templated texts and changes no row."""
    n = runtime.partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partners = -(-PROBES // max(1, min(docs.count(), PROBES)))
    sketch = runtime.settled(docs.mapInArrow(_sketch(shingle, threshold, partners, trees, depth), _SKETCH))
    key = ["h1", "h2", "size"]
    grouped = sketch.where("size > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min_by("labels", "doc_id").alias("labels"))
    texts = runtime.settled(grouped.orderBy("least", *key).withColumn("text", F.monotonically_increasing_id()))
    prefix = _measured(sketch, depth, target)
    bare = texts.select("text", "least", "copies", *key, F.pmod(F.xxhash64("least"), F.lit(n)).cast("int").alias("block"))
    packed = blocks.pack(docs.where("doc_id is not null"), ["doc_id", "text"], n, F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    clusters = components(edges_of(texts, prefix)).withColumnsRenamed({"node": "text", "root": "cluster"}).join(bare, "text")
    if refine:
        clusters = runtime.settled(_with_tiles(clusters))
        clusters = _with_tiles(refined(packed, clusters, shingle, threshold).join(bare, "text"))
    else:
        tiles = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_GRAMS)).cast("int").alias("tiles"))
        clusters = clusters.join(tiles, "cluster")
    members = clusters.select("block", "text", "least", "cluster", "copies", *key, "tiles", F.pmod(F.xxhash64(F.lit(9), "text"), F.col("tiles")).cast("int").alias("tile"))
    sets = blocks.answer(packed, members, _sets(shingle), _SETS)
    links = runtime.settled(sets.groupBy("cluster", "a", "b").applyInArrow(_verify(threshold, shingle), _LINKS))
    # Texts of one id are one node: each is chained to the first of them.
    named = sketch.where("doc_id is not null").join(texts.select(*key, "text"), key).select("doc_id", "text")
    shared = named.groupBy("doc_id").agg(F.min("text").alias("first"), F.max("text").alias("last")).where("first <> last")
    same = named.join(shared, "doc_id").where("text <> first").select(F.col("text").alias("u"), F.col("first").alias("v"))
    chained = components(links.select(F.col("text").alias("u"), F.col("root").alias("v")).unionByName(same)).withColumnsRenamed({"node": "text"})
    # A class may hold most texts, so its one row is met in SALTS tasks.
    first = chained.select("root").distinct().join(texts.select(F.col("text").alias("root"), F.col("least").alias("class_id")), "root")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chained = chained.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(first, ["root", "salt"]).select("text", "class_id")
    totals = links.groupBy("text").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    classes = texts.select(*key, "text", "least", "copies").join(totals, "text", "left").join(chained, "text", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        sketch.select("doc_id", *key)
        .join(classes, [*(sketch[k] == classes[k] for k in key), sketch["doc_id"].isNotNull()], "left")
        .select(sketch["doc_id"], F.coalesce("class_id", "least", sketch["doc_id"]).alias("class_id"), zero(F.col("copies") - 1 + zero(F.col("links"))).alias("n_links"), zero(F.col("text_links")).alias("n_text_links"))
    )
