"""The prefix trie of conversations, with totals of every subtree, by peeling leaves.

Texts never move: a turn is the SHA-256 of its role and text, and a node is the
chained digest of the turns that lead to it.  One shuffle brings a conversation
and the one it starts from together; nodes are then counts over (digest, depth).

Nodes form chains: a chain is the nodes of one owner, the conversation with the least
hash among a node's members.  Members of a node below are members of all above it, so
an owner's nodes are consecutive, and hashes make an owner random: a path from a leaf
to the root crosses O(log n) chains, however deep the trie is.  A chain holds a counter
of the chains that hang below it and have not reported; a chain whose counter is zero
sends its totals to the node it hangs on, and so on until only the root's chain is left.
Within a chain totals are one running sum from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.llm import runtime

#: A conversation starts with up to REACH - 1 turns of the first of its family of FAMILY ids.
FAMILY, REACH = 5, 9
_ROWS = 20_000
_PIECE = 64 << 10
_STEPS = "conv_id bigint, depth bigint, key binary, prev binary, n_bytes bigint, ends boolean"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _turn_key() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that each rebuilt conversation passes, of turns sorted by family, the family's first conversation ahead."""
    out: list[tuple] = []
    held: list[tuple] = []  # the newest node, whose ``ends`` is not known yet
    family = conv = None
    start: list[tuple[bytes, int]] = []
    place = depth = 0

    def step(key: bytes, size: int) -> None:
        nonlocal depth
        _, _, prev, _, _ = held[0]
        out.append((*held.pop(), False))
        depth += 1
        held.append((conv, depth, hashlib.sha256(prev + key).digest(), prev, size))

    def opened() -> None:
        nonlocal place, depth
        place, depth = 0, 0
        held.append((conv, 0, b"", b"", 0))

    def closed() -> None:
        if held:
            out.append((*held.pop(), True))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _STEPS.split(", ")])

    for batch in batches:
        for f, c, reach, key, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if c != conv:
                closed()
                if f != family:
                    family, start = f, []
                conv = c
                opened()
                if c != f:
                    for k, n in start[:reach]:
                        step(k, n)
            place += 1
            if c == f:
                if place < REACH:
                    start.append((key, size))
                step(key, size)
            elif place > reach:
                step(key, size)
            if len(out) >= _ROWS:
                yield flush()
    closed()
    if out:
        yield flush()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, key, prev, n_bytes, ends): every node on the way of every rebuilt conversation."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = turns.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % REACH).cast("int").alias("reach"), _turn_key().alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes"), "turn", "role"
    )
    ordered = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "key")
    return ordered.drop("turn", "role").mapInArrow(_steps, _STEPS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids as text, in pieces."""
    key, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size >= _PIECE:
                if ids:
                    yield piece()
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its pieces in order, none held but the current one."""
    key, running = None, None
    done: list[tuple[bytes, str]] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1])], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(done) >= _ROWS:
            yield flush()
    if running is not None:
        done.append((key, running.hexdigest()))
    if done:
        yield flush()


def ends_of(steps: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids that end at a node, ascending; a node's ids are joined in pieces by many tasks."""
    ids = steps.where("ends").select("key", "conv_id")
    pieces = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first bigint, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def peel(chains: DataFrame) -> DataFrame:
    """Totals of whole chains: (chain, parent_chain, parent_depth, saved, leaves), of rows with counters (remaining).

    ``saved`` and ``leaves`` come in as a chain's own; a chain without a parent ends the work.
    """
    state, finished = runtime.settled(chains), []
    while True:
        ready = state.where("remaining = 0")
        finished.append(ready.drop("remaining"))
        waiting = state.where("remaining > 0")
        if waiting.isEmpty():
            break
        said = ready.groupBy(F.col("parent_chain").alias("chain")).agg(F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        heard = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
        state = runtime.settled(
            waiting.join(said, "chain", "left").select("chain", "parent_chain", "parent_depth", (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining"), heard("saved", "more_saved"), heard("leaves", "more_leaves"))
        )
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node (``NODE``), the textless root included.

    Turns are ordered by ``turn``, null first; ties by role, then by the digest of the
    turn; equal rows are turns of their own.  Rows without conv_id belong to no
    conversation and are left out; null role and text are empty; other columns are
    ignored.  An empty table has no root, as nothing is a member of it: no rows.
    """
    steps = runtime.settled(rebuilt(conversations))
    counted = steps.groupBy("depth", "key", "prev", "n_bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.xxhash64("conv_id")).alias("chain"))
    nodes = runtime.settled(counted.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")))
    root = nodes.where("depth = 0").first()
    if root is None:
        return conversations.sparkSession.createDataFrame([], NODE)
    whole = nodes.groupBy("chain").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("saved"), F.min_by("prev", "depth").alias("prev"))
    # Nodes on the root are many, and what they hang on is known; others look it up.
    on_root = {"parent_chain": F.when(F.col("top") == 1, F.lit(root["chain"])), "parent_depth": F.when(F.col("top") == 1, F.lit(0).cast("bigint")), "parent_conv_id": F.when(F.col("top") == 1, F.lit(root["conv_id"]))}
    above = nodes.where("depth > 0").select(F.col("key").alias("prev"), F.col("chain").alias("parent_chain"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent_conv_id"))
    whole = runtime.settled(whole.where("top <= 1").withColumns(on_root).unionByName(whole.where("top > 1").join(above, "prev")))
    hung = whole.where("top > 0").groupBy(F.col("parent_chain").alias("chain")).agg(F.count("*").alias("remaining"), F.max("parent_depth").alias("last"))
    leaf = F.when(F.coalesce(F.col("last") < F.col("bottom"), F.lit(True)), 1).otherwise(0).cast("bigint")
    totals = peel(whole.join(hung, "chain", "left").select("chain", "parent_chain", "parent_depth", F.coalesce("remaining", F.lit(0)).alias("remaining"), "saved", leaf.alias("leaves")))
    heard = totals.where("parent_chain is not null").groupBy(F.col("parent_chain").alias("chain"), F.col("parent_depth").alias("depth")).agg(F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    tops = whole.where("top > 0").select("chain", F.col("top").alias("depth"), "parent_conv_id")
    upwards = W.partitionBy("chain").orderBy(F.desc("depth"))
    below = upwards.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = nodes.join(heard, ["chain", "depth"], "left").join(tops, ["chain", "depth"], "left").withColumns(
        {"n_children": F.coalesce("n", F.lit(0)) + F.when(F.lag("depth").over(upwards).isNull(), 0).otherwise(1), "over_conv_id": F.lead("conv_id").over(upwards)}
    )
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("more_leaves", F.lit(0)))
    summed = placed.select(
        "key", "conv_id", "depth", F.coalesce("over_conv_id", "parent_conv_id").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        F.sum(leaves).over(below).alias("n_leaves"), F.sum(F.col("own") + F.coalesce("more_saved", F.lit(0))).over(below).alias("saved_tokens"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends_of(steps), "key", "left").select(*[c.split()[0] for c in NODE.split(", ")][:-1], F.coalesce("ends_sha256", none).alias("ends_sha256"))
