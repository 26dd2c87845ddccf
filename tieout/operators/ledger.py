"""Append-only event tables and their fold to current state.

There is no update path: state is a fold over events, so a first sighting keeps
its date, and history is the table itself.  A batch of events is a folder of its own and
a tree of digests over it: level 0 holds the digest of every row, and a node of a higher
level is the digest of up to ``FANOUT`` nodes below.  The seal, written last and under a
number that must not be taken, holds the root of the tree, what the batch's files look
like, and a digest over itself and the seal before; events without a seal do not count,
and of two writers who have read the same events one is refused.

An append looks at the files of every batch, the chain of seals and the rows of the
newest batch before it adds; ``audit`` looks at all rows, and names those that changed
by reading level 0 only where a node above differs.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.errors import Conflict, LedgerTampered
from tieout.sources.files import Files, Versioned

GENESIS = "0" * 64
FANOUT = 1024


def digest_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Adds row_hash: SHA-256 over the canonical JSON of the columns."""
    return events.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes (batch, node, digest); a group never holds more than FANOUT of them."""
    held = F.array_sort(F.collect_list(F.struct("node", "digest")))
    told = F.concat_ws("", F.transform(held, lambda n: F.concat(n["node"].cast("string"), F.lit(":"), n["digest"], F.lit(";"))))
    return nodes.groupBy("batch", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(told, 256).alias("digest"))


class Ledger:
    """One event table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
        self.files, self.seals = Files(spark), Versioned(spark, f"{self.root}/seals")

    def version(self) -> int:
        """The number of sealed batches."""
        return self.seals.version()

    def batches(self, version: int | None = None) -> list[dict]:
        value = self.seals.read(version)[1]
        return value["batches"] if value else []

    def events(self, version: int | None = None) -> DataFrame:
        """(event_id, columns, row_hash, batch) of all sealed batches, or of the first ``version``."""
        schema = f"event_id bigint, {self.schema}, row_hash string, batch int, draft string"
        held = self.batches(version)
        if not held:
            return self.spark.createDataFrame([], schema).drop("draft")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/events").parquet(*(self._folder("events", b) for b in held)).drop("draft")

    def _folder(self, kind: str, batch: dict) -> str:
        return f"{self.root}/{kind}/batch={batch['batch']}/draft={batch['draft']}"

    def _tree(self, held: list[dict]) -> DataFrame:
        schema = "level int, node bigint, digest string, batch int, draft string"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/tree").parquet(*(self._folder("tree", b) for b in held)).drop("draft")

    def _looks(self, folder: str) -> str:
        """What the files of a folder look like from outside."""
        p, fs = self.files.at(folder)
        told = sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p)) if fs.exists(p) else []
        return hashlib.sha256("\n".join(told).encode()).hexdigest()

    def append(self, rows: DataFrame, order: list[str], expected: int | None = None) -> int:
        """Numbers the rows after the last event in the given order and appends them as one batch.

        ``expected`` is the version that led to these rows; if there are more batches by now, ``Conflict`` is raised.
        """
        version = self.version()
        if expected not in (None, version):
            raise Conflict(f"{self.root} has {version} batches, not {expected}")
        held = self.batches(version)
        self._check(held)
        batch = {"batch": version, "draft": uuid.uuid4().hex, "first": held[-1]["first"] + held[-1]["n"] if held else 1}
        ranged = rows.select(*self.columns).repartitionByRange(*order).sortWithinPartitions(*order)
        # Row numbers over all partitions: rows of the partitions before, plus the place in the own one.
        placed = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
        staging = f"{self.root}/_staging/{batch['draft']}"
        placed.write.parquet(staging)
        placed = self.spark.read.parquet(staging)
        ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
        offsets = placed.groupBy("_p").agg(F.count("*").alias("count"), F.min("_m").alias("_first")).select("_p", "_first", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
        number = F.col("_m") - F.col("_first") + F.col("ahead") + batch["first"]
        numbered = digest_rows(placed.join(offsets, "_p").withColumn("event_id", number.cast("bigint")), ["event_id", *self.columns])
        numbered.select("event_id", *self.columns, "row_hash").write.parquet(self._folder("events", batch))
        self.files.delete(staging)
        batch["n"] = self.spark.read.parquet(self._folder("events", batch)).count()
        if not batch["n"]:
            self.files.delete(self._folder("events", batch))
            return 0
        batch["root"] = self._grow(batch)
        batch["files"] = self._looks(self._folder("events", batch))
        batch["seal"] = self._seal(held[-1]["seal"] if held else GENESIS, batch)
        self.seals.swap(version, {"batches": [*held, batch]})
        return batch["n"]

    def _grow(self, batch: dict) -> str:
        """Writes the levels of a batch's tree; its root."""
        rows = self.spark.read.parquet(self._folder("events", batch)).select((F.col("event_id") - batch["first"]).alias("node"), F.col("row_hash").alias("digest")).withColumn("batch", F.lit(batch["batch"]))
        shown = lambda nodes, level: nodes.select(F.lit(level).alias("level"), "node", "digest")
        shown(rows, 0).unionByName(shown(parents(rows), 1)).write.parquet(self._folder("tree", batch))
        level, width = 1, -(-batch["n"] // FANOUT)
        while width > 1:
            shown(parents(self._tree([batch]).where(F.col("level") == level)), level + 1).write.mode("append").parquet(self._folder("tree", batch))
            level, width = level + 1, -(-width // FANOUT)
        return self._tree([batch]).where(F.col("level") == level).first()["digest"]

    @staticmethod
    def _seal(before: str, batch: dict) -> str:
        told = "|".join([before, *(str(batch[k]) for k in ("batch", "first", "n", "root"))])
        return hashlib.sha256(told.encode()).hexdigest()

    def _check(self, held: list[dict]) -> None:
        """Raises if a seal, a file or a row of the newest batch is not what was sealed."""
        before = GENESIS
        for b in held:
            before = self._seal(before, b)
            if before != b["seal"]:
                raise LedgerTampered(f"the seal of batch {b['batch']} does not fit the one before")
            if self._looks(self._folder("events", b)) != b["files"]:
                raise LedgerTampered(f"the files of batch {b['batch']} are not those that were sealed")
        if held and self._root_now(held[-1]) != held[-1]["root"]:
            self._named(self.changes(held[-1:]))
            raise LedgerTampered(f"the newest batch {held[-1]['batch']} does not fit its seal")

    def _rows(self, held: list[dict]) -> DataFrame:
        """(batch, node, digest) of the rows as they are."""
        schema = f"event_id bigint, {self.schema}, row_hash string, batch int, draft string"
        events = self.spark.read.schema(schema).option("basePath", f"{self.root}/events").parquet(*(self._folder("events", b) for b in held))
        first = self.spark.createDataFrame([(b["batch"], b["first"]) for b in held], "batch int, first bigint")
        rows = digest_rows(events.drop("row_hash"), ["event_id", *self.columns]).join(F.broadcast(first), "batch")
        return rows.select("batch", (F.col("event_id") - F.col("first")).alias("node"), F.col("row_hash").alias("digest"))

    def _root_now(self, batch: dict) -> str | None:
        nodes, width = self._rows([batch]), batch["n"]
        while True:
            nodes, width = parents(nodes), -(-width // FANOUT)
            if width == 1:
                found = nodes.limit(2).collect()
                return found[0]["digest"] if len(found) == 1 else None

    def changes(self, held: list[dict] | None = None) -> DataFrame:
        """(batch, event_id, change) of events that differ from what was sealed: changed, gone or added.

        Digests of the rows as they are are compared by nodes of level 1; level 0 is read for nodes that differ.
        """
        held = self.batches() if held is None else held
        if not held:
            return self.spark.createDataFrame([], "batch int, event_id bigint, change string")
        now = self._rows(held)
        tree = self._tree(held)
        old = lambda level: tree.where(F.col("level") == level).select("batch", "node", F.col("digest").alias("sealed"))
        leaves = parents(now).join(old(1), ["batch", "node"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("sealed"))).select("batch", F.col("node").alias("leaf"))
        inside = lambda df: df.withColumn("leaf", F.floor(F.col("node") / FANOUT)).join(leaves, ["batch", "leaf"], "left_semi").drop("leaf")
        both = inside(now).join(inside(old(0)), ["batch", "node"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("sealed")))
        change = F.when(F.col("digest").isNull(), "gone").when(F.col("sealed").isNull(), "added").otherwise("changed")
        first = self.spark.createDataFrame([(b["batch"], b["first"]) for b in held], "batch int, first bigint")
        return both.join(F.broadcast(first), "batch").select("batch", (F.col("node") + F.col("first")).alias("event_id"), change.alias("change"))

    def _named(self, changes: DataFrame) -> None:
        found = changes.orderBy("batch", "event_id").limit(5).collect()
        if found:
            raise LedgerTampered("; ".join(f"event {r['event_id']} of batch {r['batch']} was {r['change']}" for r in found))

    def audit(self) -> int:
        """Number of events; raises if a row, a tree or a seal is not what was written, and names rows."""
        held, before = self.batches(), GENESIS
        if not held:
            return 0
        self._named(self.changes(held))
        level, nodes = 1, parents(self._tree(held).where("level = 0"))
        roots = {}
        while len(roots) < len(held):
            single = [b["batch"] for b in held if -(-b["n"] // FANOUT**level) == 1 and b["batch"] not in roots]
            roots |= {r["batch"]: r["digest"] for r in nodes.where(F.col("batch").isin(single) & (F.col("node") == 0)).collect()} if single else {}
            roots |= {b: None for b in single if b not in roots}
            level, nodes = level + 1, parents(nodes)
        for b in held:
            if roots[b["batch"]] != b["root"]:
                raise LedgerTampered(f"the tree of batch {b['batch']} does not fit its seal")
            before = self._seal(before, b)
            if before != b["seal"]:
                raise LedgerTampered(f"the seal of batch {b['batch']} does not fit the one before")
        return sum(b["n"] for b in held)


def current(events: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The latest values of ``columns`` for each key."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), "event_id").alias("s")).select(*key, "s.*")
