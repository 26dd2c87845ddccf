"""Feeds landed once by business date, sealed by their control totals; runs of single dates read their own folder.

Both files are parsed once, while they are written in folders of (source, business date),
and counted from there.  The seal names what the files were (path, length and time of
each part), what they declared, and the count and total of every date; it is written
last and only if the dates add up to what the files declare, so a landing that dies
leaves nothing that counts.  Files that are sealed already are not read again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import ControlTotalMismatch
from tieout.sources import ingest
from tieout.sources.files import Files, Versioned

SIDES = {"core": "core", "proc": "processor"}


class Landing:
    """The landed feeds below one root folder; the newest seal counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.seals = Files(spark), Versioned(spark, f"{self.root}/_seals")

    def _fingerprint(self, path: str) -> str:
        p, fs = self.files.at(path)
        parts = [fs.getFileStatus(p)] if fs.getFileStatus(p).isFile() else list(fs.listStatus(p))
        told = sorted(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in parts)
        return hashlib.sha256("\n".join(told).encode()).hexdigest()

    def seal(self) -> dict | None:
        return self.seals.read()[1]

    def land(self, core_path: str, events_path: str) -> dict:
        """Lands both files unless their seal is there; the seal."""
        version, sealed = self.seals.read()
        prints = {"core": self._fingerprint(core_path), "proc": self._fingerprint(events_path)}
        if sealed and sealed["prints"] == prints:
            return sealed
        passed = {"core": ingest.pass_batch(self.spark, core_path), "proc": ingest.pass_events(self.spark, events_path)}
        batch = uuid.uuid4().hex
        both = passed["core"].records.withColumn("side", F.lit("core")).unionByName(passed["proc"].records.withColumn("side", F.lit("proc")))
        both.write.partitionBy("side", "business_date").parquet(f"{self.root}/{batch}")
        got = {side: p.ingested() for side, p in passed.items()}
        days: dict[str, dict[str, dict[str, int]]] = {"core": {}, "proc": {}}
        for r in self._read(batch).groupBy("side", F.col("business_date").cast("string").alias("d")).agg(F.count("*").alias("n"), F.sum(F.abs("amount_minor")).alias("total")).collect():
            days[r["side"]][r["d"]] = {"rows": r["n"], "total": r["total"]}
        seal = {"batch": batch, "prints": prints, "days": days, "sides": {}}
        for side, g in got.items():
            landed = (sum(d["rows"] for d in days[side].values()), sum(d["total"] for d in days[side].values()))
            if landed != (g.parsed_count, g.parsed_total):
                raise ControlTotalMismatch(f"{side}: landed {landed}, parsed {(g.parsed_count, g.parsed_total)}")
            seal["sides"][side] = {"declared_count": g.declared_count, "declared_total": g.declared_total, "rejected": g.rejected}
        self.seals.swap(version, seal)
        return seal

    def _read(self, batch: str, *folders: str) -> DataFrame:
        base = f"{self.root}/{batch}"
        return self.spark.read.schema(f"{ingest.RECORD}, side string").option("basePath", base).parquet(*(f"{base}/{f}" for f in folders) if folders else (base,))

    def day(self, side: str, day: str | None) -> ingest.Ingested:
        """One side of one date (all dates without one), with the totals of its whole file; only its folder is read."""
        seal = self.seal()
        if seal is None:
            raise FileNotFoundError(f"nothing has landed in {self.root}")
        s, days = seal["sides"][side], seal["days"][side]
        if day is not None and day not in days:
            records = self.spark.createDataFrame([], ingest.RECORD)
        else:
            folder = f"side={side}" if day is None else f"side={side}/business_date={day}"
            records = self._read(seal["batch"], folder).select([c.split()[0] for c in ingest.RECORD.split(", ")])
        n, total = (sum(d[k] for d in days.values()) for k in ("rows", "total"))
        none = self.spark.createDataFrame([], "source_file string, line_no bigint, reason string")
        return ingest.Ingested(records, none, s["declared_count"], s["declared_total"], n, total, s["rejected"])

    def rows(self) -> dict[str, int]:
        """Source rows of each date, both sides, from the seal."""
        seal = self.seal()
        out: dict[str, int] = {}
        for days in (seal["days"] if seal else {}).values():
            for d, held in days.items():
                out[d] = out.get(d, 0) + held["rows"]
        return out
