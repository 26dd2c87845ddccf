"""The reporting mart: date-partitioned Parquet tables, aggregates that tie to their facts, and snapshots.

Data folders are written once, under names nobody reads yet, and never moved or changed.
What a table holds is said by a manifest: for each table and business date one folder
and its number of rows.  A commit writes its folders first and one manifest last, whole
and under a number that must not be taken, so facts, breaks and aggregates of a date
change in one step; a commit that dies leaves folders that no manifest names.  Readers
take one manifest and repair nothing.  Two writers of different dates both succeed, the
second on top of the first; of two writers of one date the second is refused.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import Conflict
from tieout.functions.calendar import tier
from tieout.sources.files import Files, Versioned

FACTS = {
    "fct_source_record": "ref string, account string, amount_minor bigint, currency string, kind string, source_system string, source_file string, source_line bigint, business_date date",
    "fct_break": "ref string, break_type string, status string, core_amount bigint, proc_amount bigint, variance_minor bigint, age_days bigint, tier string, business_date date",
    "agg_daily_settlement": "currency string, source_system string, record_count bigint, net_minor bigint, gross_minor bigint, business_date date",
}


def fact_records(core: DataFrame, proc: DataFrame) -> DataFrame:
    both = core.unionByName(proc)
    return both.select("ref", "account", "amount_minor", "currency", "kind", F.col("source").alias("source_system"), "source_file", F.col("line_no").alias("source_line"), "business_date")


def fact_breaks(breaks: DataFrame) -> DataFrame:
    return breaks.select("ref", "break_type", "status", "core_amount", "proc_amount", (F.col("core_amount") - F.col("proc_amount")).alias("variance_minor"), "age_days", tier(F.col("age_days")).alias("tier"), "business_date")


def daily_settlement(records: DataFrame) -> DataFrame:
    return records.groupBy("currency", "source_system", "business_date").agg(F.count("*").alias("record_count"), F.sum("amount_minor").alias("net_minor"), F.sum(F.abs("amount_minor")).alias("gross_minor")).select(
        "currency", "source_system", "record_count", "net_minor", "gross_minor", "business_date"
    )


def monthly_report(cells: DataFrame, month: str | None = None) -> DataFrame:
    """All daily cells (of a month ``yyyy-MM`` if given) in order."""
    if month:
        cells = cells.where(F.date_format("business_date", "yyyy-MM") == month)
    return cells.orderBy("business_date", "currency", "source_system")


def drill_down(records: DataFrame, day: str, currency: str, source: str) -> DataFrame:
    """The records of one cell by line; the date prunes partitions."""
    d = F.lit(day).cast("date")
    return records.where((F.col("business_date") == d) & (F.col("currency") == currency) & (F.col("source_system") == source)).select("ref", "account", "amount_minor", "source_file", "source_line").orderBy("source_line")


def verify_cells(cells: DataFrame, records: DataFrame) -> DataFrame:
    keys = ["business_date", "currency", "source_system"]
    again = records.groupBy(*keys).agg(F.count("*").alias("drill_count"), F.sum("amount_minor").alias("drill_minor"))
    ties = F.coalesce((F.col("record_count") == F.col("drill_count")) & (F.col("net_minor") == F.col("drill_minor")), F.lit(False))
    return cells.join(again, keys, "left").select(*keys, "record_count", "net_minor", "drill_count", "drill_minor", ties.alias("ties"))


def break_summary(breaks: DataFrame) -> DataFrame:
    return breaks.groupBy("break_type", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.abs("variance_minor")), F.lit(0)).alias("variance_minor")).orderBy(F.desc("n"), "break_type")


def control_totals(records: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: facts against aggregates."""
    facts = records.agg(F.count("*").alias("fact_count"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("fact_minor"))
    sums = cells.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("agg_count"), F.coalesce(F.sum("net_minor"), F.lit(0)).alias("agg_minor"))
    return facts.join(sums, F.lit(True)).withColumn("ties", (F.col("fact_count") == F.col("agg_count")) & (F.col("fact_minor") == F.col("agg_minor")))


def render(view: View, day: str, limit: int = 6) -> str:
    """The first cells of a date, and the first records of the first one, as text."""
    cells = monthly_report(view.table("agg_daily_settlement").where(_day(day))).limit(limit).collect()
    lines = [f"{c['currency']} {c['source_system']:<10} {c['record_count']:>8} {c['net_minor'] / 100:>16,.2f}" for c in cells]
    for c in cells[:1]:
        records = drill_down(view.table("fct_source_record"), day, c["currency"], c["source_system"]).limit(limit).collect()
        lines += [f"  {r['source_file']}:{r['source_line']} {r['ref']} {r['amount_minor'] / 100:,.2f}" for r in records]
    return "\n".join(lines)


def snapshot(records: DataFrame, breaks: DataFrame) -> DataFrame:
    """Per business date: source rows and amount, breaks and variance (nulls as 0)."""
    r = records.groupBy("business_date").agg(F.count("*").alias("source_rows"), F.sum("amount_minor").alias("source_minor"))
    b = breaks.groupBy("business_date").agg(F.count("*").alias("breaks"), F.coalesce(F.sum("variance_minor"), F.lit(0)).alias("variance_minor"))
    return r.join(b, "business_date", "full_outer").na.fill(0)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What moved between two snapshots, in long form: date, metric, before, after, state."""
    metrics = ["source_rows", "source_minor", "breaks", "variance_minor"]
    stack = f"stack({len(metrics)}, " + ", ".join(f"'{m}', {m}" for m in metrics) + ") as (metric, value)"
    long = lambda df, name: df.selectExpr("business_date", stack).withColumnRenamed("value", name)
    joined = long(before, "before").join(long(after, "after"), ["business_date", "metric"], "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "unchanged").otherwise("moved")
    return joined.withColumn("state", state)


def _day(day: str):
    return F.col("business_date") == F.lit(day).cast("date")


class View:
    """The tables as one manifest has them, whatever is committed later."""

    def __init__(self, mart: Mart, version: int, tables: dict[str, dict[str, dict]]) -> None:
        self.mart, self.version, self.tables = mart, version, tables

    def table(self, name: str) -> DataFrame:
        """The table; empty (with its schema) if no date holds rows.  Read errors are raised."""
        folders = [f"{self.mart.root}/{e['folder']}" for e in self.tables.get(name, {}).values()]
        if not folders:
            return self.mart.spark.createDataFrame([], FACTS[name])
        return self.mart.read(name, folders)

    def rows(self, name: str) -> dict[str, int]:
        """Rows of each date, from the manifest."""
        return {day: e["rows"] for day, e in sorted(self.tables.get(name, {}).items())}

    def snapshot_for(self, day: str) -> dict:
        row = snapshot(self.table("fct_source_record").where(_day(day)), self.table("fct_break").where(_day(day))).first()
        return row.asDict() if row else {"business_date": day, "source_rows": 0, "source_minor": 0, "breaks": 0, "variance_minor": 0}


class Stage:
    """A commit in the making: its folders are written, and nothing of it is visible before ``publish``."""

    def __init__(self, mart: Mart, days: list[str] | None = None) -> None:
        """``days`` are replaced whole, also where no row is left; by default the dates that the rows have."""
        self.mart, self.days, self.base = mart, days, mart.view()
        self.changes: dict[str, dict[str, dict | None]] = {}

    def put(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Writes what the dates of a table become; gives the number of rows they had."""
        batch = uuid.uuid4().hex
        rows = rows.select([c.split()[0] for c in FACTS[name].split(", ")]).where("business_date is not null")
        if self.days is not None:
            rows = rows.where(F.col("business_date").isin([date.fromisoformat(d) for d in self.days]))
        if name == "fct_break":
            rows = rows.hint("rebalance", "business_date")  # else each of its many small tasks would write a file a date
        rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("business_date", "batch").parquet(f"{self.mart.root}/{name}")
        entries: dict[str, dict | None] = dict.fromkeys(self.days or ())
        folders = [f"{name}/{d}/batch={batch}" for d in self.mart.files.names(f"{self.mart.root}/{name}") if d.startswith("business_date=") and self.mart.files.exists(f"{self.mart.root}/{name}/{d}/batch={batch}")]
        if folders:
            counted = self.mart.read(name, [f"{self.mart.root}/{f}" for f in folders]).groupBy(F.col("business_date").cast("string").alias("d")).count()
            rows_of = {r["d"]: r["count"] for r in counted.collect()}
            entries |= {(d := f.split("/")[1].split("=")[1]): {"folder": f, "rows": rows_of[d]} for f in folders}
        self.changes[name] = entries
        had = self.base.rows(name)
        return {d: had.get(d, 0) for d in sorted(entries)}

    def aggregate(self) -> dict[str, int]:
        """Rebuilds the aggregates of the dates whose records this commit replaces."""
        written = [f"{self.mart.root}/{e['folder']}" for e in self.changes["fct_source_record"].values() if e]
        records = self.mart.read("fct_source_record", written) if written else self.mart.spark.createDataFrame([], FACTS["fct_source_record"])
        out = self.put("agg_daily_settlement", daily_settlement(records))
        gone = {d: None for d in self.changes["fct_source_record"]}
        self.changes["agg_daily_settlement"] = gone | self.changes["agg_daily_settlement"]
        return {d: self.base.rows("agg_daily_settlement").get(d, 0) for d in gone} | out

    def view(self) -> View:
        """The tables as they will be."""
        return View(self.mart, self.base.version, self._over(self.base.tables))

    def _over(self, tables: dict) -> dict:
        out = {name: dict(days) for name, days in tables.items()}
        for name, entries in self.changes.items():
            held = out.setdefault(name, {})
            for day, entry in entries.items():
                held.pop(day, None)
                if entry:
                    held[day] = entry
        return out

    def publish(self) -> int:
        """Writes the manifest; the version it made.  Refused if a date was committed by another meanwhile."""
        if not self.changes:
            return self.base.version
        while True:
            now = self.mart.view()
            for name, entries in self.changes.items():
                for day in entries:
                    if now.tables.get(name, {}).get(day) != self.base.tables.get(name, {}).get(day):
                        raise Conflict(f"{name} {day} was committed by another writer")
            try:
                return self.mart.manifest.swap(now.version, {"tables": self._over(now.tables)})
            except Conflict:
                continue  # somebody was first; perhaps with other dates


class Mart:
    """The tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.manifest = Files(spark), Versioned(spark, f"{self.root}/_manifest")

    def read(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{FACTS[name]}, batch string").option("basePath", f"{self.root}/{name}").parquet(*folders).drop("batch")

    def view(self, version: int | None = None) -> View:
        """The newest manifest, or a version that was kept."""
        version, value = self.manifest.read(version)
        return View(self, version, value["tables"] if value else {})

    def stage(self, days: list[str] | None = None) -> Stage:
        return Stage(self, days)

    def table(self, name: str) -> DataFrame:
        return self.view().table(name)

    def replace(self, name: str, day: str, rows: DataFrame) -> int:
        """Makes ``rows`` the whole of a business date in one table; gives the number of rows that were there."""
        stage = self.stage([day])
        had = stage.put(name, rows)
        stage.publish()
        return had[day]

    def load(self, name: str, rows: DataFrame, days: list[str] | None = None) -> dict[str, int]:
        """Replaces every date that ``rows`` has, in one job, or just ``days`` (those without rows are dropped)."""
        stage = self.stage(days)
        had = stage.put(name, rows)
        stage.publish()
        return had

    def load_days(self, days: list[str] | None, records: DataFrame, breaks: DataFrame) -> dict[str, dict[str, int]]:
        """Replaces dates in the fact tables with their aggregates, all at once; what was replaced."""
        stage = self.stage(days)
        gone = {"fct_source_record": stage.put("fct_source_record", records), "fct_break": stage.put("fct_break", breaks)}
        gone["agg_daily_settlement"] = stage.aggregate()
        stage.publish()
        return gone

    def rows_for(self, name: str, day: str) -> int:
        return self.view().rows(name).get(day, 0)

    def rows_by_date(self, name: str = "fct_source_record") -> DataFrame:
        return self.table(name).groupBy("business_date").agg(F.count("*").alias("n_rows"))

    def dates(self, name: str = "fct_source_record") -> DataFrame:
        return self.table(name).select("business_date").distinct().orderBy("business_date")

    def vacuum(self, keep: int = 10, older_than_hours: float = 24) -> int:
        """Deletes all but the newest manifests, and data folders that none of these names; the number of folders.

        Folders younger than the limit may belong to a commit in the making and stay.
        """
        newest = self.manifest.version()
        named = {e["folder"] for v in range(max(1, newest - keep + 1), newest + 1) for days in self.view(v).tables.values() for e in days.values()}
        gone = 0
        for name in FACTS:
            for day in self.files.names(f"{self.root}/{name}"):
                for batch in self.files.names(f"{self.root}/{name}/{day}"):
                    folder = f"{name}/{day}/{batch}"
                    if batch.startswith("batch=") and folder not in named and self.files.age_ms(f"{self.root}/{folder}") > older_than_hours * 3_600_000:
                        self.files.delete(f"{self.root}/{folder}")
                        gone += 1
        self.manifest.forget(keep)
        return gone
