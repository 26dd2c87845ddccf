"""The daily pipeline: ingest, validate, reconcile, queue, mart, aggregates, tie-out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import ControlTotalMismatch, Permanent, Transient
from tieout.operators import mart as m
from tieout.operators import matching
from tieout.operators.breakqueue import BreakQueue
from tieout.plans.dag import Dag, Task
from tieout.plans.landing import Landing
from tieout.policy import DEFAULT, Policy
from tieout.sources import ingest


@dataclass
class Day:
    """Where a run reads and writes, and for which date; with ``landing``, the files are not read again."""

    spark: SparkSession
    core_path: str
    events_path: str
    mart_root: str
    queue_root: str
    business_date: str | None
    as_of: str
    at: str
    policy: Policy = DEFAULT
    lookback: int = 0
    landing: Landing | None = None


def slice_day(records: DataFrame, day: str | None) -> DataFrame:
    return records if day is None else records.where(F.col("business_date") == F.lit(day).cast("date"))


def slice_checks(core: DataFrame, proc: DataFrame) -> DataFrame:
    """Per business date: rows and absolute totals of both sides, and whether both have any."""
    side = lambda df, name: df.groupBy("business_date").agg(F.count("*").alias(f"{name}_rows"), F.sum(F.abs("amount_minor")).alias(f"{name}_total"))
    joined = side(core, "core").join(side(proc, "proc"), "business_date", "full_outer").na.fill(0)
    return joined.withColumn("ok", (F.col("core_rows") > 0) & (F.col("proc_rows") > 0))


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError)


def build(day: Day, sla_s: float = 60.0) -> Dag:
    spark = day.spark

    def ingested(read, path, context, name):
        try:
            got = day.landing.day(name, day.business_date) if day.landing else read(spark, path)
        except ControlTotalMismatch as e:
            raise Permanent(str(e)) from e
        except Exception as e:
            if _missing(e):
                raise Transient(f"{path} is not there yet") from e
            raise
        context[name], context[f"{name}_file"] = slice_day(got.records, day.business_date).persist(), got
        context["counts"] = context.get("counts", {}) | {name: context[name].count()}
        return {"file_rows": got.parsed_count, "rows": context["counts"][name], "file_ok": got.ok}

    def validate(context):
        bad = [n for n in ("core", "proc") if not context[f"{n}_file"].ok]
        if bad:
            raise Permanent(f"control totals do not tie: {', '.join(bad)}")
        rows = context["counts"]
        if not all(rows.values()):
            raise Permanent(f"no rows for {day.business_date}: {rows}")
        return rows

    def reconcile(context):
        context["breaks"] = matching.breaks(context["core"], context["proc"], day.as_of, day.policy, sum(context["counts"].values())).persist()
        rate = matching.match_rate(matching.verdicts(context["core"], context["proc"], day.as_of, day.policy)).first().asDict()
        return rate | {"breaks": context["breaks"].count()}

    def load_breaks(context):
        queue = BreakQueue(spark, day.queue_root)
        added = queue.intake(context["breaks"], day.at)
        return {"events": added, "open": queue.items().where("status = 'open'").count()}

    def load_mart(context):
        """Writes the facts of the commit; nobody sees them yet."""
        mart = m.Mart(spark, day.mart_root)
        context["stage"] = stage = mart.stage(None if day.business_date is None else [day.business_date])
        return {"fct_source_record": stage.put("fct_source_record", m.fact_records(context["core"], context["proc"])), "fct_break": stage.put("fct_break", m.fact_breaks(context["breaks"]))}

    def aggregates(context):
        return context["stage"].aggregate()

    def verify(context):
        """Holds facts against aggregates as they will be; only what ties becomes visible, all of it in one step."""
        tables = context["stage"].view()
        row = m.control_totals(tables.table("fct_source_record"), tables.table("agg_daily_settlement")).first()
        if not row["ties"]:
            raise Permanent(f"aggregates do not tie to facts: {row.asDict()}")
        return row.asDict() | {"version": context["stage"].publish()}

    return Dag(
        [
            Task("ingest_core", lambda c: ingested(ingest.read_batch, day.core_path, c, "core"), retries=2, backoff_s=0.1, sla_s=5),
            Task("ingest_processor", lambda c: ingested(ingest.read_events, day.events_path, c, "proc"), retries=2, backoff_s=0.1, sla_s=5),
            Task("validate", validate, ("ingest_core", "ingest_processor"), gate=True),
            Task("reconcile", reconcile, ("validate",), sla_s=10),
            Task("load_breaks", load_breaks, ("reconcile",)),
            Task("load_mart", load_mart, ("reconcile",)),
            Task("build_aggregates", aggregates, ("load_mart",)),
            Task("verify_controls", verify, ("build_aggregates",), gate=True),
        ],
        sla_s,
    )


def run_day(day: Day, sla_s: float = 60.0):
    """Runs the pipeline and lets go of what it kept in memory."""
    context: dict = {}
    try:
        return build(day, sla_s).run(context)
    finally:
        for name in ("core", "proc", "breaks"):
            if name in context:
                context[name].unpersist()


