"""Re-running a range of dates: oldest first, resumable, authorised over closed dates, with a report of what changed."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import Claimed, Conflict
from tieout.operators import mart as m
from tieout.operators.approvals import Periods, plan_hash
from tieout.plans.pipeline import Day, run_day
from tieout.sources.files import Files, Versioned


def days_between(first: str, last: str) -> list[str]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    return [str(a + timedelta(days=i)) for i in range((b - a).days + 1)]


def source_counts(core: DataFrame, proc: DataFrame) -> DataFrame:
    """(business_date, core_rows, proc_rows): one grouped pass for the whole range."""
    both = core.select("business_date", F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(proc.select("business_date", F.lit(0).alias("c"), F.lit(1).alias("p")))
    return both.groupBy("business_date").agg(F.sum("c").alias("core_rows"), F.sum("p").alias("proc_rows"))


def plan(core: DataFrame, proc: DataFrame, days: DataFrame, completed: DataFrame, facts: DataFrame) -> DataFrame:
    """Dates still to do, with their source counts and what the mart holds; dates without source rows are ``empty``."""
    in_mart = facts.groupBy("business_date").agg(F.count("*").alias("mart_rows"))
    todo = days.join(completed, "business_date", "left_anti").join(source_counts(core, proc), "business_date", "left").join(in_mart, "business_date", "left").na.fill(0)
    return todo.withColumn("state", F.when(F.col("core_rows") + F.col("proc_rows") == 0, "empty").otherwise("due"))


class State:
    """Finished and claimed dates, in a file that is compared before it is swapped.

    A date is claimed before it runs, so two runs never work on one.  A run that dies
    leaves its claim; the next run says ``take_over`` to have it.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.file, self.run = Versioned(spark, folder), run

    def read(self) -> dict:
        return self.file.read()[1] or {"completed": [], "claims": {}, "runs": []}

    def _change(self, change) -> None:
        while True:
            version, value = self.file.read()
            value = value or {"completed": [], "claims": {}, "runs": []}
            change(value)
            try:
                self.file.swap(version, value)
                return
            except Conflict:
                continue  # somebody was first: look at what is there now

    def claim(self, day: str, take_over: bool = False) -> None:
        def change(value: dict) -> None:
            holder = value["claims"].get(day, self.run)
            if holder != self.run and not take_over:
                raise Claimed(f"{day} is being run by {holder}")
            value["claims"][day] = self.run

        self._change(change)

    def done(self, day: str, ok: bool) -> None:
        def change(value: dict) -> None:
            if value["claims"].pop(day, None) != self.run:
                raise Claimed(f"{day} was taken over")
            value["completed"] = sorted({*value["completed"], *([day] if ok else [])})
            value["runs"].append({"date": day, "ok": ok, "run": self.run})

        self._change(change)


@dataclass
class Outcome:
    exit_code: int
    done: list[str] = field(default_factory=list)
    empty: list[str] = field(default_factory=list)
    failed: str | None = None
    late: list[str] = field(default_factory=list)
    changes: list[dict] = field(default_factory=list)
    fingerprint: str = ""
    protected: list[str] = field(default_factory=list)


def backfill(template: Day, first: str, last: str, state_folder: str, periods: Periods, request_id: int | None = None, force: bool = False, dry_run: bool = False, take_over: bool = False) -> Outcome:
    """Runs the range from landed feeds, oldest date first; ``template.landing`` must hold them.

    Source and mart counts come from seal and manifest, so planning reads no data.  A dry
    run writes nothing; a failure stops the range and leaves it resumable.
    """
    spark, landing = template.spark, template.landing
    state = State(spark, state_folder, uuid.uuid4().hex)
    finished = set(state.read()["completed"])
    todo = [d for d in days_between(first, last) if force or d not in finished]
    mart = m.Mart(spark, template.mart_root)
    held, counts = mart.view().rows("fct_source_record"), landing.rows()
    out = Outcome(0, fingerprint=plan_hash(todo, {d: held.get(d, 0) for d in todo}), protected=periods.signed_off_within(todo) if todo else [])
    out.empty = [d for d in todo if not counts.get(d) and not held.get(d)]
    if dry_run or not todo:
        return out
    allowed = periods.authorise(todo, {d: held.get(d, 0) for d in todo}, template.at, request_id)
    for day in todo:
        if day in out.empty:
            continue
        state.claim(day, take_over)
        before = mart.view()
        result = run_day(replace(template, business_date=day))
        state.done(day, result.exit_code != 1)
        if result.exit_code == 1:
            out.exit_code, out.failed = 1, day
            return out
        if result.sla_breached:
            out.late.append(day)
        out.changes += changed(before.snapshot_for(day), mart.view().snapshot_for(day))
        out.done.append(day)
    if request_id is not None and allowed["protected"]:
        periods.consume(request_id, template.at)
    return out


def changed(before: dict, after: dict) -> list[dict]:
    """moved, new or unchanged figures of one date."""
    fresh = not before["source_rows"]
    names = ("source_rows", "source_minor", "breaks", "variance_minor")
    return [{"date": str(after["business_date"]), "metric": n, "before": before[n], "after": after[n], "state": "new" if fresh else "unchanged" if before[n] == after[n] else "moved"} for n in names]


def render(out: Outcome, limit: int = 6) -> str:
    """The outcome as text: what moved or is new in full, the first dates that did not change."""
    lines = [f"exit {out.exit_code}, plan {out.fingerprint}: {len(out.done)} done, {len(out.empty)} empty" + (f", failed on {out.failed}" if out.failed else "")]
    lines += [f"  {c['date']} {c['metric']}: {c['before']} -> {c['after']} ({c['state']})" for c in out.changes if c["state"] != "unchanged"]
    moved = {c["date"] for c in out.changes if c["state"] != "unchanged"}
    same = [d for d in out.done if d not in moved]
    if same:
        lines.append(f"  unchanged: {', '.join(same[:limit])}" + (f" and {len(same) - limit} more" if len(same) > limit else ""))
    if out.protected:
        lines.append(f"  closed: {', '.join(out.protected[:limit])}")
    return "\n".join(lines)


def tick(template: Day, log_folder: str, day: str | None = None) -> int:
    """One scheduled run: yesterday by the run's clock unless a date is given; its line is a file of its own in the log.

    Cron line: ``30 19 * * 1-5 python -m tieout.cli tick --config day.json``
    """
    day = day or str(date.fromisoformat(template.at[:10]) - timedelta(days=1))
    result = run_day(replace(template, business_date=day))
    line = {"date": day, "at": template.at, "exit": result.exit_code, "seconds": round(result.seconds, 2), "tasks": [{"task": r.name, "state": r.state, "attempts": r.attempts} for r in result.runs.values()]}
    Files(template.spark).put(f"{log_folder}/{uuid.uuid4().hex}.json", json.dumps(line))
    return result.exit_code


def run_log(spark: SparkSession, log_folder: str) -> DataFrame:
    """The lines of all ticks."""
    return spark.read.schema("date string, at string, exit int, seconds double, tasks array<struct<task:string,state:string,attempts:int>>").json(log_folder).orderBy("at", "date")
