"""Commands: recon, completeness, workflow, run, tick, backfill, approvals.

``python -m tieout.cli COMMAND --help``
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tieout.errors import TieoutError
from tieout.operators import aging, completeness, mart, matching, scoring
from tieout.operators.approvals import Periods
from tieout.operators.breakqueue import BreakQueue
from tieout.plans import backfill, dag, pipeline
from tieout.plans.landing import Landing
from tieout.sources import generate, ingest


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tieout").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _day(spark: SparkSession, a: argparse.Namespace) -> pipeline.Day:
    return pipeline.Day(spark, f"{a.feeds}/core", f"{a.feeds}/events", f"{a.store}/mart", f"{a.store}/queue", getattr(a, "date", None), a.as_of, a.now)


def recon(spark, a) -> int:
    core, proc = ingest.read_batch(spark, f"{a.feeds}/core").records, ingest.read_events(spark, f"{a.feeds}/events").records
    verdicts = matching.verdicts(core, proc, a.as_of).persist()
    breaks = matching.breaks(core, proc, a.as_of).withColumn("ordinal", F.coalesce("line_no", F.lit(0)))
    truth = ingest.read_truth(spark, f"{a.feeds}/break_truth.json", "ref string, break_type string")
    for df in (matching.match_rate(verdicts), matching.tolerance_notes(verdicts), matching.summary(verdicts), aging.buckets(breaks), scoring.by_class(truth, breaks), scoring.overall(truth, breaks)):
        df.show(50, False)
    return 0


def stream(spark, a) -> int:
    events, beats = ingest.read_transport(spark, f"{a.feeds}/transport"), ingest.read_heartbeats(spark, f"{a.feeds}/heartbeats.json")
    truth = ingest.read_truth(spark, f"{a.feeds}/stream_truth.json", "dropped_events bigint, delayed_events bigint, silent_partition string").first()
    print(completeness.render(completeness.report(events, beats, a.now).first(), completeness.gaps(events).limit(20).collect()))
    completeness.lag_or_hole(events, beats, a.now).show(50, False)
    score = completeness.score(events, beats, a.now, truth["dropped_events"], truth["delayed_events"], truth["silent_partition"]).first()
    return 0 if score["dropped_ok"] and score["delayed_ok"] and score["silent_found"] else 1


def workflow(spark, a) -> int:
    queue = BreakQueue(spark, f"{a.store}/queue")
    queue.aging_report(a.as_of).show()
    queue.open_items(a.as_of).show(10, False)
    print(f"{queue.ledger.audit()} events, chain intact")
    return 0


def run(spark, a) -> int:
    result = pipeline.run_day(_day(spark, a))
    print(dag.render(result))
    if result.tasks_ok and getattr(a, "date", None):
        print(mart.render(mart.Mart(spark, f"{a.store}/mart").view(), a.date))
    return result.exit_code


def tick(spark, a) -> int:
    return backfill.tick(_day(spark, a), f"{a.store}/runs", a.date)


def fill(spark, a) -> int:
    landing = Landing(spark, f"{a.store}/landing")
    landing.land(f"{a.feeds}/core", f"{a.feeds}/events")
    out = backfill.backfill(replace(_day(spark, a), landing=landing), a.first, a.last, f"{a.store}/backfill", Periods(spark, f"{a.store}/control"), a.request, a.force, a.dry_run, a.take_over)
    print(backfill.render(out))
    return out.exit_code


def approve(spark, a) -> int:
    periods = Periods(spark, f"{a.store}/control")
    if a.sign_off:
        periods.sign_off(a.sign_off, a.by, a.now, a.note)
    elif a.request_dates:
        print(periods.request_backfill(a.request_dates, a.by, a.note, a.now, json.loads(a.counts)))
    elif a.approve:
        periods.approve_backfill(a.approve, a.by, a.note, a.now)
    elif a.reject:
        periods.reject_backfill(a.reject, a.by, a.note)
    periods.pending().show(50, False)
    return 0


def make(spark, a) -> int:
    print(json.dumps(generate.generate(spark, a.tables, a.feeds), indent=1))
    return 0


COMMANDS = {"generate": make, "recon": recon, "completeness": stream, "workflow": workflow, "run": run, "tick": tick, "backfill": fill, "approvals": approve}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tieout")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--feeds", required=True)
    parser.add_argument("--store", default="store")
    parser.add_argument("--tables", help="folder of the orders and events tables (generate)")
    parser.add_argument("--date")
    parser.add_argument("--as-of", default=str(datetime.now(UTC).date()))
    parser.add_argument("--now", default=datetime.now(UTC).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds"))
    parser.add_argument("--first")
    parser.add_argument("--last")
    parser.add_argument("--request", type=int)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--take-over", action="store_true", help="run dates that a dead run has claimed")
    parser.add_argument("--sign-off")
    parser.add_argument("--request-dates", nargs="*")
    parser.add_argument("--counts", default="{}")
    parser.add_argument("--approve", type=int)
    parser.add_argument("--reject", type=int)
    parser.add_argument("--by", default="")
    parser.add_argument("--note", default="")
    a = parser.parse_args(argv)
    try:
        return COMMANDS[a.command](session(), a)
    except TieoutError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
