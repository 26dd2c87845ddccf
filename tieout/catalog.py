"""Named queries over the derived feeds, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout import storage
from tieout.functions.calendar import age_bucket, business_days, tier
from tieout.operators import aging, approvals, breakqueue, completeness, lineage, mart, matching, scoring
from tieout.plans import backfill, landing, pipeline
from tieout.policy import Policy
from tieout.sources import feeds, ingest, writers
from tieout.streaming import completeness as live
from tieout.streaming import silence

CLOSE, FIRST_CLOSE = feeds.CLOSE, feeds.FIRST_CLOSE
EXPECTED = ["p0", "p9"]
CELL = {"business_date": "2026-03-03", "currency": "EUR"}
DAYS = [f"2026-03-0{d}" for d in range(2, 7)]


def _feeds(spark, d):
    return feeds.core(spark, d), feeds.processor(spark, d)


def _verdicts(spark, d, policy=Policy()):
    return matching.verdicts(*_feeds(spark, d), feeds.AS_OF, policy)


def _breaks(spark, d, policy=Policy()):
    return matching.breaks(*_feeds(spark, d), feeds.AS_OF, policy)


def recon_verdicts(spark, d):
    return _verdicts(spark, d)


def recon_summary(spark, d):
    return matching.summary(_verdicts(spark, d))


def recon_breaks(spark, d):
    return _breaks(spark, d)


def recon_match_rate(spark, d):
    return matching.match_rate(_verdicts(spark, d))


def recon_tolerance_notes(spark, d):
    return matching.tolerance_notes(_verdicts(spark, d))


def recon_missing_core(spark, d):
    return _breaks(spark, d).where("break_type = 'missing' and core_amount is null").select("ref", "business_date", F.col("proc_amount").alias("amount_minor"), "line_no")


def recon_missing_proc(spark, d):
    return _breaks(spark, d).where("break_type = 'missing' and proc_amount is null").select("ref", "business_date", F.col("core_amount").alias("amount_minor"), "line_no")


def _of(verdict):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _verdicts(spark, d).where(F.col("verdict") == verdict).select("ref", "status", "n_core", "n_proc", "core_amount", "proc_amount", "variance_minor", "business_date", "age_days")

    return query


def recon_by_business_date(spark, d):
    return matching.sliced(*_feeds(spark, d), DAYS, feeds.AS_OF).groupBy("run_date", "verdict").agg(F.count("*").alias("n"))


def recon_lookback(spark, d):
    return matching.sliced(*_feeds(spark, d), DAYS, feeds.AS_OF, lookback=1).groupBy("run_date", "verdict").agg(F.count("*").alias("n"))


def recon_strict_currency(spark, d):
    return matching.summary(_verdicts(spark, d, Policy(strict_currency=True)))


def recon_universe(spark, d):
    core, proc = _feeds(spark, d)
    return core.select("ref").union(proc.select("ref")).distinct().agg(F.count("*").alias("universe"))


def recon_largest_open(spark, d):
    return _verdicts(spark, d).where("status = 'open'").orderBy(F.abs("variance_minor").desc_nulls_last(), "ref").limit(1).select("ref", "verdict", "variance_minor")


def aging_buckets(spark, d):
    return aging.buckets(_breaks(spark, d))


def aging_tiers(spark, d):
    return aging.tiers(_breaks(spark, d).withColumn("first_seen", F.col("business_date")), "2026-03-17")


def business_days_matrix(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    age = business_days(F.col("day"), F.lit(feeds.AS_OF).cast("date")).cast("bigint")
    return o.select("o_orderkey", age.alias("age_days"), tier(age).alias("tier"), age_bucket(age).alias("bucket"))


def _predicted(spark, d):
    return _breaks(spark, d).withColumn("ordinal", F.coalesce("line_no", F.lit(0)))


def score_by_class(spark, d):
    return scoring.by_class(feeds.planted(spark, d), _predicted(spark, d))


def score_overall(spark, d):
    return scoring.overall(feeds.planted(spark, d), _predicted(spark, d))


def control_totals_feed(spark, d):
    core, proc = _feeds(spark, d)
    side = lambda df, name: ingest.control_totals(df).select(F.lit(name).alias("source"), F.col("n").alias("n_records"), F.col("total").alias("abs_total"))
    return side(core, "core").unionByName(side(proc, "processor"))


def slice_consistency(spark, d):
    return pipeline.slice_checks(*_feeds(spark, d))


def _records(spark, d):
    core, proc = _feeds(spark, d)
    return core.unionByName(proc)


def lineage_currency_date(spark, d):
    return lineage.by_currency_and_date(feeds.core(spark, d))


def lineage_account_topk(spark, d):
    return lineage.by_account(feeds.core(spark, d), 5)


def lineage_control_total(spark, d):
    return lineage.control_total(_records(spark, d))


def lineage_contributors(spark, d):
    return lineage.contributors(feeds.core(spark, d), CELL).select("ref", "amount_minor", "source_file", "line_no")


def lineage_verify(spark, d):
    core = feeds.core(spark, d)
    return lineage.verify(lineage.by_currency_and_date(core), core, ["currency", "business_date"])


def lineage_largest_line(spark, d):
    return lineage.by_currency_and_date(feeds.core(spark, d)).orderBy(F.desc("record_count"), "currency", "business_date").limit(1)


def _facts(spark, d):
    return mart.fact_records(*_feeds(spark, d))


def mart_fact_records(spark, d):
    return _facts(spark, d)


def mart_fact_breaks(spark, d):
    return mart.fact_breaks(_breaks(spark, d))


def mart_daily_settlement(spark, d):
    return mart.monthly_report(mart.daily_settlement(_facts(spark, d)))


def mart_monthly_report(spark, d):
    return mart.monthly_report(mart.daily_settlement(_facts(spark, d)), "2026-03")


def mart_drill_down(spark, d):
    return mart.drill_down(_facts(spark, d), "2026-03-03", "USD", "processor")


def mart_verify_cells(spark, d):
    facts = _facts(spark, d)
    return mart.verify_cells(mart.daily_settlement(facts), facts)


def mart_break_summary(spark, d):
    return mart.break_summary(mart.fact_breaks(_breaks(spark, d)))


def mart_control_totals(spark, d):
    facts = _facts(spark, d)
    return mart.control_totals(facts, mart.daily_settlement(facts))


def mart_snapshot_diff(spark, d):
    facts = _facts(spark, d)
    wide = Policy(fee_max_bps=10)
    return mart.snapshot_diff(mart.snapshot(facts, _breaks(spark, d).where("status = 'open'")), mart.snapshot(facts, _breaks(spark, d, wide).where("status = 'open'")))


def _loaded(spark, d):
    store = mart.Mart(spark, storage.fresh(spark, "mart"))
    store.load("fct_source_record", _facts(spark, d))
    return store


def mart_dates(spark, d):
    return _loaded(spark, d).dates()


def mart_rows_for(spark, d):
    return _loaded(spark, d).rows_by_date()


def mart_replace_date(spark, d):
    """Loads two dates, one of them twice, empties the breaks of the other: what is there, and what the last commit of a date replaced."""
    store = mart.Mart(spark, storage.fresh(spark, "mart"))
    facts, rows = _facts(spark, d), mart.fact_breaks(_breaks(spark, d))
    first, other = "2026-03-02", "2026-03-03"
    store.load_days([first, other], facts, rows)
    again = store.load_days([first], facts, rows)
    emptied = store.replace("fct_break", other, rows.limit(0))
    gone = spark.createDataFrame([(first, *(again[t][first] for t in mart.FACTS)), (other, 0, emptied, 0)], "day string, records_gone bigint, breaks_gone bigint, cells_gone bigint")
    tables = store.view()
    f, b = tables.table("fct_source_record"), tables.table("fct_break")
    there = f.groupBy("business_date").agg(F.count("*").alias("fact_rows"), F.sum("amount_minor").alias("net_minor")).join(b.groupBy("business_date").agg(F.count("*").alias("break_rows")), "business_date", "left").na.fill(0)
    return there.join(gone.withColumn("business_date", F.col("day").cast("date")).drop("day"), "business_date")


def mart_versions(spark, d):
    """A reader that opened the mart before a date was replaced keeps what it saw, in all three tables."""
    store = mart.Mart(spark, storage.fresh(spark, "mart"))
    facts, rows = _facts(spark, d), mart.fact_breaks(_breaks(spark, d))
    store.load_days(DAYS, facts, rows)
    opened = store.view()
    store.load_days(["2026-03-04"], facts.where("source_system = 'core'"), rows.where("status = 'open'"))
    out = None
    for name, tables in (("before", opened), ("after", store.view())):
        counts = [tables.table(t).groupBy("business_date").agg(F.count("*").alias("n")).select(F.lit(name).alias("seen"), F.lit(t).alias("table_name"), "business_date", "n") for t in mart.FACTS]
        for c in counts:
            out = c if out is None else out.unionByName(c)
    return out


def completeness_partition_stats(spark, d):
    return completeness.partition_stats(feeds.stream_events(spark, d))


def completeness_gaps(spark, d):
    return completeness.gaps(feeds.stream_events(spark, d))


def completeness_closed_late(spark, d):
    return completeness.closed_late(feeds.stream_events(spark, d))


def completeness_heartbeats(spark, d):
    """With a partition that is expected and never beats."""
    return completeness.heartbeat_state(feeds.stream_events(spark, d), feeds.heartbeats(spark, d), CLOSE, expected=EXPECTED)


def completeness_report(spark, d):
    return completeness.report(feeds.stream_events(spark, d), feeds.heartbeats(spark, d), CLOSE)


def completeness_score(spark, d):
    return completeness.score(feeds.stream_events(spark, d), feeds.heartbeats(spark, d), CLOSE, feeds.DROPPED, feeds.DELAYED, feeds.SILENT)


def completeness_lag_vs_holes(spark, d):
    return completeness.lag_or_hole(feeds.stream_events(spark, d), feeds.heartbeats(spark, d), CLOSE)


def _streamed(spark, d):
    """The stream in three deliveries of arrival order, each taken by a run of its own that resumes from the last."""
    root = storage.fresh(spark, "stream")
    events = feeds.stream_events(spark, d).persist()
    last = events.agg(F.max("arrival")).first()[0]
    cuts = [-1, 400, 1_000_000_000, last]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        events.where((F.col("arrival") > low) & (F.col("arrival") <= high)).write.json(f"{root}/in{i}")
        changes = live.run_available(spark, f"{root}/in*", f"{root}/out", f"{root}/state")
    events.unpersist()
    return changes


def completeness_stream(spark, d):
    """The same figures as the batch."""
    return live.figures_of(_streamed(spark, d))


def completeness_stream_gaps(spark, d):
    """The same holes as the batch, finalised by the grace."""
    return live.gaps_of(_streamed(spark, d), Policy().reorder_grace)


def completeness_stream_silence(spark, d):
    """Two closes of a live stream of beats, with a partition that is expected and never beats."""
    root = storage.fresh(spark, "silence")
    beats = feeds.beats(spark, d).withColumn("kind", F.lit("beat"))
    names = "kind string, partition string, at string, producer_high_water bigint, arrival bigint"
    clock = lambda at: ("clock", silence.CLOCK, at, None, 0)
    extra = ([("expected", p, None, None, 0) for p in EXPECTED] + [clock(FIRST_CLOSE)], [clock(CLOSE)])
    cuts = (F.col("at") <= F.lit(FIRST_CLOSE).cast("timestamp"), F.col("at") > F.lit(FIRST_CLOSE).cast("timestamp"))
    for i, (rows, cut) in enumerate(zip(extra, cuts)):
        more = spark.createDataFrame(rows, names).withColumn("at", F.col("at").cast("timestamp"))
        beats.where(cut).unionByName(more).write.json(f"{root}/in{i}")
        changes = silence.run_available(spark, f"{root}/in*", f"{root}/out", f"{root}/state")
    return silence.state_of(changes, FIRST_CLOSE).withColumn("close", F.lit(FIRST_CLOSE)).unionByName(silence.state_of(changes, CLOSE).withColumn("close", F.lit(CLOSE)))


def _queue_events(spark, d):
    """Two intakes: the first run's breaks, then (after resolving all timing items) the second run's."""
    nothing = spark.createDataFrame([], "ref string, break_type string, status string")
    found = _breaks(spark, d)
    first = breakqueue.intake_events(nothing, found, "2026-03-09 08:00:00")
    state = first.select("ref", "break_type", F.when(F.col("break_type") == "sign", "resolved").otherwise("open").alias("status"))
    second = breakqueue.intake_events(state, found, "2026-03-10 08:00:00")
    return first.unionByName(second)


def queue_intake(spark, d):
    return _queue_events(spark, d).groupBy("action", "break_type", "from_status", "to_status").agg(F.count("*").alias("n"), F.sum(F.coalesce("variance_minor", F.lit(0))).alias("variance_minor"))


def _queue_items(spark, d):
    first = breakqueue.intake_events(spark.createDataFrame([], "ref string, break_type string, status string"), _breaks(spark, d).where("status = 'open'"), "2026-03-09 08:00:00")
    return breakqueue.state(first.withColumn("event_id", F.lit(1).cast("bigint")))


def queue_open_items(spark, d):
    return breakqueue.open_items(_queue_items(spark, d), "2026-03-17").select("ref", "break_type", "first_seen", "variance_minor", "age_days", "tier", "tier_action")


def queue_aging_report(spark, d):
    return aging.tiers(_queue_items(spark, d), "2026-03-17")


def _attempts(spark, d):
    n = F.substring("ref", 3, 9).cast("bigint")
    codes = F.array(*(F.lit(c) for c in ("timing_confirmed", "fx_rounding_accepted", "counterparty_error", "written_off", "made_up")))
    roles = F.array(*(F.lit(r) for r in ("analyst", "supervisor", "controller", "intern")))
    return _breaks(spark, d).groupBy("ref", "break_type").agg(F.count("*").alias("c")).select(
        "ref", "break_type", F.element_at(codes, (n % 5 + 1).cast("int")).alias("code"), F.lit("ann").alias("actor"), F.element_at(roles, (n % 4 + 1).cast("int")).alias("role")
    )


def queue_resolution_validation(spark, d):
    return breakqueue.validate(_queue_items(spark, d), _attempts(spark, d)).select("ref", "break_type", "code", "role", "reason")


def queue_history(spark, d):
    """Opened, resolved and reopened: the events of one item in order, with what was said when they came in."""
    events = _queue_events(spark, d).where("break_type = 'sign'").withColumn("event_id", F.when(F.col("action") == "opened", 1).otherwise(2).cast("bigint"))
    ref = events.agg(F.min("ref")).first()[0]
    return breakqueue.history(events, ref, "sign").select("event_id", "ref", "break_type", "action", "from_status", "to_status", F.col("note").alias("detail"))


def queue_ledger_audit(spark, d):
    """One event of the queue's ledger rewritten in place and one removed: what the audit names."""
    root = storage.fresh(spark, "ledger")
    queue = breakqueue.BreakQueue(spark, root)
    queue.intake(_breaks(spark, d), "2026-03-09 08:00:00")
    [batch] = queue.ledger.batches()
    held = queue.ledger.events()
    place = F.col("event_id") % 100
    held.where(place != 7).withColumn("variance_minor", F.when(place == 3, F.lit(0)).otherwise(F.col("variance_minor"))).withColumn("actor", F.when(place == 3, "mallory").otherwise(F.col("actor"))).drop("batch").write.parquet(f"{root}/forged")
    spark.read.parquet(f"{root}/forged").write.mode("overwrite").parquet(f"{root}/events/batch={batch['batch']}/draft={batch['draft']}")
    return queue.ledger.changes().join(held.sparkSession.read.parquet(f"{root}/tree").where("level = 0").select((F.col("node") + 1).alias("event_id")), "event_id").select("event_id", "change")


def _requests(spark, d):
    base = _breaks(spark, d).where("variance_minor is not null").groupBy("ref").agg(F.min("variance_minor").alias("amount_minor"))
    n = F.substring("ref", 3, 9).cast("bigint")
    people = F.array(*(F.lit(p) for p in ("ann", "bob", "  ", "Cy")))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2026-03-09 09:00:00").cast("timestamp")) + n % 3600)
    return approvals.route(base.select(n.alias("request_id"), "ref", "amount_minor", F.element_at(people, (n % 4 + 1).cast("int")).alias("maker"), at.alias("made_at")))


def _decisions(spark, d):
    r = _requests(spark, d)
    n = F.col("request_id")
    checkers = F.array(*(F.lit(p) for p in ("ANN ", "dee", "", "cy")))
    return r.select(
        "request_id", F.when(n % 7 == 0, "rejected").otherwise("approved").alias("action"), F.element_at(checkers, (F.call_function("div", n, F.lit(5)) % 4 + 1).cast("int")).alias("checker"),
        F.when(n % 11 == 0, " ").otherwise("looked at").alias("note"), F.timestamp_seconds(F.unix_seconds("made_at") + n % 60).alias("checked_at"),
    )


def foureyes_routing(spark, d):
    return _requests(spark, d).select("request_id", "ref", "amount_minor", "state")


def foureyes_decisions(spark, d):
    return approvals.decide(_requests(spark, d), _decisions(spark, d)).select("request_id", "action", "reason", F.col("seconds").cast("bigint").alias("seconds"))


def foureyes_oldest_pending(spark, d):
    """The twenty requests that wait longest for a checker."""
    return approvals.pending(_requests(spark, d)).limit(20).select("request_id", "ref", "amount_minor", "maker", "made_at")


def foureyes_review_speed(spark, d):
    fine = approvals.decide(_requests(spark, d), _decisions(spark, d)).where("reason is null").select("request_id", F.col("action").alias("decided"))
    reviews = _requests(spark, d).drop("state").join(fine, "request_id").join(_decisions(spark, d).select("request_id", "checked_at"), "request_id").withColumnRenamed("decided", "state")
    return approvals.review_speed(reviews)


def foureyes_fast_reviews(spark, d):
    """The first ten reviews that were decided faster than is plausible."""
    fine = approvals.decide(_requests(spark, d), _decisions(spark, d)).where("reason is null").select("request_id", F.col("action").alias("state"))
    reviews = _requests(spark, d).drop("state").join(fine, "request_id").join(_decisions(spark, d).select("request_id", "checked_at"), "request_id")
    return approvals.fast_reviews(reviews).select("request_id", "ref", "state", F.col("seconds").cast("bigint").alias("seconds"))


def signoff_lifecycle(spark, d):
    """Sign-off, request, approval, use and rejection over their ledgers: what each step said, and the state and plan of each request.

    The closed date is the feed's second; the plan is over its first two and what the facts hold of them.
    """
    held = {str(r[0]): r[1] for r in _facts(spark, d).groupBy("business_date").count().collect()}
    counts = {day: held[day] for day in sorted(held)[:2]}
    periods = approvals.Periods(spark, storage.fresh(spark, "periods"))
    periods.sign_off(max(counts), "ann", "2026-03-04T09:00:00")
    dates = sorted(counts)
    first = periods.request_backfill(dates, "bob", "late file", "2026-03-05T09:00:00", counts)
    second = periods.request_backfill(dates, "bob", "second try", "2026-03-05T09:05:00", counts)
    third = periods.request_backfill(dates, "cy", "third try", "2026-03-05T09:06:00", counts)
    said = []

    def step(name, action):
        try:
            action()
            said.append((name, "done"))
        except (approvals.NotAuthorised, approvals.ReviewError) as e:
            said.append((name, str(e).split(": ")[-1]))

    step("early use", lambda: periods.authorise(dates, counts, "2026-03-05T09:10:00", first))
    step("own approval", lambda: periods.approve_backfill(first, " BOB ", "fine", "2026-03-05T10:00:00"))
    step("approval", lambda: periods.approve_backfill(first, "ann", "fine", "2026-03-05T10:00:00"))
    step("rejection", lambda: periods.reject_backfill(second, "ann", "not needed"))
    step("approval without time", lambda: periods.approve_backfill(third, "ann", "fine", "2026-03-05T10:00:00", ttl_hours=0))
    step("other plan", lambda: periods.authorise(dates, counts | {min(counts): 0}, "2026-03-05T11:00:00", first))
    step("use", lambda: periods.authorise(dates, counts, "2026-03-05T11:00:00", first))
    step("use of expired", lambda: periods.authorise(dates, counts, "2026-03-05T10:00:01", third))
    step("consumption", lambda: periods.consume(first, "2026-03-05T11:30:00"))
    step("second use", lambda: periods.authorise(dates, counts, "2026-03-05T11:40:00", first))
    steps = spark.createDataFrame([(i, *x, None) for i, x in enumerate(said)], "place int, subject string, outcome string, plan string")
    states = periods.requests().select(F.lit(100).alias("place"), F.concat(F.lit("request "), F.col("request_id").cast("string")).alias("subject"), F.concat_ws(" ", "state", F.when(F.col("consumed_at").isNotNull(), "used")).alias("outcome"), F.col("plan_hash").alias("plan"))
    return steps.unionByName(states)


def _signoffs(spark, d):
    """Dates with an even number of refunds on the core side count as closed."""
    refunds = F.count_if(F.col("kind") == "refund")
    return feeds.core(spark, d).groupBy("business_date").agg(refunds.alias("n")).where("n % 2 = 0").select("business_date")


def _range(spark):
    return spark.sql("SELECT explode(sequence(date'2026-03-01', date'2026-03-08')) AS business_date")


def signoff_protected_dates(spark, d):
    """Closed ones among the dates of the facts, next to how many rows they would change."""
    dates = _facts(spark, d).groupBy("business_date").agg(F.count("*").alias("n_rows"))
    return approvals.protected(dates, _signoffs(spark, d))


def backfill_plan(spark, d):
    core, proc = _feeds(spark, d)
    completed = spark.sql("SELECT date'2026-03-02' AS business_date")
    facts = mart.fact_records(core, proc).where("business_date <= date'2026-03-04'")
    return backfill.plan(core, proc, _range(spark), completed, facts)


def backfill_authorisation(spark, d):
    """The first reason to refuse, per scenario; the fingerprint is over the mart's counts of three dates."""
    counts = {str(r[0]): r[1] for r in _facts(spark, d).where("business_date <= date'2026-03-04'").groupBy("business_date").count().collect()}
    right = approvals.plan_hash(list(counts), counts)
    good = dict(state="approved", consumed_at=None, expires_at="2026-03-10T00:00:00", plan_hash=right)
    now = "2026-03-09T12:00:00"
    cases = {
        "allowed": (good, right), "pending": (good | {"state": "pending"}, right), "used": (good | {"consumed_at": now}, right),
        "expired": (good | {"expires_at": "2026-03-09T11:00:00"}, right), "changed": (good, approvals.plan_hash(list(counts), counts | {"2026-03-02": 0})),
    }
    rows = [(name, approvals.refusal(row, actual, now), row["plan_hash"], actual) for name, (row, actual) in cases.items()]
    return spark.createDataFrame(rows, "scenario string, reason string, approved_plan string, actual_plan string")


def backfill_run(spark, d):
    """A date run from a first delivery, then a range from a second one: empty, rerun and new dates, figure by figure."""
    root = storage.fresh(spark, "backfill")
    core, proc = _feeds(spark, d)
    late = F.call_function("div", F.col("line_no"), F.lit(2)) % 97 == 0
    for name, events in (("first", proc.where(~late)), ("second", proc)):
        writers.write_batch(core, f"{root}/{name}/core")
        writers.write_events(events, f"{root}/{name}/events")
    landed = landing.Landing(spark, f"{root}/landing")
    day = pipeline.Day(spark, "", "", f"{root}/mart", f"{root}/queue", None, feeds.AS_OF, "2026-03-09 08:00:00", landing=landed)
    periods = approvals.Periods(spark, f"{root}/control")
    run = lambda first, last, **more: backfill.backfill(day, first, last, f"{root}/state", periods, **more)
    landed.land(f"{root}/first/core", f"{root}/first/events")
    run("2026-03-02", "2026-03-02")
    landed.land(f"{root}/second/core", f"{root}/second/events")
    out = run("2026-03-01", "2026-03-03", force=True)
    rows = [(c["date"], c["metric"], c["before"], c["after"], c["state"]) for c in out.changes] + [(day, None, None, None, "empty") for day in out.empty]
    return spark.createDataFrame(rows, "day string, metric string, before bigint, after bigint, state string")


def _written_batch(spark, d):
    path = storage.fresh(spark, "batch")
    writers.write_batch(feeds.core(spark, d), path)
    return path


def ingest_fixed_width_roundtrip(spark, d):
    got = ingest.read_batch(spark, _written_batch(spark, d))
    return got.records.drop("source_file").withColumn("line_no", F.col("line_no") - 1)


def ingest_jsonl_roundtrip(spark, d):
    path = storage.fresh(spark, "events")
    writers.write_events(feeds.processor(spark, d), path)
    return ingest.read_events(spark, path).records.drop("source_file")


def ingest_transport(spark, d):
    path = storage.fresh(spark, "transport")
    writers.write_events(feeds.stream_events(spark, d), path, order="arrival")
    return completeness.partition_stats(ingest.read_transport(spark, path))


def ingest_rejects(spark, d):
    """Every 50th line broken in one of four ways."""
    lines = writers.batch_lines(feeds.core(spark, d)).where("part = 1").select(F.lit("b").alias("source_file"), F.col("ordinal").alias("line_no"), "value")
    n = F.col("line_no")
    broken = (
        F.when(n % 200 == 0, F.concat(F.lit("17"), F.substring("value", 3, 99)))
        .when(n % 200 == 50, F.concat(F.substring("value", 1, 18), F.lit("20261399"), F.substring("value", 27, 99)))
        .when(n % 200 == 100, F.concat(F.substring("value", 1, 35), F.lpad(F.lit("12.5"), 15, " "), F.substring("value", 51, 99)))
        .when(n % 200 == 150, F.concat(F.lit("16"), F.rpad(F.lit(""), 16, " "), F.substring("value", 19, 99)))
        .otherwise(F.col("value"))
    )
    _, rejects = ingest.fixed_width(lines.withColumn("value", broken))
    return rejects.select("line_no", "reason")


def ingest_truncated_gate(spark, d):
    """A batch whose last details are gone is refused, and why."""
    path = storage.fresh(spark, "cut")
    writers.write_lines(writers.batch_lines(feeds.core(spark, d)).where("part <> 1 or ordinal % 100 <> 7"), path, "part", "ordinal")
    try:
        ingest.read_batch(spark, path)
        reason = None
    except ingest.ControlTotalMismatch as e:
        reason = str(e).replace(path, "the batch")
    return spark.createDataFrame([(reason is not None, reason)], "refused boolean, reason string")


def ingest_heartbeats(spark, d):
    """Beats and what the stream should hold, through their control files."""
    root = storage.fresh(spark, "beats")
    beats = feeds.heartbeats(spark, d).orderBy("arrival").collect()
    writers.write_json(spark, [{"partition": b["partition"], "at": b["at"].isoformat(), "producer_high_water": b["producer_high_water"]} for b in beats], f"{root}/beats.json")
    return ingest.read_heartbeats(spark, f"{root}/beats.json")


def ingest_truth(spark, d):
    """Planted faults through their truth files."""
    path = storage.fresh(spark, "truth")
    feeds.planted(spark, d).write.json(path)
    return ingest.read_truth(spark, path, "ref string, break_type string")


def pipeline_broken_feed(spark, d):
    """A batch cut short and an events file that never comes: one refusal, two retries, and what waits for them."""
    root = storage.fresh(spark, "broken")
    writers.write_lines(writers.batch_lines(feeds.core(spark, d)).where("part <> 1 or ordinal % 100 <> 7"), f"{root}/core", "part", "ordinal")
    day = pipeline.Day(spark, f"{root}/core", f"{root}/events", f"{root}/mart", f"{root}/queue", "2026-03-03", feeds.AS_OF, "2026-03-09 08:00:00")
    runs = pipeline.run_day(day).runs
    return spark.createDataFrame([(n, r.state, r.attempts, r.error.replace(root, "")) for n, r in runs.items()], "task string, state string, attempts int, error string")


def pipeline_run(spark, d):
    """The eight tasks over the written feeds of one date."""
    root = storage.fresh(spark, "pipeline")
    writers.write_batch(feeds.core(spark, d), f"{root}/core")
    writers.write_events(feeds.processor(spark, d), f"{root}/events")
    day = pipeline.Day(spark, f"{root}/core", f"{root}/events", f"{root}/mart", f"{root}/queue", "2026-03-03", feeds.AS_OF, "2026-03-09 08:00:00")
    runs = pipeline.run_day(day).runs
    shown = {
        "ingest_core": ("file_rows", "rows"), "ingest_processor": ("file_rows", "rows"), "validate": ("core", "proc"), "reconcile": ("matched_exact", "matched_tolerance", "universe", "breaks"),
        "load_breaks": ("open",), "verify_controls": ("fact_count", "fact_minor", "agg_count", "agg_minor"),
    }
    rows = [(name, run.state, metric, int((run.output or {}).get(metric, -1))) for name, run in runs.items() for metric in shown.get(name, ())]
    return spark.createDataFrame(rows + [(name, run.state, None, None) for name, run in runs.items() if name not in shown], "task string, state string, metric string, value bigint")


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if callable(fn) and name.split("_")[0] in ("recon", "aging", "business", "score", "control", "slice", "lineage", "mart", "completeness", "queue", "foureyes", "signoff", "backfill", "ingest", "pipeline") and "_" in name and getattr(fn, "__module__", "") == __name__
} | {f"recon_{short}": _of(verdict) for short, verdict in (("duplicates", "duplicate"), ("sign", "sign"), ("fx", "amount_fx"), ("fee", "amount_fee"), ("timing", "timing"), ("unknown", "amount_unknown"))}
