import pytest
from pyspark.sql import functions as F

from tieout.errors import ControlTotalMismatch, LedgerTampered, NotAuthorised, Permanent, ReviewError, Transient, WorkflowError
from tieout.operators.approvals import Periods, Reviews, plan_hash
from tieout.operators.breakqueue import BreakQueue
from tieout.operators.mart import FACTS, Mart
from tieout.plans.dag import Dag, Task
from tieout.sources import feeds, ingest, writers

BREAK = "ref string, break_type string, status string, core_amount bigint, proc_amount bigint, variance_minor bigint, business_date date, line_no bigint"


def found(spark, *rows):
    full = [(ref, kind, "open", 100, 100 - v if v is not None else None, v, day, i) for i, (ref, kind, v, day) in enumerate(rows)]
    return spark.createDataFrame(full, BREAK.replace("business_date date", "business_date string")).withColumn("business_date", F.col("business_date").cast("date"))


def test_queue_keeps_its_age_clock_and_refuses(spark, tmp_path):
    q = BreakQueue(spark, f"file:{tmp_path}/q")
    assert q.intake(found(spark, ("A", "sign", 200, "2026-03-02"), ("B", "missing", None, "2026-03-03")), "2026-03-03 08:00:00") == 2
    assert q.intake(found(spark, ("A", "sign", 999, "2026-03-05")), "2026-03-05 08:00:00") == 0  # already open
    with pytest.raises(WorkflowError, match="unknown code"):
        q.resolve("A", "sign", "because", "ann", "controller", "2026-03-05 09:00:00")
    with pytest.raises(WorkflowError, match="role too low"):
        q.resolve("A", "sign", "counterparty_error", "ann", "analyst", "2026-03-05 09:00:00")
    with pytest.raises(WorkflowError, match="unknown break"):
        q.resolve("Z", "sign", "timing_confirmed", "ann", "analyst", "2026-03-05 09:00:00")
    q.resolve("A", "sign", "fx_rounding_accepted", "ann", "analyst", "2026-03-05 09:00:00")
    with pytest.raises(WorkflowError, match="already resolved"):
        q.resolve("A", "sign", "fx_rounding_accepted", "ann", "analyst", "2026-03-05 09:00:00")
    q.intake(found(spark, ("A", "sign", 5, "2026-03-06"), ("B", "missing", None, "2026-03-06")), "2026-03-06 08:00:00")
    a = q.open_items("2026-03-16").where("ref = 'A'").first()
    assert str(a["first_seen"]) == "2026-03-02" and a["variance_minor"] == 200 and a["tier"] == "T3"
    assert [r["action"] for r in q.history("A", "sign").collect()] == ["opened", "resolved", "reopened"]
    assert {r["tier"]: r["n"] for r in q.aging_report("2026-03-16").collect()} == {"T0": 0, "T1": 0, "T2": 1, "T3": 1}
    assert q.ledger.audit() == 4


def test_materiality_limit(spark, tmp_path):
    q = BreakQueue(spark, f"file:{tmp_path}/q")
    q.intake(found(spark, ("A", "amount_unknown", 10_001, "2026-03-02")), "2026-03-03 08:00:00")
    with pytest.raises(WorkflowError, match="over the limit"):
        q.resolve("A", "amount_unknown", "written_off", "cy", "controller", "2026-03-05 09:00:00")


def rewritten(spark, folder, change):
    """Changes the rows of a batch in place, as somebody with access to its files could."""
    rows = spark.read.parquet(folder)
    held = [change(r.asDict()) for r in rows.collect()]
    spark.createDataFrame([tuple(r.values()) for r in held if r], rows.schema).write.mode("overwrite").parquet(folder)


def test_ledger_shows_tampering_and_takes_nothing_more(spark, tmp_path):
    q = BreakQueue(spark, f"file:{tmp_path}/q")
    q.intake(found(spark, *((chr(65 + i), "sign", i, "2026-03-02") for i in range(6))), "2026-03-03 08:00:00")
    q.intake(found(spark, ("Z", "sign", 1, "2026-03-02")), "2026-03-04 08:00:00")
    assert q.ledger.audit() == 7
    folder = next((tmp_path / "q" / "events" / "batch=0").iterdir())
    rewritten(spark, f"file:{folder}", lambda r: r | {"actor": "mallory"} if r["ref"] == "C" else None if r["ref"] == "E" else r)
    with pytest.raises(LedgerTampered, match="event 3 of batch 0 was changed; event 5 of batch 0 was gone"):
        q.ledger.audit()
    with pytest.raises(LedgerTampered, match="the files of batch 0"):
        q.intake(found(spark, ("Y", "sign", 1, "2026-03-02")), "2026-03-05 08:00:00")
    assert q.ledger.version() == 2


def test_a_forged_head_is_found_though_its_own_digests_fit(spark, tmp_path, monkeypatch):
    from tieout.operators import ledger as led

    monkeypatch.setattr(led, "FANOUT", 4)  # three levels
    rows = spark.range(40).select(F.col("id").cast("string").alias("ref"), F.col("id").alias("n"))
    ledger = led.Ledger(spark, f"file:{tmp_path}/l", "ref string, n bigint")
    assert ledger.append(rows, ["n"]) == 40 and ledger.audit() == 40
    folder = next((tmp_path / "l" / "events" / "batch=0").iterdir())
    forged = spark.read.parquet(f"file:{folder}").withColumn("n", F.when(F.col("event_id") == 18, 99).otherwise(F.col("n"))).drop("row_hash")
    held = led.digest_rows(forged, ["event_id", "ref", "n"]).collect()
    spark.createDataFrame(held, "event_id bigint, ref string, n bigint, row_hash string").write.mode("overwrite").parquet(f"file:{folder}")
    monkeypatch.setattr(led.Ledger, "_looks", lambda self, folder: ledger.batches()[0]["files"])  # and the files look as before
    with pytest.raises(LedgerTampered, match="event 18 of batch 0 was changed"):
        ledger.append(rows.limit(1), ["n"])
    assert [tuple(r) for r in ledger.changes().collect()] == [(0, 18, "changed")]
    tree = next((tmp_path / "l" / "tree" / "batch=0").iterdir())
    digests = {r["event_id"]: r["row_hash"] for r in held}
    rewritten(spark, f"file:{tree}", lambda r: r | {"digest": digests[r["node"] + 1]} if r["level"] == 0 else r)
    with pytest.raises(LedgerTampered, match="event 18|the tree of batch 0"):
        ledger.audit()


def test_two_writers_of_a_ledger_get_two_numbers(spark, tmp_path, monkeypatch):
    """Both read the same requests; the second append is refused, asked again, and takes the next number."""
    from tieout.operators.ledger import Ledger

    periods, rival = (Periods(spark, f"file:{tmp_path}/p") for _ in range(2))
    append, beaten = Ledger.append, []

    def late(self, *args, **more):
        if not beaten:
            beaten.append(None)
            beaten.append(rival.request_backfill(["2026-03-02"], "bob", "late", "2026-03-05T09:00:00"))
        return append(self, *args, **more)

    monkeypatch.setattr(Ledger, "append", late)
    assert (periods.request_backfill(["2026-03-02"], "cy", "later", "2026-03-05T09:00:00"), beaten[1]) == (2, 1)
    assert {r["request_id"]: r["requested_by"] for r in periods.requests().collect()} == {1: "bob", 2: "cy"}


def test_four_eyes(spark, tmp_path):
    r = Reviews(spark, f"file:{tmp_path}/r")
    big, state = r.propose("A", -100_000, "fee_schedule_verified", "Ann", "2026-03-09T09:00:00")
    assert state == "pending" and r.propose("B", 99_999, "x", "bob", "2026-03-09T09:00:00")[1] == "auto"
    with pytest.raises(ReviewError):
        r.propose("C", 1, "x", "  ", "2026-03-09T09:00:00")
    for checker, note in (("ann ", "fine"), ("", "fine"), ("dee", " ")):
        with pytest.raises(ReviewError):
            r.approve(big, checker, note, "2026-03-09T09:00:04")
    assert r.approve(big, "dee", "checked", "2026-03-09T09:00:04") == 4.0
    with pytest.raises(ReviewError, match="not pending"):
        r.reject(big, "dee", "again", "2026-03-09T09:00:09")
    assert r.pending().count() == 0


def test_backfill_approval_is_bound_single_use_and_expires(spark, tmp_path):
    p = Periods(spark, f"file:{tmp_path}/p")
    dates, counts = ["2026-03-03", "2026-03-02"], {"2026-03-02": 5, "2026-03-03": 7}
    assert plan_hash(dates, counts) == plan_hash(dates[::-1], dict(reversed(counts.items())))
    assert p.authorise(dates, counts, "2026-03-09T10:00:00")["reason"] == "no closed date"
    p.sign_off("2026-03-02", "ann", "2026-03-05T10:00:00")
    with pytest.raises(NotAuthorised, match="closed dates"):
        p.authorise(dates, counts, "2026-03-09T10:00:00")
    n = p.request_backfill(dates, "bob", "late file", "2026-03-09T10:00:00", counts)
    with pytest.raises(NotAuthorised):
        p.approve_backfill(n, " BOB", "ok", "2026-03-09T10:00:00")
    with pytest.raises(NotAuthorised):
        p.reject_backfill(n, "bob", "no")
    p.approve_backfill(n, "cy", "read the plan", "2026-03-09T10:00:00")
    for when, have, why in (("2026-03-10T11:00:00", counts, "expired"), ("2026-03-09T11:00:00", counts | {"2026-03-02": 6}, "changed")):
        with pytest.raises(NotAuthorised, match=why):
            p.authorise(dates, have, when, n)
    assert p.authorise(dates, counts, "2026-03-09T11:00:00", n)["protected"] == ["2026-03-02"]
    p.consume(n, "2026-03-09T11:30:00")
    with pytest.raises(NotAuthorised, match="used"):
        p.authorise(dates, counts, "2026-03-09T11:40:00", n)


def test_dag_order_retries_gates_and_exit_codes():
    log, tries = [], []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise Transient("not yet")

    def refuse(_):
        raise Permanent("no")

    mark = lambda name: Task(name, lambda c: log.append(name))
    ok = Dag([Task("b", lambda c: log.append("b"), ("a",)), mark("a"), Task("f", flaky, retries=2)], wait=lambda s: None).run()
    assert log == ["a", "b"] and ok.success and ok.runs["f"].attempts == 3 and ok.exit_code == 0
    bad = Dag([Task("gate", refuse, retries=3, gate=True), Task("x", lambda c: None, ("gate",)), Task("y", lambda c: None, ("x",)), mark("z")]).run()
    assert [bad.runs[n].state for n in ("gate", "x", "y", "z")] == ["failed", "skipped", "skipped", "success"]
    assert bad.runs["gate"].attempts == 1 and bad.exit_code == 1
    late = Dag([mark("a")], sla_s=-1).run()
    assert late.tasks_ok and late.exit_code == 20
    for broken in ([Task("a", refuse, ("b",)), Task("b", refuse, ("a",))], [Task("a", refuse, ("nowhere",))]):
        with pytest.raises(ValueError):
            Dag(broken)


def test_truncated_batch_is_refused_and_lines_are_counted(spark, sf, tmp_path):
    core = feeds.core(spark, sf)
    writers.write_batch(core, f"file:{tmp_path}/core")
    got = ingest.read_batch(spark, f"file:{tmp_path}/core")
    assert got.ok and got.parsed_count == core.count()
    file = next((tmp_path / "core").glob("part-*"))
    lines = file.read_text().splitlines()
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "f.txt").write_text("\n".join([lines[0], "", *lines[1:]]) + "\n")
    moved = ingest.read_batch(spark, f"file:{tmp_path}/blank").records.agg(F.min("line_no")).first()[0]
    assert moved == 3  # the blank line counts
    for name, change in (("cut", lines[:-5] + lines[-1:]), ("bare", lines[:-1]), ("twice", lines + lines[-1:]), ("bad", lines[:5] + ["16" + "x" * 56] + lines[5:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.txt").write_text("\n".join(change) + "\n")
        with pytest.raises(ControlTotalMismatch):
            ingest.read_batch(spark, f"file:{tmp_path}/{name}")


def test_event_lines_reject_what_is_missing_null_or_not_whole(spark, tmp_path):
    good = '{"ref":"R","business_date":"2026-03-02","account":"A","amount_minor":5,"currency":"USD","kind":"payment","seq":1}'
    bad = [good.replace('"ref":"R",', ""), good.replace('"R"', "null"), good.replace(":5,", ":5.5,"), good.replace("2026-03-02", "2026-13-02"), "{", good.replace(":5,", ':"5",')]
    (tmp_path / "e.jsonl").write_text("\n".join([good, *bad]) + "\n")
    got = ingest.read_events(spark, f"file:{tmp_path}/e.jsonl")
    assert got.parsed_count == 1 and not got.ok
    assert sorted(r["line_no"] for r in got.rejects.collect()) == [2, 3, 4, 5, 6, 7]


def test_mart_replaces_one_date_and_drops_an_empty_one(spark, tmp_path):
    m = Mart(spark, f"file:{tmp_path}/m")
    rows = lambda *v: spark.createDataFrame([("R", "A", x, "USD", "payment", "core", "f", i, d) for i, (x, d) in enumerate(v)], FACTS["fct_source_record"].replace("business_date date", "business_date string")).withColumn("business_date", F.col("business_date").cast("date"))
    assert m.dates().count() == 0
    m.replace("fct_source_record", "2026-03-02", rows((1, "2026-03-02"), (2, "2026-03-03")))
    m.replace("fct_source_record", "2026-03-03", rows((9, "2026-03-03")))
    assert m.replace("fct_source_record", "2026-03-02", rows((5, "2026-03-02"))) == 1
    assert sorted(r["amount_minor"] for r in m.table("fct_source_record").collect()) == [5, 9]
    m.replace("fct_source_record", "2026-03-02", rows((1, "2026-03-09")))
    assert [str(r[0]) for r in m.dates().collect()] == ["2026-03-03"]


def test_a_batch_without_a_seal_does_not_count(spark, tmp_path):
    """What an append leaves behind that stopped between its events and its seal."""
    from tieout.operators.ledger import Ledger

    root = f"file:{tmp_path}/ledger"
    ledger = Ledger(spark, root, "ref string, n bigint")
    rows = lambda *r: spark.createDataFrame(list(r), "ref string, n bigint")
    assert ledger.append(rows(("a", 1), ("b", 2)), ["ref"]) == 2
    spark.createDataFrame([(3, "half", 9, "x")], "event_id bigint, ref string, n bigint, row_hash string").write.parquet(f"{root}/events/batch=1/draft=half")
    assert ledger.audit() == 2 and {r["ref"] for r in ledger.events().collect()} == {"a", "b"}
    assert Ledger(spark, root, "ref string, n bigint").append(rows(("c", 3)), ["ref"]) == 1
    assert ledger.audit() == 3 and {(r["event_id"], r["ref"]) for r in ledger.events().collect()} == {(1, "a"), (2, "b"), (3, "c")}


