import pytest
from pyspark.sql import functions as F

from tieout.errors import Claimed, ControlTotalMismatch, NotAuthorised
from tieout.operators.approvals import Periods
from tieout.operators.mart import Mart
from tieout.plans.backfill import State, backfill, run_log, tick
from tieout.plans.landing import Landing
from tieout.plans.pipeline import Day
from tieout.sources import feeds, ingest
from tieout.sources.generate import generate


@pytest.fixture(scope="module")
def paths(spark, sf, tmp_path_factory):
    return generate(spark, sf, f"file:{tmp_path_factory.mktemp('feeds')}")


def day_of(spark, paths, tmp_path):
    landing = Landing(spark, f"file:{tmp_path}/landing")
    landing.land(paths["core"], paths["events"])
    return Day(spark, paths["core"], paths["events"], f"file:{tmp_path}/mart", f"file:{tmp_path}/queue", None, feeds.AS_OF, "2026-03-09 08:00:00", landing=landing)


def test_range_resumes_reports_changes_and_needs_approval(spark, paths, tmp_path):
    day = day_of(spark, paths, tmp_path)
    periods = Periods(spark, f"file:{tmp_path}/control")
    args = (day, "2026-03-01", "2026-03-03", f"file:{tmp_path}/state", periods)
    dry = backfill(*args, dry_run=True)
    assert dry.fingerprint and not (tmp_path / "mart").exists() and not (tmp_path / "state").exists()
    out = backfill(*args)
    assert out.exit_code == 0 and out.done == ["2026-03-02", "2026-03-03"] and out.empty == ["2026-03-01"]
    assert {c["state"] for c in out.changes} == {"new"}
    assert backfill(*args).done == []  # finished dates are not run again
    again = backfill(*args, force=True)
    assert {c["state"] for c in again.changes} == {"unchanged"}
    assert State(spark, f"file:{tmp_path}/state", "x").read()["completed"] == ["2026-03-02", "2026-03-03"]
    periods.sign_off("2026-03-02", "ann", "2026-03-05T10:00:00")
    with pytest.raises(NotAuthorised):
        backfill(*args, force=True)
    mart = Mart(spark, day.mart_root)
    assert mart.rows_for("fct_source_record", "2026-03-02") > 0
    assert mart.table("agg_daily_settlement").agg(F.sum("record_count")).first()[0] == mart.table("fct_source_record").count()
    assert tick(day, f"file:{tmp_path}/runs", "2026-03-04") in (0, 20)
    assert tick(day, f"file:{tmp_path}/runs", "2026-03-01") == 1
    assert [(r["date"], r["exit"] == 1) for r in run_log(spark, f"file:{tmp_path}/runs").collect()] == [("2026-03-01", True), ("2026-03-04", False)]


def test_two_runs_cannot_claim_one_date(spark, tmp_path):
    one, two = State(spark, f"file:{tmp_path}/s", "one"), State(spark, f"file:{tmp_path}/s", "two")
    one.claim("2026-03-02")
    one.claim("2026-03-02")
    two.claim("2026-03-03")
    with pytest.raises(Claimed):
        two.claim("2026-03-02")
    two.claim("2026-03-02", take_over=True)
    with pytest.raises(Claimed):
        one.done("2026-03-02", True)
    two.done("2026-03-02", True)
    two.done("2026-03-03", False)
    assert one.read()["completed"] == ["2026-03-02"] and one.read()["claims"] == {} and len(one.read()["runs"]) == 2


def test_feeds_are_landed_once_and_dates_read_their_folder(spark, paths, tmp_path, monkeypatch):
    landing = Landing(spark, f"file:{tmp_path}/l")
    seal = landing.land(paths["core"], paths["events"])
    core, proc = feeds.core(spark, "/root/testdata/sf0.001"), feeds.processor(spark, "/root/testdata/sf0.001")
    assert seal["sides"]["core"]["declared_count"] == core.count()
    for side, df in (("core", core), ("proc", proc)):
        assert {d: h["rows"] for d, h in seal["days"][side].items()} == {str(r[0]): r[1] for r in df.groupBy("business_date").count().collect()}
        got = landing.day(side, "2026-03-04")
        columns = [c for c in df.columns if c not in ("source_file", "line_no")]
        assert sorted(got.records.select(columns).collect()) == sorted(df.where("business_date = date'2026-03-04'").select(columns).collect())
        assert got.ok and {f.split("/")[-2] for f in got.records.inputFiles()} == {"business_date=2026-03-04"}
    assert landing.day("core", "2020-01-01").records.count() == 0
    monkeypatch.setattr(ingest, "read_batch", lambda *a: pytest.fail("read again"))
    assert landing.land(paths["core"], paths["events"]) == seal


def test_a_landing_parses_each_line_once(spark, paths, tmp_path, monkeypatch):
    (tmp_path / "e").mkdir()
    good = '{"ref":"R%d","business_date":"2026-03-02","account":"A","amount_minor":-7,"currency":"USD","kind":"refund"}'
    (tmp_path / "e" / "p.jsonl").write_text("\n".join([good % 1, "", "{not json", good % 2]) + "\n")
    monkeypatch.setattr(ingest, "surveyed", lambda *a: pytest.fail("parsed for its totals alone"))
    landing = Landing(spark, f"file:{tmp_path}/l")
    seal = landing.land(paths["core"], f"file:{tmp_path}/e")
    assert seal["days"]["proc"] == {"2026-03-02": {"rows": 2, "total": 14}}
    assert seal["sides"]["proc"] == {"declared_count": 2, "declared_total": 14, "rejected": 1}
    assert sorted(r["line_no"] for r in landing.day("proc", "2026-03-02").records.collect()) == [1, 4]
    passed = ingest.pass_events(spark, f"file:{tmp_path}/e")
    assert passed.records.count() == 2
    passed.lines += 1
    with pytest.raises(ControlTotalMismatch):
        passed.ingested()


def test_a_landing_without_a_seal_does_not_count(spark, paths, tmp_path):
    landing = Landing(spark, f"file:{tmp_path}/l")
    (tmp_path / "cut").mkdir()
    core = spark.read.text(paths["core"]).where("value not like '16TX00000000%'")
    core.coalesce(1).write.mode("overwrite").text(f"file:{tmp_path}/cut")
    with pytest.raises(ControlTotalMismatch):
        landing.land(f"file:{tmp_path}/cut", paths["events"])
    assert landing.seal() is None
    with pytest.raises(FileNotFoundError):
        landing.day("core", "2026-03-02")


def test_stream_and_truth_files_read_back(spark, sf, paths):
    columns = ["partition", "seq"]
    assert sorted(ingest.read_transport(spark, paths["transport"]).orderBy("arrival").select(columns).collect()) == sorted(feeds.stream_events(spark, sf).select(columns).collect())
    beats = ["partition", "at", "producer_high_water"]
    assert sorted(ingest.read_heartbeats(spark, paths["heartbeats.json"]).select(beats).collect()) == sorted(feeds.heartbeats(spark, sf).select(beats).collect())
    truth = ingest.read_truth(spark, paths["break_truth.json"], "ref string, break_type string")
    assert sorted(truth.collect()) == sorted(feeds.planted(spark, sf).collect())
    stream = ingest.read_truth(spark, paths["stream_truth.json"], "dropped_events bigint, delayed_events bigint, silent_partition string").first()
    assert tuple(stream) == (feeds.DROPPED, feeds.DELAYED, feeds.SILENT)
