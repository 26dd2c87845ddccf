import re

import pytest

from tieout import cli
from tieout.plans import backfill
from tieout.sources import feeds


@pytest.fixture(scope="module")
def made(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    assert cli.main(["generate", "--tables", sf, "--feeds", f"{root}/feeds"]) == 0
    return root


@pytest.fixture(autouse=True)
def one_session(monkeypatch, spark):
    monkeypatch.setattr(cli, "session", lambda: spark)


def args(made, command, *more):
    return [command, "--feeds", f"{made}/feeds", "--store", f"{made}/store", "--as-of", feeds.AS_OF, "--now", "2026-03-09 08:00:00", *more]


def test_reports(made, capsys):
    assert cli.main(args(made, "recon")) == 0
    assert "amount_fee" in capsys.readouterr().out
    assert cli.main(["completeness", "--feeds", f"{made}/feeds", "--now", feeds.CLOSE]) == 0
    assert "INCOMPLETE" in capsys.readouterr().out


def test_run_then_workflow_and_approvals(made, capsys):
    assert cli.main(args(made, "run", "--date", "2026-03-03")) in (0, 20)
    out = capsys.readouterr().out
    assert "verify_controls" in out and len(re.findall(r"^  part-\S+:\d+ TX", out, re.M)) == 6
    assert cli.main(args(made, "workflow")) == 0
    assert "chain intact" in capsys.readouterr().out
    assert cli.main(args(made, "approvals", "--sign-off", "2026-03-03", "--by", "ann")) == 0
    assert cli.main(args(made, "backfill", "--first", "2026-03-03", "--last", "2026-03-03")) == 2  # a closed date
    assert "closed dates" in capsys.readouterr().err


def test_missing_feed_fails_the_run(made):
    assert cli.main(["run", "--feeds", f"{made}/nowhere", "--store", f"{made}/s2", "--date", "2026-03-03"]) == 1


def test_backfill_over_the_landed_feeds(made, capsys):
    assert cli.main(args(made, "backfill", "--first", "2026-03-04", "--last", "2026-03-05", "--dry-run")) == 0
    assert "0 done" in capsys.readouterr().out
    assert cli.main(args(made, "backfill", "--first", "2026-03-04", "--last", "2026-03-04")) == 0
    assert re.search(r"2026-03-04 source_rows: 0 -> \d+ \(new\)", capsys.readouterr().out)


def test_outcome_lists_few_unchanged_dates():
    days = [f"2026-03-{i:02d}" for i in range(1, 10)]
    same = [{"date": d, "metric": "breaks", "before": 1, "after": 1, "state": "unchanged"} for d in days[:-1]]
    out = backfill.Outcome(0, done=days, changes=[*same, {"date": days[-1], "metric": "breaks", "before": 1, "after": 2, "state": "moved"}])
    assert backfill.render(out).splitlines()[1:] == ["  2026-03-09 breaks: 1 -> 2 (moved)", "  unchanged: 2026-03-01, 2026-03-02, 2026-03-03, 2026-03-04, 2026-03-05, 2026-03-06 and 2 more"]
