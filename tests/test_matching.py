import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tieout.functions.calendar import business_days
from tieout.operators import matching
from tieout.policy import Policy

SCHEMA = "ref string, business_date string, account string, amount_minor bigint, currency string, kind string, source string, source_file string, line_no bigint"


def frame(spark, rows, source):
    full = [(ref, day, "A1", amount, currency, "payment", source, "f", i) for i, (ref, day, amount, currency) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("business_date", F.col("business_date").cast("date"))


FRIDAY, SATURDAY, MONDAY, TUESDAY = "2026-03-06", "2026-03-07", "2026-03-09", "2026-03-10"
CASES = [
    ("exact", [(FRIDAY, 100, "USD")], [(FRIDAY, 100, "USD")]),
    ("timing", [(FRIDAY, 100, "USD")], [(MONDAY, 100, "USD")]),
    ("timing", [(FRIDAY, 100, "USD")], [(SATURDAY, 100, "USD")]),  # no business day apart, but another date
    ("timing", [(FRIDAY, 100, "USD")], [(FRIDAY, 100, "JPY")]),  # the timing step does not look at currencies
    ("amount_fx", [(FRIDAY, 100, "EUR")], [(TUESDAY, 100, "EUR")]),  # no difference is within rounding
    ("amount_unknown", [(FRIDAY, 100, "USD")], [(TUESDAY, 100, "USD")]),
    ("sign", [(FRIDAY, 100, "USD")], [(FRIDAY, -100, "USD")]),
    ("amount_fx", [(FRIDAY, 100, "EUR")], [(FRIDAY, 102, "EUR")]),
    ("amount_unknown", [(FRIDAY, 100, "USD")], [(FRIDAY, 102, "USD")]),
    ("amount_fee", [(FRIDAY, 100_000, "USD")], [(FRIDAY, 99_700, "USD")]),
    ("amount_fee", [(FRIDAY, -100_000, "USD")], [(FRIDAY, -99_700, "USD")]),
    ("amount_unknown", [(FRIDAY, 100_000, "USD")], [(FRIDAY, 99_649, "USD")]),  # over 35 basis points
    ("amount_unknown", [(FRIDAY, 100_000, "USD")], [(FRIDAY, 100_300, "USD")]),  # a fee is never paid out
    ("amount_fee", [(FRIDAY, 1_000, "USD")], [(FRIDAY, 975, "USD")]),  # the least fee
    ("duplicate", [(FRIDAY, 100, "USD")], [(FRIDAY, 100, "USD"), (FRIDAY, 7, "USD")]),
    ("exact", [(FRIDAY, 100, "USD"), (FRIDAY, 5, "USD")], [(FRIDAY, 100, "USD"), (FRIDAY, 6, "USD")]),  # first copies only
    ("missing", [(FRIDAY, 100, "USD"), (FRIDAY, 100, "USD")], []),
    ("missing", [], [(FRIDAY, 100, "USD")]),
]


def test_cascade_order(spark):
    core = frame(spark, [(f"R{i}", *r) for i, (_, c, _) in enumerate(CASES) for r in c], "core")
    proc = frame(spark, [(f"R{i}", *r) for i, (_, _, p) in enumerate(CASES) for r in p], "processor")
    got = {r["ref"]: r for r in matching.verdicts(core, proc, "2026-03-20").collect()}
    assert [got[f"R{i}"]["verdict"] for i in range(len(CASES))] == [c[0] for c in CASES]
    assert got["R15"]["ignored_copies"] == 1
    breaks = matching.breaks(core, proc, "2026-03-20").collect()
    assert sum(b["ref"] == "R16" for b in breaks) == 2  # one for each record
    assert all(b["detail"] for b in breaks)
    rate = matching.match_rate(matching.verdicts(core, proc, "2026-03-20")).first()
    assert rate["universe"] == len(CASES) and rate["matched_exact"] == 3


def test_strict_currency_and_empty_sides(spark):
    core, proc = frame(spark, [("A", FRIDAY, 1, "USD")], "core"), frame(spark, [("A", FRIDAY, 1, "JPY")], "processor")
    assert matching.verdicts(core, proc, MONDAY, Policy(strict_currency=True)).first()["verdict"] == "currency"
    none = core.limit(0)
    assert matching.verdicts(none, none, MONDAY).count() == 0
    assert matching.match_rate(matching.verdicts(none, none, MONDAY)).first()["rate_ppm"] is None


def test_every_reference_has_one_verdict_and_sides_mirror(spark):
    rnd = random.Random(5)
    make = lambda: [(f"R{rnd.randrange(60)}", rnd.choice([FRIDAY, MONDAY, TUESDAY]), rnd.randrange(-300, 300), rnd.choice(["USD", "EUR"])) for _ in range(120)]
    core, proc = frame(spark, make(), "core"), frame(spark, make(), "processor")
    v = matching.verdicts(core, proc, "2026-03-20")
    refs = [r["ref"] for r in v.select("ref").collect()]
    assert len(refs) == len(set(refs)) == core.select("ref").union(proc.select("ref")).distinct().count()
    turned = matching.verdicts(proc, core, "2026-03-20")
    missing = lambda df: {r["ref"] for r in df.where("verdict = 'missing'").collect()}
    assert missing(v) == missing(turned)


def test_one_shuffle_and_no_join(spark, sf):
    from tieout.sources import feeds

    plan = matching.verdicts(feeds.core(spark, sf), feeds.processor(spark, sf), MONDAY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_breaks_fill_all_shuffle_partitions_and_sort_once(spark, sf):
    from tieout.sources import feeds

    found = matching.breaks(feeds.core(spark, sf), feeds.processor(spark, sf), MONDAY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert found.rdd.getNumPartitions() == 4
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() == 4


@pytest.mark.parametrize("records", [None, 2_984])
def test_tasks_grow_in_number_with_the_records_whatever_the_session_says(spark, sf, monkeypatch, records):
    from tieout.sources import feeds

    core, proc = feeds.core(spark, sf), feeds.processor(spark, sf)
    found = matching.breaks(core, proc, MONDAY)
    assert found.rdd.getNumPartitions() == 4 and core.count() + proc.count() == 2_984
    monkeypatch.setattr(matching, "TASK_RECORDS", 300)
    dealt = matching.breaks(core, proc, MONDAY, records=records)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.select(F.spark_partition_id().alias("task")).distinct().count() == 10
    assert sorted(map(str, dealt.collect())) == sorted(map(str, found.collect()))


@pytest.mark.parametrize("name", ["aging_tiers", "queue_open_items"])
def test_queries_on_breaks_run_in_as_many_tasks(spark, sf, monkeypatch, name):
    from tieout import catalog

    rows = sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(matching, "TASK_RECORDS", 300)
    found = catalog.QUERIES[name](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 10), REPARTITION_BY_NUM") == 1
    assert sorted(map(str, found.collect())) == rows


@pytest.mark.parametrize("holidays", [None, ["2026-03-10", "2026-03-14"]])
def test_business_days_equal_a_day_loop(spark, holidays):
    days = [dt.date(2026, 2, 25) + dt.timedelta(days=i) for i in range(24)]

    def loop(a, b):
        a, b = min(a, b), max(a, b)
        steps = [a + dt.timedelta(days=i + 1) for i in range((b - a).days)]
        return sum(d.weekday() < 5 and str(d) not in (holidays or []) for d in steps)

    pairs = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    got = pairs.select("a", "b", business_days(F.col("a"), F.col("b"), holidays).alias("n")).collect()
    assert all(r["n"] == loop(r["a"], r["b"]) for r in got)


def test_whole_currency_codes_are_compared_and_returned(spark):
    core, proc = frame(spark, [("A", FRIDAY, 5, "TOKENUSDX"), ("B", FRIDAY, 5, "TOKENUSDX")], "core"), frame(spark, [("A", FRIDAY, 5, "TOKENUSDY"), ("B", FRIDAY, 5, "TOKENUSDX")], "processor")
    got = {r["ref"]: r for r in matching.verdicts(core, proc, MONDAY).collect()}
    assert got["A"]["verdict"] == "timing" and got["B"]["verdict"] == "exact"  # the timing step does not look at currencies
    assert (got["A"]["core_currency"], got["A"]["proc_currency"]) == ("TOKENUSDX", "TOKENUSDY")
    strict = {r["ref"]: r["verdict"] for r in matching.verdicts(core, proc, MONDAY, Policy(strict_currency=True)).collect()}
    assert strict == {"A": "currency", "B": "exact"}


def test_the_first_copy_is_one_record_in_file_order(spark):
    rows = [("A", FRIDAY, 2, "EUR", "g", 1), ("A", MONDAY, 1, "USD", "f", 1), ("A", TUESDAY, 3, "GBP", "f", None)]
    core = spark.createDataFrame([(r, d, "A1", a, c, "payment", "core", f, n) for r, d, a, c, f, n in rows], SCHEMA).withColumn("business_date", F.col("business_date").cast("date"))
    for part in (core, core.orderBy("amount_minor"), core.orderBy(F.desc("amount_minor"))):
        row = matching.pair(part, core.limit(0)).first()
        assert (row["n_core"], row["core_amount"], str(row["core_business_date"]), row["core_currency"]) == (3, 3, TUESDAY, "GBP")
        row = matching.pair(part.where("line_no is not null"), core.limit(0)).first()
        assert (row["core_amount"], str(row["core_business_date"]), row["core_currency"]) == (1, MONDAY, "USD")


def test_the_queue_pairs_the_feeds_once_for_each_use(spark, sf):
    """The first intake, the second one, and what is known in between."""
    from tieout import catalog

    plan = catalog.queue_intake(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 3
