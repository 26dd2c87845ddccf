"""Commits of the mart: one step, two writers, versions, and what is left behind."""

import pytest
from pyspark.sql import functions as F

from tieout.errors import Conflict
from tieout.operators.mart import FACTS, Mart
from tieout.sources.files import Files, Versioned

DAY, OTHER = "2026-03-02", "2026-03-03"


def records(spark, *rows):
    """(amount, date, source) each."""
    full = [(f"R{i}", "A", x, "USD", "payment", source, "f", i, d) for i, (x, d, source) in enumerate(rows)]
    return dated(spark, full, "fct_source_record")


def breaks(spark, *days):
    return dated(spark, [(f"R{i}", "sign", "open", 1, -1, 2, 0, "T0", d) for i, d in enumerate(days)], "fct_break")


def dated(spark, rows, name):
    return spark.createDataFrame(rows, FACTS[name].replace("business_date date", "business_date string")).withColumn("business_date", F.col("business_date").cast("date"))


def seen(view):
    """Everything a reader sees of a date, in all tables, by reading the data."""
    count = lambda name: {str(r[0]): r[1] for r in view.table(name).groupBy("business_date").count().collect()}
    assert all(count(name) == view.rows(name) for name in FACTS)
    return {name: view.rows(name) for name in FACTS}


def old_and_new(spark, root):
    store = Mart(spark, root)
    store.load_days([DAY, OTHER], records(spark, *((i, DAY, "core") for i in range(5)), (9, OTHER, "core")), breaks(spark, DAY, OTHER))
    return store


def test_a_reader_at_every_step_sees_the_old_or_the_new_day(spark, tmp_path):
    root = f"file:{tmp_path}/m"
    store = old_and_new(spark, root)
    old = seen(store.view())
    pinned = store.view()
    stage = store.stage([DAY])
    assert stage.put("fct_source_record", records(spark, *((i, DAY, "processor") for i in range(3)))) == {DAY: 5}
    assert seen(Mart(spark, root).view()) == old
    assert stage.put("fct_break", breaks(spark)) == {DAY: 1}
    assert seen(Mart(spark, root).view()) == old
    assert stage.aggregate() == {DAY: 1}
    assert seen(Mart(spark, root).view()) == old
    new = {"fct_source_record": {DAY: 3, OTHER: 1}, "fct_break": {OTHER: 1}, "agg_daily_settlement": {DAY: 1, OTHER: 1}}
    assert seen(stage.view()) == new
    stage.publish()
    assert seen(Mart(spark, root).view()) == new
    assert seen(pinned) == old  # who opened before keeps what it saw
    assert seen(store.view(1)) == old


def test_opening_and_reading_writes_nothing(spark, tmp_path):
    store = Mart(spark, f"file:{tmp_path}/none")
    assert store.table("fct_break").count() == 0 and store.rows_for("fct_break", DAY) == 0
    assert not (tmp_path / "none").exists()
    store = old_and_new(spark, f"file:{tmp_path}/m")
    before = sorted(map(str, (tmp_path / "m").rglob("*")))
    seen(Mart(spark, f"file:{tmp_path}/m").view())
    assert sorted(map(str, (tmp_path / "m").rglob("*"))) == before


def test_writers_of_different_dates_both_succeed_and_of_one_date_one_does(spark, tmp_path):
    store = old_and_new(spark, f"file:{tmp_path}/m")
    first, second, third = store.stage([DAY]), store.stage([OTHER]), store.stage([DAY])
    first.put("fct_source_record", records(spark, (1, DAY, "core")))
    second.put("fct_source_record", records(spark, (1, OTHER, "core"), (2, OTHER, "core")))
    third.put("fct_source_record", records(spark, (7, DAY, "core"), (8, DAY, "core")))
    first.publish()
    second.publish()
    with pytest.raises(Conflict):
        third.publish()
    assert store.view().rows("fct_source_record") == {DAY: 1, OTHER: 2}


def test_two_writers_cannot_take_one_version(spark, tmp_path, monkeypatch):
    """Both have read the same manifest; the second sees its number taken and builds on the first."""
    store = old_and_new(spark, f"file:{tmp_path}/m")
    stage = store.stage([DAY])
    stage.put("fct_break", breaks(spark, DAY, DAY, DAY))
    swap, beaten = Versioned.swap, []

    def slow(self, version, value):
        if not beaten:
            beaten.append(version)
            Mart(spark, store.root).replace("fct_break", OTHER, breaks(spark, OTHER, OTHER))
        return swap(self, version, value)

    monkeypatch.setattr(Versioned, "swap", slow)
    stage.publish()
    assert store.view().rows("fct_break") == {DAY: 3, OTHER: 2}


def test_a_commit_that_dies_leaves_the_mart_as_it_was(spark, tmp_path):
    store = old_and_new(spark, f"file:{tmp_path}/m")
    old = seen(store.view())
    store.stage([DAY]).put("fct_source_record", records(spark, (1, DAY, "core")))
    assert seen(Mart(spark, store.root).view()) == old
    assert store.vacuum() == 0  # it may be a commit in the making
    assert store.vacuum(older_than_hours=0) == 1
    assert seen(store.view()) == old
    for i in range(3):
        store.replace("fct_break", DAY, breaks(spark, *[DAY] * (i + 1)))
    assert store.vacuum(keep=2, older_than_hours=0) == 2
    assert store.view().rows("fct_break")[DAY] == 3 and store.view(store.view().version - 1).table("fct_break").count() == 3
    assert len(Files(spark).names(f"{store.root}/_manifest")) == 2


def test_rows_without_a_date_and_dates_without_rows(spark, tmp_path):
    store = Mart(spark, f"file:{tmp_path}/m")
    assert store.load("fct_break", breaks(spark, DAY, None, OTHER)) == {DAY: 0, OTHER: 0}
    assert store.load("fct_break", breaks(spark, DAY), [DAY, OTHER]) == {DAY: 1, OTHER: 1}
    assert store.view().rows("fct_break") == {DAY: 1}
    assert store.load_days([DAY, OTHER], records(spark), breaks(spark))["agg_daily_settlement"] == {DAY: 0, OTHER: 0}
    assert store.view().rows("fct_source_record") == {}


def test_files_are_put_once_and_values_swapped_in_order(spark, tmp_path):
    files, value = Files(spark), Versioned(spark, f"file:{tmp_path}/v")
    files.put(f"file:{tmp_path}/a/x.txt", "é\n1")
    with pytest.raises(Conflict):
        files.put(f"file:{tmp_path}/a/x.txt", "2")
    assert files.read(f"file:{tmp_path}/a/x.txt") == "é\n1" and files.names(f"file:{tmp_path}/a") == ["x.txt"]
    assert value.read() == (0, None)
    assert value.swap(0, {"n": 1}) == 1 and value.swap(1, {"n": 2}) == 2
    with pytest.raises(Conflict):
        value.swap(1, {"n": 3})
    assert value.read() == (2, {"n": 2}) and value.read(1) == (1, {"n": 1})


def test_files_of_another_store_are_put_once_too(spark, tmp_path):
    """By FileContext's rename, as on a cluster's file system."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./at", f"file:{tmp_path}")
    files = Files(spark)
    files.put("viewfs://box/at/x.txt", "1")
    with pytest.raises(Conflict):
        files.put("viewfs://box/at/x.txt", "2")
    assert (tmp_path / "x.txt").read_text() == "1"


def test_breaks_of_many_tasks_are_few_files(spark, tmp_path):
    store = Mart(spark, str(tmp_path))
    rows = breaks(spark, *[DAY, OTHER] * 40).repartition(16)
    assert store.load("fct_break", rows) == {DAY: 0, OTHER: 0}
    assert seen(store.view())["fct_break"] == {DAY: 40, OTHER: 40}
    assert len(list(tmp_path.glob("fct_break/business_date=*/batch=*/*.parquet"))) == 2
