"""Line numbers over splits and parts, and feeds written in parts."""

import re

import pytest
from pyspark.sql import functions as F

from tieout.sources import feeds, ingest, writers


@pytest.fixture
def small_splits(spark):
    held = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path, small_splits):
    """Parts of very different sizes, empty ones, blank lines, lines longer than a split."""
    sizes = [700, 0, 3, 1500, 1]
    want, n = [], 0
    for i, size in enumerate(sizes):
        lines = ["" if j % 7 == 3 else f"line {i} {j} " + "x" * (5000 if j == 50 else j % 90) for j in range(size)]
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{x}\n" for x in lines))
        for x in lines:
            n += 1
            want.append((f"part-{i:05d}.txt", n, x))
    df = ingest.numbered_lines(spark, f"file:{tmp_path}")
    assert ingest.lines_of(spark, f"file:{tmp_path}").rdd.getNumPartitions() > 10
    assert sorted((r["source_file"], r["line_no"], r["value"]) for r in df.collect()) == want


def test_lines_are_not_exchanged(spark, tmp_path, small_splits):
    """Only one row per split is: no exchange has a line's value among its columns."""
    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    plan = plan_of(ingest.numbered_lines(spark, f"file:{tmp_path}"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for exchange in re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single)\S*.*", plan):
        assert "value" not in exchange and "i#" not in exchange
    assert "Window" in plan and "row_number" not in plan


@pytest.mark.parametrize("parts", ["1", "6"])
def test_a_batch_in_parts_reads_as_one(spark, sf, tmp_path, small_splits, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_batch(feeds.core(spark, sf), f"file:{tmp_path}/core")
        writers.write_events(feeds.processor(spark, sf), f"file:{tmp_path}/events")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = sorted((tmp_path / "core").glob("part-*"))
    assert (len(written) > 3) == (parts == "6")
    lines = [x for p in written for x in p.read_text().splitlines()]
    assert lines[0].startswith("01") and lines[-1].startswith("99")
    got = ingest.read_batch(spark, f"file:{tmp_path}/core")
    by_line = {r["line_no"]: r["ref"] for r in got.records.collect()}
    assert by_line == {i: x[2:18].strip() for i, x in enumerate(lines, 1) if x.startswith("16")}
    assert [by_line[n] for n in sorted(by_line)] == [r["ref"] for r in feeds.core(spark, sf).orderBy("line_no").collect()]
    events = ingest.read_events(spark, f"file:{tmp_path}/events")
    assert [r["ref"] for r in events.records.orderBy("line_no").collect()] == [r["ref"] for r in feeds.processor(spark, sf).orderBy("line_no").collect()]


def test_totals_and_offsets_are_one_pass(spark, tmp_path):
    """A second trailer, a header in the middle and rejects in two files."""
    record = "16" + "R".ljust(16) + "20260302" + "A".ljust(6) + "USD" + "5".rjust(15) + "payment".ljust(8)
    (tmp_path / "a").write_text(f"01 HEAD\n{record}\n\n{record}\n")
    (tmp_path / "b").write_text(f"01 AGAIN\nxx\n{record}\n99{'3'.rjust(10, '0')}{'15'.rjust(20, '0')}\n")
    lines = ingest.lines_of(spark, f"file:{tmp_path}")
    splits = ingest.surveyed(ingest.parsed_width(lines))
    assert splits.agg(*(F.sum(c) for c in ("lines", "n", "total", "bad", "trailers"))).first()[:] == (8, 3, 15, 1, 1)
    records, rejects = ingest.fixed_width(ingest.numbered(lines, splits))
    assert sorted((r["source_file"], r["line_no"]) for r in records.collect()) == [("a", 2), ("a", 4), ("b", 7)]
    assert [(r["source_file"], r["line_no"], r["reason"]) for r in rejects.collect()] == [("b", 6, "unknown record code")]


def test_files_that_are_split_otherwise_are_refused(spark, tmp_path, small_splits):
    """The second pass must not number lines by the counts of other splits."""
    (tmp_path / "f").write_text("".join(f"line {i}\n" for i in range(3000)))
    df = ingest.numbered_lines(spark, f"file:{tmp_path}")
    lines = ingest.lines_of(spark, f"file:{tmp_path}")
    splits = lines.groupBy("f", "b").agg(F.count("*").alias("lines"), F.min("i").alias("start")).persist()
    assert splits.count() > 5 and df.agg(F.max("line_no")).first()[0] == 3000
    assert spark.conf.get(ingest.MIN_PARTITIONS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    with pytest.raises(Exception, match="split otherwise"):
        ingest.numbered(lines, splits).collect()


def test_an_empty_feed(spark, tmp_path):
    (tmp_path / "f").write_text("")
    assert ingest.numbered_lines(spark, f"file:{tmp_path}").count() == 0
    assert ingest.read_events(spark, f"file:{tmp_path}").parsed_count == 0
    with pytest.raises(ingest.ControlTotalMismatch, match="0 trailers"):
        ingest.read_batch(spark, f"file:{tmp_path}")
