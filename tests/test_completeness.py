import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tieout.operators import completeness, scan
from tieout.policy import Policy
from tieout.streaming import completeness as live
from tieout.streaming import silence


def simulate(arrivals, grace):
    """Arrival by arrival, with every number kept."""
    seen, first, high, duplicates, late = set(), None, None, 0, 0
    for seq in arrivals:
        if seq in seen:
            duplicates += 1
            continue
        if first is None:
            first = high = seq
        elif seq < high:
            late += 1
        seen.add(seq)
        high = max(high, seq)
    holes, run = [], None
    for s in range(first, high + 1):
        if s not in seen:
            run = (run[0], s) if run else (s, s)
        elif run:
            holes.append((*run, "missing" if high - run[1] >= grace else "open"))
            run = None
    return (len(seen), duplicates, late, first, high), holes


def stream(rnd):
    numbers = [i for i in range(1, 60) if rnd.random() > 0.15]
    for _ in range(6):
        numbers.insert(rnd.randrange(len(numbers)), rnd.choice(numbers))
    for _ in range(5):
        i = rnd.randrange(len(numbers))
        numbers.insert(rnd.randrange(len(numbers)), numbers.pop(i))
    return numbers


@pytest.mark.parametrize("seed", range(3))
def test_batch_and_state_equal_the_simulation(spark, seed):
    rnd = random.Random(seed)
    policy = Policy(reorder_grace=10)
    streams = {f"p{i}": stream(rnd) for i in range(12)}
    rows = [(p, s, i) for p, numbers in streams.items() for i, s in enumerate(numbers)]
    events = spark.createDataFrame(rows, "partition string, seq bigint, arrival bigint")
    stats = {r["partition"]: (r["events"], r["duplicates"], r["out_of_order"], r["first_seq"], r["high"]) for r in completeness.partition_stats(events).collect()}
    holes = {}
    for r in completeness.gaps(events, policy).collect():
        holes.setdefault(r["partition"], []).append((r["missing_from"], r["missing_to"], r["status"]))
    for p, numbers in streams.items():
        want, gaps = simulate(numbers, 10)
        assert stats[p] == want
        assert sorted(holes.get(p, [])) == gaps
        held = live.Sequence()
        cuts = sorted(rnd.sample(range(len(numbers)), 4))
        for a, z in zip([0, *cuts], [*cuts, len(numbers)]):
            held.observe(numbers[a:z])
        assert (held.events, held.duplicates, held.out_of_order, held.first, held.high) == want
        assert sorted(held.holes.items()) == [(a, b) for a, b, _ in gaps]


def test_silence_lag_and_verdict(spark):
    events = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "partition string, seq bigint, arrival bigint")
    beats = spark.createDataFrame([("a", "2026-03-06 10:00:00", 2, 1), ("b", "2026-03-06 09:50:00", 4, 2)], "partition string, at string, producer_high_water bigint, arrival bigint").withColumn("at", F.col("at").cast("timestamp"))
    state = {r["partition"]: r for r in completeness.heartbeat_state(events, beats, "2026-03-06 10:05:00", ["a", "b", "c"]).collect()}
    assert not state["a"]["stale"]  # exactly 300 s is not silence
    assert state["b"]["stale"] and state["b"]["lag"] == 3
    assert state["c"]["stale"] and state["c"]["last_seen"] is None
    assert not completeness.report(events, beats, "2026-03-06 10:05:00").first()["complete"]
    fine = completeness.report(events.where("partition = 'a'"), beats.where("partition = 'a'"), "2026-03-06 10:00:00").first()
    assert fine["complete"]


def test_head_loss_only_with_an_expected_start(spark):
    events = spark.createDataFrame([("a", 5, 1), ("a", 6, 2)], "partition string, seq bigint, arrival bigint")
    assert completeness.gaps(events).count() == 0
    hole = completeness.gaps(events, expected_first_seq=1).first()
    assert (hole["missing_from"], hole["missing_to"]) == (1, 4)


def test_late_numbers_are_listed(spark):
    events = spark.createDataFrame([("a", s, i) for i, s in enumerate([1, 5, 3, 2, 6])], "partition string, seq bigint, arrival bigint")
    assert [(r["from_seq"], r["to_seq"]) for r in completeness.closed_late(events).collect()] == [(2, 3)]


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_spans_change_nothing(spark, monkeypatch, span):
    rnd = random.Random(span)
    numbers = stream(rnd)
    events = spark.createDataFrame([("p", s, i) for i, s in enumerate(numbers)], "partition string, seq bigint, arrival bigint")
    first = completeness.first_arrivals(events)
    want, high = {}, None
    for s in numbers:
        if s not in want:
            want[s], high = high, max(high or 0, s)
    assert {r["seq"]: r["m"] for r in scan.max_before(first, "partition", "arrival", "seq", "m", span).collect()} == want
    order = sorted(want)
    assert {r["seq"]: (r["n"], r["i"]) for r in scan.next_value(scan.numbered(first, "partition", "seq", "i", span), "partition", "seq", "n", span).collect()} == {s: (n, i) for i, (s, n) in enumerate(zip(order, [*order[1:], None]), 1)}


def test_one_partition_keeps_many_tasks_busy(spark):
    events = spark.range(4000).select(F.lit("p").alias("partition"), F.col("id").alias("seq"), F.col("id").alias("arrival"))
    scanned = scan.max_before(completeness.first_arrivals(events), "partition", "arrival", "seq", "m", span=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = scanned.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 4000


def test_a_partition_of_the_derived_stream_is_numbered_by_many_tasks(spark, tmp_path):
    from tieout.sources import feeds

    # Ids far apart lie in spans of their own; one row has no id and is the first.
    ids = [None, *(i * scan.SPAN // 3 for i in range(60))]
    spark.createDataFrame([(i, 4 * (n % 2)) for n, i in enumerate(ids)], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    events = feeds.stream_events(spark, str(tmp_path))
    assert [(r["seq"], r["arrival"]) for r in events.orderBy("seq").collect()] == list(enumerate(ids, 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = events.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1


def test_many_holes_and_late_numbers_take_seconds():
    held = live.Sequence()
    began = time.perf_counter()
    held.observe(range(0, 200_000, 2))
    assert len(held.holes) == 99_999
    late = list(range(1, 200_001, 2))
    random.Random(1).shuffle(late)
    for i in range(0, len(late), 1000):
        held.observe(late[i : i + 1000])
    assert held.holes == {} and held.intervals == {0: 199_999} and held.out_of_order == 99_999
    held.observe([*range(-10, 0, 2), 5, 5])
    assert held.duplicates == 2 and held.first == 0 and held.holes == {} and len(held.intervals) == 6
    assert time.perf_counter() - began < 10


def test_the_tracker_writes_what_has_changed(spark, tmp_path):
    """Holes that open, shrink, split and close over micro-batches, and a restart between them."""
    batches = [[5, 6, 9, 20], [7, 12, 3, 6], [8, 10, 11, 21, 90], [13, 14, 15, 16, 17, 18, 19]]
    for part in (batches[:2], batches):
        for i, numbers in enumerate(part):
            (tmp_path / f"in{i}").mkdir(exist_ok=True)
            (tmp_path / f"in{i}" / "f.json").write_text("\n".join(json.dumps({"partition": "p", "seq": s, "arrival": 100 * i + j}) for j, s in enumerate(numbers)))
        changes = live.run_available(spark, f"{tmp_path}/in*", f"{tmp_path}/out", f"{tmp_path}/state", 1)
    assert live.figures_of(changes).first()[1:] == (5, 90, 19, 1, 13)
    assert {(r["missing_from"], r["missing_to"], r["status"]) for r in live.gaps_of(changes, 50).collect()} == {(22, 89, "open")}
    assert {(r["missing_from"], r["missing_to"]) for r in changes.where("batch = 1 and missing_from is not null").collect()} == {(7, None), (8, 8), (10, 11), (13, 19)}


def test_timers_tell_silence_as_the_batch_does(spark, tmp_path):
    day = "2026-03-06 "
    row = lambda kind, p, at, water=None, i=0: {"kind": kind, "partition": p, "at": f"{day}{at}" if at else None, "producer_high_water": water, "arrival": i}
    files = [
        [row("expected", "c", None), row("expected", "a", None), row("beat", "a", "10:00:00", 5, 1), row("beat", "b", "10:00:00", 7, 2)],
        [row("beat", "a", "10:03:00", 6, 3), row("clock", silence.CLOCK, "10:05:00")],
        [row("clock", silence.CLOCK, "10:06:00")],
        [row("beat", "b", "10:07:00", 9, 4), row("clock", silence.CLOCK, "10:20:00")],
    ]
    for i, rows in enumerate(files):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "f.json").write_text("\n".join(map(json.dumps, rows)))
    changes = silence.run_available(spark, f"{tmp_path}/in*", f"{tmp_path}/out", f"{tmp_path}/state", 1).persist()
    beats = spark.createDataFrame([(r["partition"], r["at"], r["producer_high_water"], r["arrival"]) for f in files for r in f if r["kind"] == "beat"], "partition string, at string, producer_high_water bigint, arrival bigint").withColumn("at", F.col("at").cast("timestamp"))
    nothing = spark.createDataFrame([], "partition string, seq bigint")
    for now in ("10:00:00", "10:05:00", "10:05:01", "10:06:00", "10:08:00", "10:20:00"):
        until = beats.where(F.col("at") <= F.lit(f"{day}{now}").cast("timestamp"))
        want = completeness.heartbeat_state(nothing, until, f"{day}{now}", ["a", "c"]).select("partition", "last_seen", "producer_high_water", "stale")
        assert sorted(silence.state_of(changes, f"{day}{now}").collect()) == sorted(want.collect()), now
