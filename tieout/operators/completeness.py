"""Stream completeness over a finished stream: holes, repeats, disorder, silence and lag.

No window runs over a whole stream partition: see ``scan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.operators import scan
from tieout.policy import DEFAULT, Policy


def first_arrivals(events: DataFrame) -> DataFrame:
    """(partition, seq, arrival, copies): the first arrival of each number."""
    return events.groupBy("partition", "seq").agg(F.min("arrival").alias("arrival"), F.count("*").alias("copies"))


def _high_before(events: DataFrame) -> DataFrame:
    """First arrivals with the highest number that came before; repeats come later than what they repeat."""
    return scan.max_before(first_arrivals(events), "partition", "arrival", "seq", "high_before", over=events)


def partition_stats(events: DataFrame) -> DataFrame:
    """Per partition: events, duplicates, out_of_order, first_seq, high."""
    seen = _high_before(events)
    return seen.groupBy("partition").agg(
        F.count("*").alias("events"),
        (F.sum("copies") - F.count("*")).alias("duplicates"),
        F.count_if(F.col("seq") < F.col("high_before")).alias("out_of_order"),
        F.min_by("seq", "arrival").alias("first_seq"),
        F.max("seq").alias("high"),
    )


def gaps(events: DataFrame, policy: Policy = DEFAULT, expected_first_seq: int | None = None) -> DataFrame:
    """Holes above the first number seen: missing once the grace has passed them, else open.

    With ``expected_first_seq`` a loss before the first arrival is a hole too.
    """
    first = first_arrivals(events)
    stats = first.groupBy("partition").agg(F.min_by("seq", "arrival").alias("first_seq"), F.max("seq").alias("high"))
    holes = scan.next_value(first, "partition", "seq", "next", over=events).where("next - seq > 1")
    out = holes.join(stats, "partition").where("seq >= first_seq").select("partition", (F.col("seq") + 1).alias("missing_from"), (F.col("next") - 1).alias("missing_to"), "high")
    if expected_first_seq is not None:
        least = first.groupBy("partition").agg(F.min("seq").alias("least"), F.max("seq").alias("high")).where(F.col("least") > expected_first_seq)
        out = out.unionByName(least.select("partition", F.lit(expected_first_seq).cast("bigint").alias("missing_from"), (F.col("least") - 1).alias("missing_to"), "high"))
    status = F.when(F.col("high") - F.col("missing_to") >= policy.reorder_grace, "missing").otherwise("open")
    return out.select("partition", "missing_from", "missing_to", (F.col("missing_to") - F.col("missing_from") + 1).alias("n"), status.alias("status"))


def closed_late(events: DataFrame) -> DataFrame:
    """Numbers that filled a hole after higher ones had arrived, as intervals of consecutive numbers."""
    late = _high_before(events).where("seq < high_before")
    placed = scan.numbered(late, "partition", "seq", "n").withColumn("island", F.col("seq") - F.col("n"))
    return placed.groupBy("partition", "island").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("n")).drop("island")


def heartbeat_state(events: DataFrame, beats: DataFrame, now: str, expected: list[str] | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Per partition: last beat in arrival order, high waters, lag, stale."""
    last = beats.groupBy("partition").agg(F.max_by(F.struct("at", "producer_high_water"), "arrival").alias("b")).select("partition", "b.*")
    if expected:
        names = beats.sparkSession.createDataFrame([(p,) for p in sorted(set(expected))], "partition string")
        last = names.join(last, "partition", "full_outer")
    high = events.groupBy("partition").agg(F.max("seq").alias("high"))
    silent = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))
    joined = last.join(high, "partition", "left").withColumn("received_high_water", F.coalesce("high", F.lit(0)))
    return joined.select(
        "partition",
        F.col("at").alias("last_seen"),
        "producer_high_water",
        "received_high_water",
        (F.col("producer_high_water") - F.col("received_high_water")).alias("lag"),
        F.coalesce(silent > policy.max_silence_seconds, F.lit(True)).alias("stale"),
    )


def report(events: DataFrame, beats: DataFrame, now: str, expected: list[str] | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """One row: totals, and complete if nothing is stale or missing and every lag is 0."""
    totals = partition_stats(events).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "duplicates", "out_of_order")))
    holes = gaps(events, policy).agg(F.coalesce(F.sum(F.when(F.col("status") == "missing", F.col("n"))), F.lit(0)).alias("missing_events"), F.count_if(F.col("status") == "open").alias("open_gaps"))
    state = heartbeat_state(events, beats, now, expected, policy).agg(F.count_if("stale").alias("stale_partitions"), F.count_if(F.col("lag") != 0).alias("lagging_partitions"))
    # Three one-row frames.
    joined = totals.join(holes, F.lit(True)).join(state, F.lit(True))
    return joined.withColumn("complete", (F.col("stale_partitions") == 0) & (F.col("missing_events") == 0) & (F.col("lagging_partitions") == 0))


def lag_or_hole(events: DataFrame, beats: DataFrame, now: str, policy: Policy = DEFAULT) -> DataFrame:
    """Whether a partition is behind, has lost events, both or neither: a zero lag does not mean nothing is lost."""
    lost = gaps(events, policy).groupBy("partition").agg(F.sum(F.when(F.col("status") == "missing", F.col("n")).otherwise(0)).alias("missing"))
    joined = heartbeat_state(events, beats, now, policy=policy).join(lost, "partition", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    note = F.when((F.col("lag") == 0) & (F.col("missing") > 0), "caught up with holes").when((F.col("lag") > 0) & (F.col("missing") == 0), "behind without holes").when((F.col("lag") != 0) & (F.col("missing") > 0), "behind with holes").otherwise("complete")
    return joined.select("partition", "lag", "missing", note.alias("note"))


def score(events: DataFrame, beats: DataFrame, now: str, dropped: int, delayed: int, silent: str, policy: Policy = DEFAULT) -> DataFrame:
    """Detector against truth: drops exactly, delays at least, the silent partition among the stale ones."""
    row = report(events, beats, now, policy=policy)
    stale = heartbeat_state(events, beats, now, policy=policy).where(F.col("stale") & (F.col("partition") == silent)).agg((F.count("*") > 0).alias("silent_found"))
    return row.join(stale, F.lit(True)).select(
        F.col("missing_events").alias("dropped_found"), (F.col("missing_events") == dropped).alias("dropped_ok"), F.col("out_of_order").alias("delayed_found"), (F.col("out_of_order") >= delayed).alias("delayed_ok"), "silent_found"
    )


def render(row, holes: list) -> str:
    """The report as text."""
    lines = [f"{'COMPLETE' if row['complete'] else 'INCOMPLETE'}: {row['events']} events, {row['duplicates']} repeats, {row['out_of_order']} out of order"]
    lines += [f"  {g['partition']} {g['status']}: {g['missing_from']}..{g['missing_to']} ({g['n']})" for g in holes]
    return "\n".join([*lines, f"  stale partitions: {row['stale_partitions']}, lagging: {row['lagging_partitions']}"])
