"""Silent partitions of a live stream of beats, told by event-time timers.

A beat arms a timer that goes off ``max_silence_seconds`` after it; the next beat moves
it.  Rows of kind ``expected`` name partitions that are to beat: until their first beat
they are silent.  Rows of kind ``clock`` move the time on without a beat.  What comes
out is one row per change: a beat, or a timer that went off.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tieout.policy import DEFAULT, Policy
from tieout.streaming.completeness import ROCKS

# The processor goes to the workers whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INPUT = "kind string, partition string, at timestamp, producer_high_water bigint, arrival bigint"
#: ``since`` is when the row began to hold: the beat, or the moment the silence was too long (null: it was never heard).
OUTPUT = "partition string, last_seen timestamp, producer_high_water bigint, stale boolean, since timestamp"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
CLOCK = ""


def _rows(partition: str, changes: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(partition, *c) for c in changes], columns=_COLUMNS)
    return out.astype({"producer_high_water": "Int64", "stale": bool}).assign(last_seen=pd.to_datetime(out["last_seen"]), since=pd.to_datetime(out["since"]))


class Silence(StatefulProcessor):
    """The last beat of a partition in arrival order, and its timer."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, producer_high_water bigint, due bigint")  # due: 0 once the timer has gone off

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        beats = batch[batch["kind"] == "beat"]
        if key[0] == CLOCK:
            return
        if beats.empty:
            if not self.last.exists():
                yield _rows(key[0], [(None, None, True, None)])
            return
        seen, water, due = self.last.get() if self.last.exists() else (None, None, 0)
        if due:
            self.handle.deleteTimer(due)
        changes = []
        for at, level in zip(beats["at"], beats["producer_high_water"]):
            if due and due <= at.timestamp() * 1000:  # this beat has ended a silence whose timer it has overtaken
                changes.append((seen, water, True, pd.to_datetime(due, unit="ms")))
            seen, water, due = at, int(level), int(at.timestamp() * 1000) + self.limit_ms + 1
            changes.append((seen, water, False, at))
        self.last.update((seen.to_pydatetime(), water, due))
        self.handle.registerTimer(due)
        yield _rows(key[0], changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, water, due = self.last.get()
        self.last.update((at, water, 0))
        yield _rows(key[0], [(at, water, True, pd.to_datetime(due, unit="ms"))])

    def close(self) -> None:
        pass


def watch(beats: DataFrame, policy: Policy = DEFAULT, lateness: str = "0 seconds") -> DataFrame:
    """Changes of each partition of a stream of ``INPUT`` rows, in update mode.

    The time is the latest of an earlier micro-batch, less the lateness that is granted;
    beats of before are dropped.
    """
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = beats.withColumn("at", F.coalesce("at", F.timestamp_seconds(F.lit(1)))).withWatermark("at", lateness)
    return timed.groupBy("partition").transformWithStateInPandas(Silence(policy.max_silence_seconds * 1000), OUTPUT, "Update", "EventTime")


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, files_a_batch: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Consumes the JSON files that a folder has got since the last call, at once or a few per micro-batch; all changes so far."""
    reader = spark.readStream.schema(INPUT)
    beats = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(source)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = watch(beats, policy).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{OUTPUT}, batch int").parquet(sink)


def state_of(changes: DataFrame, now: str) -> DataFrame:
    """(partition, last_seen, producer_high_water, stale) at a moment, of the changes until then.

    A beat and its own timer never share a moment, so the latest change holds.
    """
    then = F.lit(now).cast("timestamp")
    held = changes.where(F.col("since").isNull() | (F.col("since") <= then))
    last = held.groupBy("partition").agg(F.max_by(F.struct("last_seen", "producer_high_water", "stale"), F.coalesce("since", F.timestamp_seconds(F.lit(0)))).alias("s"))
    return last.select("partition", "s.*")
