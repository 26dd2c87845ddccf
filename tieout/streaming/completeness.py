"""Sequence tracking over a live stream, with state that grows with the holes and not with the events.

Keyed by partition.  The numbers seen are disjoint intervals in ascending order, so
holes lie between them, numbers below the first arrival need no list of their own, and
a micro-batch is merged by binary search and one sort, however many holes there are.
Intervals are a map state, of which a batch writes only what it has changed; so does
the output: a row of figures, and a row for each hole that has opened, shrunk or gone.
Rows of a micro-batch are put in arrival order inside the handler, since shuffles keep
none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The processor goes to the workers whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIGURES = ("first_seq", "high", "events", "duplicates", "out_of_order")
#: A row of figures (missing_from null), or a hole: missing_to null once it is gone.
OUTPUT = "partition string, first_seq bigint, high bigint, events bigint, duplicates bigint, out_of_order bigint, missing_from bigint, missing_to bigint"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_STATE = "first_seq bigint, high bigint, events bigint, duplicates bigint, out_of_order bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sequence:
    """What is known of one partition: figures, and the intervals of numbers seen."""

    def __init__(self, first=None, high=None, events=0, duplicates=0, out_of_order=0, low=(), top=()) -> None:
        self.first, self.high = first, high
        self.events, self.duplicates, self.out_of_order = events, duplicates, out_of_order
        self.low, self.top = np.array(low, np.int64), np.array(top, np.int64)

    @property
    def figures(self) -> tuple:
        return self.first, self.high, self.events, self.duplicates, self.out_of_order

    @property
    def intervals(self) -> dict[int, int]:
        return dict(zip(self.low.tolist(), self.top.tolist()))

    @property
    def holes(self) -> dict[int, int]:
        """Holes above the first number: first and last missing number."""
        if self.first is None:
            return {}
        above = self.top[:-1] >= self.first
        return dict(zip((self.top[:-1] + 1)[above].tolist(), (self.low[1:] - 1)[above].tolist()))

    def seen(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.low, numbers, "right") - 1
        return (at >= 0) & (numbers <= self.top[at]) if len(self.low) else np.zeros(len(numbers), bool)

    def observe(self, arrivals) -> None:
        """Takes numbers in arrival order."""
        numbers = np.asarray(arrivals, np.int64)
        if not len(numbers):
            return
        if self.first is None:
            self.first = self.high = int(numbers[0])
        once = np.zeros(len(numbers), bool)
        once[np.unique(numbers, return_index=True)[1]] = True
        new = once & ~self.seen(numbers)
        high_before = np.maximum.accumulate(np.concatenate([[self.high], numbers[:-1]]))
        self.out_of_order += int((new & (numbers < high_before)).sum())
        self.events += int(new.sum())
        self.duplicates += int((~new).sum())
        self.high = max(self.high, int(numbers.max()))
        low, top = np.concatenate([self.low, numbers[new]]), np.concatenate([self.top, numbers[new]])
        order = np.argsort(low)
        low, top = low[order], top[order]
        starts = np.concatenate([[True], low[1:] > top[:-1] + 1])
        self.low, self.top = low[starts], top[np.concatenate([starts[1:], [True]])]


def _changed(before: dict[int, int], after: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    """Keys that have gone, and entries that are new or different."""
    return [k for k in before if k not in after], {k: v for k, v in after.items() if before.get(k) != v}


class Tracker(StatefulProcessor):
    """Folds the arrivals of a partition into its state and gives what has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", _STATE)
        self.intervals = handle.getMapState("intervals", "low bigint", "top bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = sorted((k[0], v[0]) for k, v in self.intervals.iterator()) if self.figures.exists() else []
        held = Sequence(*(self.figures.get() if self.figures.exists() else ()), low=[k for k, _ in kept], top=[v for _, v in kept])
        intervals, holes = held.intervals, held.holes
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        held.observe(batch["seq"].to_numpy())
        gone, new = _changed(intervals, held.intervals)
        for low in gone:
            self.intervals.removeKey((low,))
        for low, top in new.items():
            self.intervals.updateValue((low,), (top,))
        self.figures.update(held.figures)
        closed, opened = _changed(holes, held.holes)
        out = [(key[0], *held.figures, None, None), *((key[0], *held.figures, k, None) for k in closed), *((key[0], *held.figures, k, v) for k, v in opened.items())]
        yield pd.DataFrame(out, columns=_COLUMNS).astype({c: "Int64" for c in _COLUMNS[1:]})

    def close(self) -> None:
        pass


def track(events: DataFrame) -> DataFrame:
    """What changes for each partition of a stream (partition, seq, arrival), in update mode."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("partition").transformWithStateInPandas(Tracker(), OUTPUT, "Update", "none")


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, files_a_batch: int | None = None) -> DataFrame:
    """Consumes the JSON files that a folder has got since the last call, at once or a few per micro-batch; all changes so far, with their batch.

    Arrival order holds within a micro-batch whatever its files; earlier batches must hold earlier arrivals.
    """
    reader = spark.readStream.schema("partition string, seq bigint, arrival bigint")
    events = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(source)

    def keep(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = track(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{OUTPUT}, batch int").parquet(sink)


def figures_of(changes: DataFrame) -> DataFrame:
    """The last figures of each partition."""
    return changes.where("missing_from is null").groupBy("partition").agg(F.max_by(F.struct(*FIGURES), "batch").alias("s")).select("partition", "s.*")


def gaps_of(changes: DataFrame, reorder_grace: int) -> DataFrame:
    """The holes of tracked partitions: missing once the grace has passed them, else open."""
    last = changes.where("missing_from is not null").groupBy("partition", "missing_from").agg(F.max_by(F.struct("missing_to"), "batch").alias("s")).select("partition", "missing_from", "s.missing_to")
    rows = last.where("missing_to is not null").join(figures_of(changes).select("partition", "high"), "partition")
    status = F.when(F.col("high") - F.col("missing_to") >= reorder_grace, "missing").otherwise("open")
    return rows.select("partition", "missing_from", "missing_to", (F.col("missing_to") - F.col("missing_from") + 1).alias("n"), status.alias("status"))
