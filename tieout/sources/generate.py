"""Writes a complete set of feed, heartbeat and truth files for a run from the derived feeds."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tieout.sources import feeds, writers


def generate(spark: SparkSession, sf_dir: str, out: str) -> dict[str, str]:
    """Core batch, processor events, transport events, heartbeats and truth; their paths.

    Only the beats (one a stream partition) pass the driver.
    """
    paths = {n: f"{out}/{n}" for n in ("core", "events", "transport", "heartbeats.json", "stream_truth.json", "break_truth.json")}
    writers.write_batch(feeds.core(spark, sf_dir), paths["core"])
    writers.write_events(feeds.processor(spark, sf_dir), paths["events"])
    writers.write_events(feeds.stream_events(spark, sf_dir), paths["transport"], order="arrival")
    beats = feeds.heartbeats(spark, sf_dir).orderBy("arrival").collect()
    writers.write_json(spark, [{"partition": b["partition"], "at": b["at"].isoformat(), "producer_high_water": b["producer_high_water"]} for b in beats], paths["heartbeats.json"])
    writers.write_json(spark, {"dropped_events": feeds.DROPPED, "delayed_events": feeds.DELAYED, "silent_partition": feeds.SILENT, "producer_high_water": {b["partition"]: b["producer_high_water"] for b in beats}}, paths["stream_truth.json"])
    feeds.planted(spark, sf_dir).write.mode("overwrite").json(paths["break_truth.json"])
    return paths
