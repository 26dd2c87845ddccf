"""Fixture and feed writers: fixed-width batch with trailer, JSON event lines, JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.sources.files import Files
from tieout.sources.ingest import control_totals


def batch_lines(records: DataFrame) -> DataFrame:
    """(part, ordinal, value): header, details by line number, trailer."""
    spark = records.sparkSession
    detail = F.concat(
        F.lit("16"), F.rpad("ref", 16, " "), F.date_format("business_date", "yyyyMMdd"), F.rpad("account", 6, " "), F.rpad("currency", 3, " "),
        F.lpad(F.col("amount_minor").cast("string"), 15, " "), F.rpad("kind", 8, " "),
    )
    totals = control_totals(records).select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("ordinal"), F.concat(F.lit("99"), F.lpad(F.col("n").cast("string"), 10, "0"), F.lpad(F.col("total").cast("string"), 20, "0")).alias("value"))
    head = spark.createDataFrame([(0, 0, "01SETTLEMENT BATCH")], "part int, ordinal bigint, value string")
    return head.unionByName(records.select(F.lit(1).alias("part"), F.col("line_no").alias("ordinal"), detail.alias("value"))).unionByName(totals)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Parts in a folder, one a range of the order; their names are in that order too, as readers take them."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def write_batch(records: DataFrame, path: str) -> None:
    """A batch in parts: the header leads the first, the trailer ends the last."""
    write_lines(batch_lines(records), path, "part", "ordinal")


def write_events(records: DataFrame, path: str, order: str = "line_no") -> None:
    """Event lines in arrival order, in parts."""
    names = [c for c in records.columns if c not in ("source", "source_file", "line_no", "arrival")]
    lines = records.withColumn("business_date", F.date_format("business_date", "yyyy-MM-dd")) if "business_date" in records.columns else records
    write_lines(lines.select(order, F.to_json(F.struct(*names)).alias("value")), path, order)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small control or truth file in any store, replaced in one step."""
    Files(spark).replace(path, json.dumps(value, indent=1, default=str))
