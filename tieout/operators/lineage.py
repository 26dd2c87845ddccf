"""Reported figures with the records behind them, which re-add to the figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _figure(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.sum("amount_minor").alias("value_minor"), F.count("*").alias("record_count"))


def by_currency_and_date(records: DataFrame) -> DataFrame:
    return _figure(records, ["currency", "business_date"]).orderBy("currency", "business_date")


def by_account(records: DataFrame, top_n: int = 5) -> DataFrame:
    """The accounts with the largest absolute figures; ties by account."""
    return _figure(records, ["account"]).orderBy(F.abs("value_minor").desc(), "account").limit(top_n)


def control_total(records: DataFrame) -> DataFrame:
    return _figure(records, [])


def contributors(records: DataFrame, cell: dict) -> DataFrame:
    """The records of one cell, by source file and line (the filter reaches the scan)."""
    for key, value in cell.items():
        records = records.where(F.col(key) == F.lit(value))
    return records.orderBy("source", "source_file", "line_no")


def verify(figures: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Each figure beside the sum of its contributors: ties where both value and count agree."""
    again = _figure(records, keys).withColumnsRenamed({"value_minor": "recomputed_minor", "record_count": "recomputed_count"})
    ties = F.coalesce((F.col("value_minor") == F.col("recomputed_minor")) & (F.col("record_count") == F.col("recomputed_count")), F.lit(False))
    return figures.join(again, keys, "left").withColumn("ties", ties)


def trace(line: DataFrame, records: DataFrame, cell: dict, limit: int = 8) -> str:
    """A figure and its first contributors as text."""
    figure = line.first()
    rows = contributors(records, cell).limit(limit).collect()
    head = f"{cell}: {figure['value_minor'] / 100:,.2f} from {figure['record_count']} records"
    return "\n".join([head, *(f"  {r['source_file']}:{r['line_no']} {r['ref']} {r['amount_minor'] / 100:,.2f}" for r in rows)])
