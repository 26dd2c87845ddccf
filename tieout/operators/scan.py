"""Scans over ordered rows of a key that any number of tasks share.

A window over a whole key sorts the key in one task.  Here order numbers are cut into
spans of ``SPAN``; a window runs inside (key, span) only, and a second one over one row
per span carries what the spans before (or after) add.  Numbers that are unique within
a key, such as sequence or line numbers, bound a span's rows by ``SPAN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 1 << 20


def _spanned(df: DataFrame, order: str, span: int) -> DataFrame:
    """Rows without an order number come first, as windows have them."""
    return df.withColumn("_span", F.coalesce(F.floor(F.col(order) / span), F.lit(-(1 << 62))))


def _carried(df: DataFrame, key: str, per_span: Column, over: Column) -> DataFrame:
    """(key, _span, _carry): one row a span, then a scan over these."""
    return df.groupBy(key, "_span").agg(per_span.alias("_own")).withColumn("_carry", over).select(key, "_span", "_carry")


def max_before(df: DataFrame, key: str, order: str, value: str, name: str, span: int = SPAN, over: DataFrame | None = None) -> DataFrame:
    """Adds the largest value of the rows before in order (null for the first).

    ``over`` may hold more rows than ``df``, as long as these change no maximum; the rows
    per span are then counted from there, and ``df`` is needed once.
    """
    cut = _spanned(df, order, span)
    spans = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    heads = _carried(cut if over is None else _spanned(over, order, span), key, F.max(value), F.max("_own").over(spans))
    inside = W.partitionBy(key, "_span").orderBy(order, value).rowsBetween(W.unboundedPreceding, -1)
    return cut.join(heads, [key, "_span"]).withColumn(name, F.greatest("_carry", F.max(value).over(inside))).drop("_span", "_carry")


def next_value(df: DataFrame, key: str, order: str, name: str, span: int = SPAN, over: DataFrame | None = None) -> DataFrame:
    """Adds the order number of the following row (null for the last): a carry from the other side.

    ``over`` may repeat the numbers of ``df``.
    """
    cut = _spanned(df, order, span)
    heads = _carried(cut if over is None else _spanned(over, order, span), key, F.min(order), F.lead("_own").over(W.partitionBy(key).orderBy("_span")))
    inside = W.partitionBy(key, "_span").orderBy(order)
    return cut.join(heads, [key, "_span"]).withColumn(name, F.coalesce(F.lead(order).over(inside), "_carry")).drop("_span", "_carry")


def numbered(df: DataFrame, key: str, order: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds the row's number within its key, from 1."""
    cut = _spanned(df, order, span)
    spans = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    heads = _carried(cut, key, F.count("*"), F.coalesce(F.sum("_own").over(spans), F.lit(0)))
    inside = W.partitionBy(key, "_span").orderBy(order)
    return cut.join(heads, [key, "_span"]).withColumn(name, F.row_number().over(inside) + F.col("_carry")).drop("_span", "_carry")
