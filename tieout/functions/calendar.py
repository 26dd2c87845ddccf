"""Business-day arithmetic and age bands as column expressions (no UDF, O(1) per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.policy import BUCKETS, TIERS

_MONDAY = "1970-01-05"


def _weekdays_since_monday(day: Column) -> Column:
    n = F.datediff(day, F.lit(_MONDAY).cast("date"))
    return 5 * F.floor(n / 7).cast("int") + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days(a: Column, b: Column, holidays: list[str] | None = None) -> Column:
    """Weekdays in the half-open range after the earlier date; symmetric.

    ``holidays`` (ISO dates, default none) that fall on weekdays in the range are taken off.
    """
    apart = F.abs(_weekdays_since_monday(a) - _weekdays_since_monday(b))
    for day in sorted(set(holidays or [])):
        d = F.lit(day).cast("date")
        inside = (d > F.least(a, b)) & (d <= F.greatest(a, b)) & (F.dayofweek(d).between(2, 6))
        apart = apart - inside.cast("int")
    return apart


def tier(age: Column) -> Column:
    """The band of the greatest threshold at or below the age (a CASE, not a range join)."""
    out = F
    for least, name, _ in reversed(TIERS[1:]):
        out = out.when(age >= least, name)
    return out.otherwise(TIERS[0][1])


def tier_action(age: Column) -> Column:
    out = F
    for least, _, action in reversed(TIERS[1:]):
        out = out.when(age >= least, action)
    return out.otherwise(TIERS[0][2])


def age_bucket(age: Column) -> Column:
    return F.when(age <= 1, BUCKETS[0]).when(age <= 3, BUCKETS[1]).when(age <= 5, BUCKETS[2]).otherwise(BUCKETS[3])
