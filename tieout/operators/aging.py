"""Age of open breaks by bucket and by escalation tier, zero-filled from a small fixed dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.calendar import age_bucket, business_days, tier
from tieout.policy import BUCKETS, TIERS


def _filled(df: DataFrame, names, key: str, counted: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    out = rows.join(counted, key, "left")
    return out.na.fill(0, [c for c in counted.columns if c != key])


def buckets(breaks: DataFrame) -> DataFrame:
    """Open breaks by age bucket, all four buckets."""
    counted = breaks.where("status = 'open'").groupBy(age_bucket(F.col("age_days")).alias("bucket")).agg(F.count("*").alias("n"))
    return _filled(breaks, BUCKETS, "bucket", counted)


def tiers(items: DataFrame, as_of: str) -> DataFrame:
    """Open items by tier at ``as_of``, from their first_seen: count, absolute variance, oldest age; all four tiers."""
    age = business_days(F.col("first_seen"), F.lit(as_of).cast("date")).cast("bigint")
    aged = items.where("status = 'open'").withColumn("age", age)
    counted = aged.groupBy(tier(F.col("age")).alias("tier")).agg(
        F.count("*").alias("n"), F.sum(F.abs(F.coalesce("variance_minor", F.lit(0)))).cast("bigint").alias("variance_minor"), F.max("age").alias("oldest_days")
    )
    return _filled(items, [t[1] for t in TIERS], "tier", counted)
