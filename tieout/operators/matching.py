"""Two-sided reconciliation: one shuffle on the reference, then a first-match-wins cascade.

Both sides are tagged, stacked and grouped once, so no join is planned; the
representative of a side is its first record in file order, taken whole.  (Without
a line number a record comes before those that have one.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions.calendar import business_days
from tieout.policy import DEFAULT, Policy

_FIELDS = ("amount_minor", "business_date", "currency")
#: Records that one task is to sort, at some 250 bytes each, and the most tasks that are made for it.  (Beyond
#: 200 tasks Spark's shuffle buffers what a reading task writes, so many small ones take more memory, not less.)
TASK_RECORDS, MOST_TASKS = 1_000_000, 20_000


def _stacked(core: DataFrame, proc: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Records of both sides with ``is_core``."""

    def side(df: DataFrame, is_core: bool) -> DataFrame:
        file = F.col("source_file") if "source_file" in df.columns else F.lit("")
        return df.select(*keys, *_FIELDS, file.alias("source_file"), "line_no", F.lit(is_core).alias("is_core"))

    return side(core, True).unionByName(side(proc, False))


def _dealt(df: DataFrame, records: int, *keys: str) -> DataFrame:
    """Dealt to all shuffle partitions of the session, and to more if a task would get over ``TASK_RECORDS``.

    A shuffle that Spark plans itself is packed into about one task a core, and whatever
    works on the same keys after it runs in that task too, each step with its own sort.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(session, min(-(-records // TASK_RECORDS), MOST_TASKS)), *keys)


def _first(side: Column) -> Column:
    """The first record of a side; the order key of the other side's rows is null, so they never win."""
    return F.min_by(F.struct(*_FIELDS), F.when(side, F.struct("source_file", "line_no")))


def _sides(grouped: DataFrame, *keys: str) -> DataFrame:
    return grouped.select(
        *keys, "n_core", "n_proc", F.col("c.amount_minor").alias("core_amount"), F.col("c.business_date").alias("core_business_date"), F.col("c.currency").alias("core_currency"),
        F.col("p.amount_minor").alias("proc_amount"), F.col("p.business_date").alias("proc_business_date"), F.col("p.currency").alias("proc_currency"),
    )


def pair(core: DataFrame, proc: DataFrame, keys: tuple[str, ...] = ("ref",)) -> DataFrame:
    """One row per reference: copies on each side and the fields of each side's first record."""
    c, p = F.col("is_core"), ~F.col("is_core")
    return _sides(_stacked(core, proc, keys).groupBy(*keys).agg(F.count_if(c).alias("n_core"), F.count_if(p).alias("n_proc"), _first(c).alias("c"), _first(p).alias("p")), *keys)


def fee_fits(core: Column, proc: Column, policy: Policy = DEFAULT) -> Column:
    """The processor took a fee that the schedule allows."""
    taken = F.abs(core) - F.abs(proc)
    most = F.greatest(F.lit(policy.fee_min_minor).cast("bigint"), F.call_function("div", F.abs(core) * policy.fee_max_bps, F.lit(10000)))
    return (core != 0) & ((core > 0) == (proc > 0)) & (taken > 0) & taken.between(policy.fee_min_minor, most)


def verdicts(core: DataFrame, proc: DataFrame, as_of: str, policy: Policy = DEFAULT, keys: tuple[str, ...] = ("ref",)) -> DataFrame:
    """One row per reference with its verdict, status, amounts, dates, age, and copies that were not looked at."""
    return _judged(pair(core, proc, keys), as_of, policy, keys)


def _judged(paired: DataFrame, as_of: str, policy: Policy, keys: tuple[str, ...]) -> DataFrame:
    c, p = F.col("core_amount"), F.col("proc_amount")
    gap = business_days(F.col("core_business_date"), F.col("proc_business_date"))
    same_currency = F.col("core_currency") == F.col("proc_currency")
    verdict = F.when((F.col("n_proc") == 0) | (F.col("n_core") == 0), "missing").when(F.col("n_core") != F.col("n_proc"), "duplicate")
    if policy.strict_currency:
        verdict = verdict.when(~same_currency, "currency")
    verdict = (
        verdict.when((c == p) & (F.col("core_business_date") == F.col("proc_business_date")) & same_currency, "exact")
        .when((c == p) & (gap <= policy.date_tolerance_days), "timing")
        .when((c == -p) & (c != 0), "sign")
        .when((F.col("core_currency") != "USD") & (F.abs(c - p) <= policy.fx_rounding_minor), "amount_fx")
        .when(fee_fits(c, p, policy), "amount_fee")
        .otherwise("amount_unknown")
    )
    status = F.when(F.col("verdict") == "exact", "matched").when(F.col("verdict").isin("timing", "amount_fx", "amount_fee"), "matched_flagged").otherwise("open")
    out = paired.withColumn("verdict", verdict).withColumn("status", status)
    out = out.withColumn("business_date", F.coalesce("core_business_date", "proc_business_date"))
    return out.select(
        *keys,
        "verdict",
        "status",
        "n_core",
        "n_proc",
        "core_amount",
        "proc_amount",
        (c - p).alias("variance_minor"),
        "core_currency",
        "proc_currency",
        "business_date",
        "proc_business_date",
        business_days(F.col("business_date"), F.lit(as_of).cast("date")).cast("bigint").alias("age_days"),
        F.when((F.col("n_core") == F.col("n_proc")), F.col("n_core") - 1).otherwise(0).cast("bigint").alias("ignored_copies"),
    )


def breaks(core: DataFrame, proc: DataFrame, as_of: str, policy: Policy = DEFAULT, records: int | None = None) -> DataFrame:
    """One row per break; a one-sided reference gives one per record.

    The stacked sides are dealt by reference and sorted in file order once: one window sets
    the pair beside each of its records, and of a pair with both sides one record goes on.
    ``records``: how many both sides hold, counted here if it is not known.
    """
    order = W.partitionBy("ref").orderBy("source_file", "line_no")
    of = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c, p = F.col("is_core"), ~F.col("is_core")
    beside = {"n_core": F.count_if(c).over(of), "n_proc": F.count_if(p).over(of), "c": _first(c).over(of), "p": _first(p).over(of), "place": F.row_number().over(order)}
    stacked = _stacked(core, proc, ("ref",))
    rows = _dealt(stacked, stacked.count() if records is None else records, "ref").withColumns(beside).where("place = 1 or n_core = 0 or n_proc = 0")
    own = {"amount_minor": "own_amount", "business_date": "own_date", "line_no": "own_line"}
    judged = _judged(_sides(rows.withColumnsRenamed(own), "ref", "is_core", *own.values()), as_of, policy, ("ref", "is_core", *own.values())).where("verdict <> 'exact'")
    alone = F.col("verdict") == "missing"
    day = F.when(alone, F.col("own_date")).otherwise(F.col("business_date"))
    detail = (
        F.when(alone & F.col("is_core"), "no record on the processor side")
        .when(alone, "no record on the core side")
        .when(F.col("verdict") == "duplicate", F.format_string("%d core and %d processor copies", "n_core", "n_proc"))
        .when(F.col("verdict") == "timing", F.format_string("booked %s and %s", F.col("business_date").cast("string"), F.col("proc_business_date").cast("string")))
        .when(F.col("verdict") == "sign", F.lit("opposite signs"))
        .otherwise(F.format_string("difference of %d minor units", F.col("variance_minor")))
    )
    return judged.select(
        "ref", F.col("verdict").alias("break_type"), "status", F.when(alone, F.when(F.col("is_core"), F.col("own_amount"))).otherwise(F.col("core_amount")).alias("core_amount"),
        F.when(alone, F.when(~F.col("is_core"), F.col("own_amount"))).otherwise(F.col("proc_amount")).alias("proc_amount"), F.when(~alone, F.col("variance_minor")).alias("variance_minor"), day.alias("business_date"),
        business_days(day, F.lit(as_of).cast("date")).cast("bigint").alias("age_days"), F.when(alone, F.col("own_line")).alias("line_no"), detail.alias("detail"),
    )


def match_rate(verdict: DataFrame) -> DataFrame:
    """One row: matched exact and within tolerance, universe, and the automatic rate in parts per million."""
    exact = F.sum(F.when(F.col("verdict") == "exact", 1).when(F.col("verdict") == "duplicate", F.least("n_core", "n_proc")).otherwise(0))
    flagged = F.count_if(F.col("status") == "matched_flagged")
    totals = verdict.agg(exact.alias("matched_exact"), flagged.alias("matched_tolerance"), F.count("*").alias("universe"))
    total = F.col("matched_exact") + F.col("matched_tolerance")
    return totals.select("*", total.alias("total_matched"), F.when(F.col("universe") > 0, F.call_function("div", total * 1000000, F.col("universe"))).cast("bigint").alias("rate_ppm"))


def tolerance_notes(verdict: DataFrame) -> DataFrame:
    """How often each tolerance rule matched."""
    rule = F.when(F.col("verdict") == "timing", "date_within_tolerance").when(F.col("verdict") == "amount_fx", "fx_rounding").when(F.col("verdict") == "amount_fee", "fee_schedule")
    return verdict.select(rule.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


def summary(verdict: DataFrame) -> DataFrame:
    """Count, variance and oldest age by verdict and status."""
    return verdict.groupBy("verdict", "status").agg(F.count("*").alias("n"), F.sum(F.coalesce("variance_minor", F.lit(0))).alias("variance_minor"), F.max("age_days").alias("oldest_days"))


def sliced(core: DataFrame, proc: DataFrame, days: list[str], as_of: str, policy: Policy = DEFAULT, lookback: int = 0) -> DataFrame:
    """Verdicts per business date, each side cut by its own date (``lookback``: days the processor side may be off).

    The date is part of the grouping key, so all dates are one shuffle; a record of
    the processor side goes to each date it is near to.
    """
    listed = F.array(*(F.lit(day).cast("date") for day in days))
    near = F.filter(listed, lambda day: F.abs(F.datediff(F.col("business_date"), day)) <= lookback)
    own = core.where(F.col("business_date").isin(*days)).withColumn("run_date", F.col("business_date"))
    out = verdicts(own, proc.withColumn("run_date", F.explode(near)), as_of, policy, ("run_date", "ref"))
    return out.where("n_core > 0 or business_date = run_date") if lookback else out
