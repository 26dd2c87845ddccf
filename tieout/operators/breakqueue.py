"""The break queue: intake, resolution under authority and materiality, escalation and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import WorkflowError
from tieout.functions.calendar import business_days, tier, tier_action
from tieout.functions.names import role_covers
from tieout.operators import aging
from tieout.operators.ledger import Ledger
from tieout.policy import RESOLUTION_CODES

SCHEMA = (
    "at timestamp, actor string, action string, ref string, break_type string, from_status string, to_status string, code string, "
    "core_amount bigint, proc_amount bigint, variance_minor bigint, business_date date, note string"
)
KEY = ["ref", "break_type"]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESOLUTION_CODES, "code string, limit_minor bigint, least_role string")


def state(events: DataFrame) -> DataFrame:
    """One row per item; first_seen and the amounts are those of its first event."""
    first = [F.min_by(c, "event_id").alias(n) for c, n in (("business_date", "first_seen"), ("core_amount", "core_amount"), ("proc_amount", "proc_amount"), ("variance_minor", "variance_minor"))]
    last = [F.max_by("to_status", "event_id").alias("status"), F.max_by("code", "event_id").alias("code"), F.max("business_date").alias("last_seen")]
    folded = events.groupBy(*KEY).agg(*first, *last)
    return folded.withColumn("break_id", F.sha2(F.concat_ws("|", *KEY), 256).substr(1, 16))


def intake_events(items: DataFrame, candidates: DataFrame, at: str, actor: str = "engine") -> DataFrame:
    """What a run's open breaks add: ``opened`` for new items, ``reopened`` for resolved ones, nothing for open ones.

    Several candidates of a key collapse to the one of the least line.
    """
    fields = ["core_amount", "proc_amount", "variance_minor", "business_date"]
    detail = F.col("detail") if "detail" in candidates.columns else F.lit(None).cast("string")
    firsts = candidates.groupBy(*KEY).agg(F.min_by(F.struct(*fields, detail.alias("detail")), F.coalesce("line_no", F.lit(0))).alias("c")).select(*KEY, "c.*")
    known = items.select(*KEY, F.col("status").alias("old"))
    joined = firsts.join(known, KEY, "left").where("old is null or old = 'resolved'")
    return joined.select(
        F.lit(at).cast("timestamp").alias("at"),
        F.lit(actor).alias("actor"),
        F.when(F.col("old").isNull(), "opened").otherwise("reopened").alias("action"),
        *KEY,
        F.col("old").alias("from_status"),
        F.lit("open").alias("to_status"),
        F.lit(None).cast("string").alias("code"),
        *fields,
        F.col("detail").alias("note"),
    )


def validate(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each attempt (ref, break_type, code, actor, role) with its first reason to refuse, or null.

    The rules are seven rows and are broadcast.
    """
    r = F.broadcast(rules(attempts.sparkSession))
    joined = attempts.join(r, "code", "left").join(items.select(*KEY, "status", "variance_minor"), KEY, "left")
    reason = (
        F.when(F.col("least_role").isNull(), "unknown code")
        .when(F.col("status").isNull(), "unknown break")
        .when(F.col("status") == "resolved", "already resolved")
        .when(~role_covers(F.col("role"), F.col("least_role")), "role too low")
        .when(F.abs(F.coalesce("variance_minor", F.lit(0))) > F.col("limit_minor"), "over the limit")
    )
    return joined.select(*KEY, "code", "actor", "role", reason.alias("reason"))


def open_items(items: DataFrame, as_of: str) -> DataFrame:
    age = business_days(F.col("first_seen"), F.lit(as_of).cast("date")).cast("bigint")
    aged = items.where("status = 'open'").withColumn("age_days", age)
    return aged.withColumn("tier", tier(F.col("age_days"))).withColumn("tier_action", tier_action(F.col("age_days"))).orderBy(F.desc("age_days"), "break_id")


def history(events: DataFrame, ref: str, break_type: str) -> DataFrame:
    return events.where((F.col("ref") == ref) & (F.col("break_type") == break_type)).orderBy("event_id")


class BreakQueue:
    """The queue over its ledger."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.ledger = Ledger(spark, root, SCHEMA)

    def items(self) -> DataFrame:
        return state(self.ledger.events())

    def intake(self, candidates: DataFrame, at: str, actor: str = "engine") -> int:
        return self.ledger.append(intake_events(self.items(), candidates.where("status = 'open'"), at, actor), KEY)

    def resolve(self, ref: str, break_type: str, code: str, actor: str, role: str, at: str, note: str = "") -> None:
        spark = self.ledger.spark
        attempt = spark.createDataFrame([(ref, break_type, code, actor, role)], "ref string, break_type string, code string, actor string, role string")
        reason = validate(self.items(), attempt).first()["reason"]
        if reason:
            raise WorkflowError(f"{code} on {ref}/{break_type} by {actor} ({role}): {reason}")
        self.resolve_all(attempt, at, note)

    def resolve_all(self, attempts: DataFrame, at: str, note: str = "") -> int:
        """Applies every attempt that validates (one per item); gives the number of resolved items."""
        good = validate(self.items(), attempts).where("reason is null").groupBy(*KEY).agg(F.min(F.struct("code", "actor")).alias("a")).select(*KEY, "a.*")
        items = self.items().select(*KEY, "core_amount", "proc_amount", "variance_minor", F.col("last_seen").alias("business_date"))
        rows = good.join(items, KEY).select(
            F.lit(at).cast("timestamp").alias("at"), "actor", F.lit("resolved").alias("action"), *KEY, F.lit("open").alias("from_status"), F.lit("resolved").alias("to_status"), "code",
            "core_amount", "proc_amount", "variance_minor", "business_date", F.lit(note).alias("note"),
        )
        return self.ledger.append(rows, KEY)

    def open_items(self, as_of: str) -> DataFrame:
        return open_items(self.items(), as_of)

    def aging_report(self, as_of: str) -> DataFrame:
        return aging.tiers(self.items(), as_of)

    def history(self, ref: str, break_type: str) -> DataFrame:
        return history(self.ledger.events(), ref, break_type)
