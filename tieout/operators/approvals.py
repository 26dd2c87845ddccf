"""Maker-checker reviews, period sign-off and approvals that are bound to one plan."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.errors import Conflict, NotAuthorised, ReviewError
from tieout.functions.names import person, person_of, seconds_between
from tieout.operators.ledger import Ledger, current
from tieout.policy import DEFAULT, Policy

# ---- maker and checker


def needs_second_pair(amount: Column, policy: Policy = DEFAULT) -> Column:
    return F.abs(amount) >= policy.review_threshold_minor


def route(requests: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds state: refused without a maker, pending at the threshold or above, else auto."""
    state = F.when(person(F.col("maker")) == "", "refused").when(needs_second_pair(F.col("amount_minor"), policy), "pending").otherwise("auto")
    return requests.withColumn("state", state)


def decide(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision (request_id, action, checker, note, checked_at) with its first reason to refuse, or null, and seconds."""
    joined = decisions.join(requests.select("request_id", "maker", "made_at", "state"), "request_id", "left")
    reason = (
        F.when(F.col("state").isNull(), "unknown request")
        .when(F.col("state") != "pending", "not pending")
        .when(person(F.col("checker")) == "", "no checker")
        .when(person(F.col("checker")) == person(F.col("maker")), "own request")
        .when(person(F.col("note")) == "", "no note")
    )
    return joined.select("request_id", "action", "checker", reason.alias("reason"), seconds_between(F.col("made_at"), F.col("checked_at")).alias("seconds"))


def review_speed(reviews: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row: decided reviews, and those that took less than is plausible."""
    took = seconds_between(F.col("made_at"), F.col("checked_at"))
    return reviews.where("state in ('approved', 'rejected')").agg(F.count("*").alias("reviewed"), F.count_if(took < policy.suspicious_seconds).alias("suspiciously_fast"))


def fast_reviews(reviews: DataFrame, policy: Policy = DEFAULT, limit: int = 10) -> DataFrame:
    took = seconds_between(F.col("made_at"), F.col("checked_at"))
    return reviews.where("state in ('approved', 'rejected')").withColumn("seconds", took).where(F.col("seconds") < policy.suspicious_seconds).orderBy("request_id").limit(limit)


_REVIEW = "request_id bigint, ref string, amount_minor bigint, reason_code string, maker string, made_at string, state string, checker string, checked_at string, note string"


def pending(requests: DataFrame) -> DataFrame:
    """Requests that wait for a checker, the longest waiting first."""
    return requests.where("state = 'pending'").orderBy("made_at", "request_id")


def _next(requests: DataFrame) -> int:
    return (requests.agg(F.max("request_id")).first()[0] or 0) + 1


def _added(ledger: Ledger, requests, schema: str, next_row) -> dict:
    """Appends what ``next_row`` makes of the requests; if another writer was first, it is asked again."""
    while True:
        version = ledger.version()
        row = next_row(requests(version))
        try:
            ledger.append(ledger.spark.createDataFrame([tuple(row[c] for c in ledger.columns)], schema), ["request_id"], expected=version)
            return row
        except Conflict:
            continue


class Reviews:
    """Maker-checker requests over a ledger of their versions."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy = DEFAULT) -> None:
        self.spark, self.policy = spark, policy
        self.ledger = Ledger(spark, root, _REVIEW)

    def requests(self, version: int | None = None) -> DataFrame:
        return current(self.ledger.events(version), ["request_id"], [c for c in self.ledger.columns if c != "request_id"])

    def propose(self, ref: str, amount_minor: int, reason_code: str, maker: str, at: str) -> tuple[int, str]:
        if not person_of(maker):
            raise ReviewError("a request needs a maker")
        state = "pending" if abs(amount_minor) >= self.policy.review_threshold_minor else "auto"

        def next_row(requests: DataFrame) -> dict:
            return dict(request_id=_next(requests), ref=ref, amount_minor=amount_minor, reason_code=reason_code, maker=maker, made_at=at, state=state, checker=None, checked_at=None, note=None)

        return _added(self.ledger, self.requests, _REVIEW, next_row)["request_id"], state

    def _decide(self, request_id: int, action: str, checker: str, note: str, at: str) -> float | None:
        wanted = self.spark.createDataFrame([(request_id, action, checker, note, at)], "request_id bigint, action string, checker string, note string, checked_at string")
        took = []

        def next_row(requests: DataFrame) -> dict:
            row = decide(requests, wanted).first()
            if row["reason"]:
                raise ReviewError(f"request {request_id}: {row['reason']}")
            took[:] = [row["seconds"]]
            return requests.where(F.col("request_id") == request_id).first().asDict() | dict(state=action, checker=checker, checked_at=at, note=note)

        _added(self.ledger, self.requests, _REVIEW, next_row)
        return took[0]

    def approve(self, request_id: int, checker: str, note: str, at: str) -> float | None:
        return self._decide(request_id, "approved", checker, note, at)

    def reject(self, request_id: int, checker: str, note: str, at: str) -> float | None:
        return self._decide(request_id, "rejected", checker, note, at)

    def pending(self) -> DataFrame:
        return pending(self.requests())


# ---- sign-off and backfill approval


def plan_hash(dates: list[str], row_counts: dict[str, int] | None = None) -> str:
    """Sixteen hex digits over the sorted dates and counts; the order they come in does not matter."""
    canonical = json.dumps({"dates": sorted(dates), "counts": dict(sorted((row_counts or {}).items()))}, sort_keys=True)
    return hashlib.sha256(canonical.encode()).hexdigest()[:16]


def protected(dates: DataFrame, signoffs: DataFrame) -> DataFrame:
    """The dates that are signed off."""
    return dates.join(signoffs, "business_date", "left_semi")


_SIGNOFF = "business_date date, signed_by string, at string, note string"
_BACKFILL = "request_id bigint, requested_by string, at string, reason string, dates array<string>, plan_hash string, state string, checker string, note string, expires_at string, consumed_at string"


class Periods:
    """Signed-off dates and backfill approvals, kept apart from the mart."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy = DEFAULT) -> None:
        self.spark, self.policy = spark, policy
        self.signed = Ledger(spark, f"{root}/signoff", _SIGNOFF)
        self.asked = Ledger(spark, f"{root}/backfill", _BACKFILL)

    def sign_off(self, day: str, by: str, at: str, note: str = "") -> None:
        if not person_of(by):
            raise ReviewError("a sign-off needs a person")
        row = self.spark.createDataFrame([(day, by, at, note)], "day string, signed_by string, at string, note string")
        self.signed.append(row.select(F.col("day").cast("date").alias("business_date"), "signed_by", "at", "note"), ["business_date"])

    def signoffs(self) -> DataFrame:
        return current(self.signed.events(), ["business_date"], ["signed_by", "at", "note"])

    def is_signed_off(self, day: str) -> bool:
        return bool(self.signed_off_within([day]))

    def signed_off_within(self, dates: list[str]) -> list[str]:
        frame = self.spark.createDataFrame([(d,) for d in dates], "d string").select(F.col("d").cast("date").alias("business_date"))
        return sorted(str(r[0]) for r in protected(frame, self.signoffs()).collect())

    def requests(self, version: int | None = None) -> DataFrame:
        return current(self.asked.events(version), ["request_id"], [c for c in self.asked.columns if c != "request_id"])

    def pending(self) -> DataFrame:
        return self.requests().where("state = 'pending'").orderBy("request_id")

    def _get(self, request_id: int, requests: DataFrame | None = None) -> dict:
        row = (self.requests() if requests is None else requests).where(F.col("request_id") == request_id).first()
        if row is None:
            raise NotAuthorised(f"there is no request {request_id}")
        return row.asDict()

    def _add(self, next_row) -> dict:
        return _added(self.asked, self.requests, _BACKFILL, next_row)

    def request_backfill(self, dates: list[str], by: str, reason: str, at: str, row_counts: dict[str, int] | None = None) -> int:
        if not person_of(by) or not person_of(reason):
            raise ReviewError("a backfill request needs a person and a reason")
        new = dict(requested_by=by, at=at, reason=reason, dates=sorted(dates), plan_hash=plan_hash(dates, row_counts), state="pending", checker=None, note=None, expires_at=None, consumed_at=None)
        return self._add(lambda requests: new | {"request_id": _next(requests)})["request_id"]

    def _decided(self, request_id: int, state: str, checker: str, note: str, **more) -> None:
        def next_row(requests: DataFrame) -> dict:
            row = self._get(request_id, requests)
            if row["state"] != "pending":
                raise NotAuthorised(f"request {request_id} is {row['state']}")
            if not person_of(checker) or person_of(checker) == person_of(row["requested_by"]):
                raise NotAuthorised(f"request {request_id} needs another person to decide")
            if not person_of(note):
                raise NotAuthorised(f"the decision on request {request_id} needs a note")
            return row | dict(state=state, checker=checker, note=note) | more

        self._add(next_row)

    def approve_backfill(self, request_id: int, checker: str, note: str, at: str, ttl_hours: int | None = None) -> None:
        expires = datetime.fromisoformat(at) + timedelta(hours=self.policy.approval_ttl_hours if ttl_hours is None else ttl_hours)
        self._decided(request_id, "approved", checker, note, expires_at=expires.isoformat())

    def reject_backfill(self, request_id: int, checker: str, note: str) -> None:
        self._decided(request_id, "rejected", checker, note)

    def authorise(self, dates: list[str], row_counts: dict[str, int] | None, at: str, request_id: int | None = None) -> dict:
        """What allows the run; raises if nothing does."""
        closed = self.signed_off_within(dates)
        if not closed:
            return {"reason": "no closed date", "protected": []}
        if request_id is None:
            raise NotAuthorised(f"closed dates need an approved request: {', '.join(closed[:5])}")
        row = self._get(request_id)
        why = refusal(row, plan_hash(dates, row_counts), at)
        if why:
            raise NotAuthorised(f"request {request_id}: {why}")
        return {"reason": f"approved by {row['checker']}", "protected": closed, "request_id": request_id}

    def consume(self, request_id: int, at: str) -> None:
        """An approval is for one run; called once that run has succeeded."""
        self._add(lambda requests: self._get(request_id, requests) | dict(consumed_at=at))


def refusal(row: dict, actual_hash: str, at: str) -> str | None:
    """The first reason why a request does not cover a plan, in the order state, use, expiry, plan."""
    if row["state"] != "approved":
        return f"it is {row['state']}"
    if row["consumed_at"]:
        return "it was used before"
    if row["expires_at"] and datetime.fromisoformat(row["expires_at"]) <= datetime.fromisoformat(at):
        return "it has expired"
    if row["plan_hash"] != actual_hash:
        return "the plan has changed since"
    return None


def resolve_with_review(queue, reviews: Reviews, request_id: int, break_type: str, role: str, at: str) -> None:
    """Resolves a break once its review is through (automatic or approved)."""
    row = reviews.requests().where(F.col("request_id") == request_id).first()
    if row is None or row["state"] not in ("auto", "approved"):
        raise ReviewError(f"request {request_id} does not allow a resolution")
    queue.resolve(row["ref"], break_type, row["reason_code"], row["maker"], role, at, row["note"] or "")
