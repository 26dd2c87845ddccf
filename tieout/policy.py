"""Numbers and vocabularies that decide outcomes, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Break classes, statuses, tiers, resolution codes and roles.
BREAK_TYPES = ("missing", "duplicate", "timing", "sign", "amount_fx", "amount_fee", "amount_unknown")
BUCKETS = ("0-1d", "2-3d", "4-5d", "6d+")
#: (least age in business days, tier, action)
TIERS = ((0, "T0", "analyst queue"), (3, "T1", "team lead review"), (5, "T2", "controller escalation"), (10, "T3", "executive escalation"))
#: code, limit in minor units (None: no limit), least role
RESOLUTION_CODES = (
    ("timing_confirmed", None, "analyst"),
    ("fee_schedule_verified", 50_000, "analyst"),
    ("fx_rounding_accepted", 1_000, "analyst"),
    ("duplicate_suppressed", None, "analyst"),
    ("counterparty_error", None, "supervisor"),
    ("internal_correction", None, "supervisor"),
    ("written_off", 10_000, "controller"),
)
ROLES = (("analyst", 1), ("supervisor", 2), ("controller", 3))
UNKNOWN_ROLE_NEEDED = 99


@dataclass(frozen=True)
class Policy:
    """Tolerances and thresholds of a run."""

    fx_rounding_minor: int = 2
    fee_max_bps: int = 35
    fee_min_minor: int = 25
    date_tolerance_days: int = 1
    strict_currency: bool = False
    review_threshold_minor: int = 100_000
    suspicious_seconds: float = 10.0
    approval_ttl_hours: int = 24
    reorder_grace: int = 50
    max_silence_seconds: int = 300


DEFAULT = Policy()
