"""One normaliser for people's names, and role ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.policy import ROLES, UNKNOWN_ROLE_NEEDED


def person(name: Column) -> Column:
    """Trimmed of any white space, lower case; null: empty."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))


def person_of(name: str | None) -> str:
    """The same for a driver-side value."""
    return (name or "").strip().lower()


def rank(role: Column, unknown: int = 0) -> Column:
    out = F
    for name, value in ROLES:
        out = out.when(role == name, value)
    return out.otherwise(unknown)


def role_covers(have: Column, need: Column) -> Column:
    """Whether a role is at least another; an unknown role has none, an unknown need is out of reach."""
    return rank(have, 0) >= rank(need, UNKNOWN_ROLE_NEEDED)


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b as a double; null where either is not a timestamp."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c.cast("string")))
    return (micros(b) - micros(a)) / 1e6
