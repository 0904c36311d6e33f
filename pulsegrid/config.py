"""Settings of the engine, passed to operators instead of global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Windows in minutes from an encounter's start, label rule, approved model and the clock of eligibility."""

    feature_minutes: int = 15
    outcome_minutes: int = 15
    min_repeated_extremes: int = 2
    as_of: str | None = None  # timestamp text in UTC; none: the current time
    approved_model: str | None = None
    train_buckets: int = 8
    max_stay_hours: int = 1000
    #: Rows and bytes (as JSON) up to which a dimension is broadcast; beyond either the join shuffles.
    broadcast_rows: int = 100_000
    broadcast_bytes: int = 32 << 20
