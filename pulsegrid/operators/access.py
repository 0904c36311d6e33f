"""Row-level access, subscriptions and the serving lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.catalog import FIELDS
from pulsegrid.functions.columns import glob_match


MOST_RULES = 10_000


def authorized(requests: DataFrame, policy: DataFrame, principal: str = "principal", patient: str = "patient_id") -> DataFrame:
    """Requests that some policy row (principal_pattern, patient_pattern) allows; patterns are shell globs.

    The policy is a configured list of at most MOST_RULES rows, which is checked, as it travels to all tasks. A request
    without a principal is not allowed.
    """
    if policy.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"a policy holds at most {MOST_RULES} rules")
    rules = policy.agg(F.collect_list(F.struct("principal_pattern", "patient_pattern")).alias("_rules"))
    hit = F.exists("_rules", lambda r: glob_match(F.col(principal), r["principal_pattern"]) & glob_match(F.col(patient), r["patient_pattern"]))
    return requests.crossJoin(F.broadcast(rules)).where(F.coalesce(hit, F.lit(False))).drop("_rules")  # a single row


def connections_for(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event with the connections that subscribe to its patient."""
    return events.join(subscriptions.where("connection_id is not null").select("patient_id", "connection_id"), "patient_id")


def subscriptions_after(changes: DataFrame) -> DataFrame:
    """The open subscriptions after connect and disconnect rows (connection_id, patient_id, action, at)."""
    last = changes.groupBy("connection_id").agg(F.max_by(F.struct("patient_id", "action"), "at").alias("r"))
    return last.where("r.action = 'connect'").select("connection_id", "r.patient_id")


def public_columns(df: DataFrame) -> DataFrame:
    """df without internal columns, whose names start with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def with_measured_at(state: DataFrame) -> DataFrame:
    """Latest-state rows with the newest of their vitals' times, for readers of the older single-time format."""
    times = [F.col(f"{f}_event_timestamp") for f in FIELDS if f"{f}_event_timestamp" in state.columns]
    return public_columns(state).withColumn("event_timestamp", F.greatest(*times))
