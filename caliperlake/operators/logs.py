"""Append-only logs: replay, folds, transitions, leases, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay_check(events: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Each key once: how many rows say the same, and whether any says otherwise."""
    hashed = events.withColumn("_hash", content)
    return hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("_hash").alias("kinds")).withColumn("conflict", F.col("kinds") > 1)


def first_writer(entries: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The entry that was written first for each key."""
    return entries.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value), F.count("*").alias("writes"))


def last_writer(commands: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value that the last command set for each key."""
    return commands.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("commands"))


def invalid_transitions(log: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Rows whose step from the state before is not among the allowed pairs (from_state, to_state)."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state)).where("from_state is not null")
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")  # a fixed rule table


def leases(events: DataFrame, keys: list[str], ts: str, seconds: int = 300) -> DataFrame:
    """Tenures: acquisitions and renewals no further apart than the lease; each ends one lease after its last event."""
    window = F.session_window(ts, f"{seconds} seconds")
    return events.groupBy(*keys, window).agg(F.count("*").alias("renewals")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "renewals")


def job_outcomes(events: DataFrame, key: str, order: list[str], state: str, good: str, bad: str) -> DataFrame:
    """The first terminal state of each job, how many terminal rows it has, and its attempts."""
    terminal = F.col(state).isin(good, bad)
    first = F.min_by(F.when(terminal, F.col(state)), F.when(terminal, F.struct(*order)))
    return events.groupBy(key).agg(first.alias("outcome"), F.count_if(terminal).alias("terminals"), F.count_if(~terminal).alias("attempts"))


def tenures(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Leases of a document's editors from acquire, renew and release events: doc_id, operator, ts, kind -> start, end, renewals.

    An event starts a lease unless the one before it, not a release, is under a lease's length ago; a release ends it at once, all else one lease after its last event.
    """
    w = Window.partitionBy("doc_id", "operator").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    fresh = F.lag("ts").over(w).isNull() | (F.lag("kind").over(w) == "release") | (gap >= F.expr(f"interval {seconds} seconds"))
    df = events.withColumn("_k", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("ts", "kind"))
    g = df.groupBy("doc_id", "operator", "_k").agg(F.min("ts").alias("start"), last.alias("_last"), F.count("*").alias("renewals"))
    end = F.when(F.col("_last.kind") == "release", F.col("_last.ts")).otherwise(F.col("_last.ts") + F.expr(f"interval {seconds} seconds"))
    return g.select("doc_id", "operator", "start", end.alias("end"), "renewals")


def cache_lookups(lookups: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Lookups against the entry that was written first for their key: a miss, a hit, or an entry whose identity, response digest or provenance is not right.

    lookups: keys, lookup_id, identity; entries: keys, written, identity, response_sha, stored_sha, provenance_ok.
    """
    first = entries.groupBy(*keys).agg(F.min_by(F.struct("identity", "response_sha", "stored_sha", "provenance_ok"), "written").alias("e"))
    df = lookups.join(first, keys, "left")
    good = (F.col("e.identity") == F.col("identity")) & (F.col("e.response_sha") == F.col("e.stored_sha")) & F.col("e.provenance_ok")
    return df.select("lookup_id", F.when(F.col("e").isNull(), "cache_miss").when(F.coalesce(good, F.lit(False)), "cache_hit_valid").otherwise("cache_provenance_invalid").alias("result"))
