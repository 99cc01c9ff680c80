"""Keyed result cache with an expiry, and stale snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.operators.features import crowd_hot
from oddsframe.operators.quotes import pick_last

TTL_HOURS = 48
STALE_HOURS = 6


def _hours(h: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(h) * 3600).cast("decimal(18,6)"))


def latest_results(results: DataFrame, index: str = "source_index", ttl_hours: float = TTL_HOURS) -> DataFrame:
    """Newest result per all-digit match id, with its expiry."""
    rows = results.withColumn("match_id", F.trim("match_id")).where(F.col("match_id").rlike(r"^\d+$"))
    out = pick_last(rows, ["match_id"], [F.col("saved_at"), F.col(index)])
    return out.withColumn("expires_at", F.col("saved_at") + _hours(ttl_hours))


def live_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; an entry without an expiry is dropped."""
    return entries.where(F.col("expires_at") > now.cast("timestamp_ntz"))


def cache_upsert(current: DataFrame, results: DataFrame, now: Column, ttl_hours: float = TTL_HOURS, index: str = "source_index") -> DataFrame:
    """Current entries with the results written over them, expired ones gone."""
    both = current.drop("expires_at").unionByName(results, allowMissingColumns=True)
    return live_entries(latest_results(both, index, ttl_hours), now)


def cache_listing(entries: DataFrame, now: Column) -> DataFrame:
    """Live entries, newest first."""
    return live_entries(entries, now).orderBy(F.desc("saved_at"), "match_id")


def cache_stats(entries: DataFrame, now: Column, ttl_hours: float = TTL_HOURS) -> DataFrame:
    return live_entries(entries, now).agg(
        F.count(F.lit(1)).alias("entries"), F.max("saved_at").alias("updated_at"), F.lit(float(ttl_hours)).alias("ttl_hours")
    )


def stale_flag(snapshot: DataFrame, now: Column, ttl_hours: float = STALE_HOURS, threshold: int = 70) -> DataFrame:
    """The last good snapshot served again: age, stale mark, and `hot` by the current threshold."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("saved_at").cast("timestamp"))) / 3.6e9
    out = snapshot.withColumn("age_hours", age).withColumn("stale", F.col("age_hours") > ttl_hours)
    return crowd_hot(out, threshold) if "asian_home_percent" in snapshot.columns else out
