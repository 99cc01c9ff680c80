"""Market checks stated as analyst rules: drift, totals conflict, outliers, series quality, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.functions import odds
from oddsframe.operators.features import _mean
from oddsframe.operators.ordered import previous_row


def favourite_drift(quotes: DataFrame, deep_line: float = 0.75) -> DataFrame:
    """Favourite's mean fair share open and latest; veto when it falls while the handicap stays deep."""
    c = F.col
    europe = c("market") == "europe"
    asian = (c("market") == "asian") & (c("period") == "full")
    opened = odds.implied(c("ini_a"), c("ini_draw"), c("ini_b"))
    latest = odds.implied(c("cur_a"), c("cur_draw"), c("cur_b"))
    share = lambda p, s: _mean(F.when(europe, p[f"fair_{s}"]), odds.SHARE_TICK)
    per = quotes.groupBy("match_id").agg(
        *[share(opened, s).alias(f"o_{s}") for s in ("home", "away")],
        *[share(latest, s).alias(f"l_{s}") for s in ("home", "away")],
        F.median(F.when(asian, c("cur_line"))).alias("line_latest"),
        F.median(F.when(asian, c("ini_line"))).alias("line_open"),
    )
    home = c("o_home") >= c("o_away")
    fav = F.when(home, F.lit("home")).when(~home, F.lit("away"))
    out = per.withColumns(
        {
            "favourite": fav,
            "share_open": odds.round_n(F.when(home, c("o_home")).otherwise(c("o_away")), 4),
            "share_latest": odds.round_n(F.when(home, c("l_home")).otherwise(c("l_away")), 4),
        }
    ).where("favourite is not null")
    deep = (F.abs(c("line_latest")) >= deep_line) & (F.abs(c("line_latest")) >= F.abs(c("line_open")))
    out = out.withColumn("gravity_veto", F.coalesce((c("share_latest") < c("share_open")) & deep, F.lit(False)))
    return out.select("match_id", "favourite", "share_open", "share_latest", "line_open", "line_latest", "gravity_veto")


def totals_conflict(quotes: DataFrame, low_water: float = 0.82) -> DataFrame:
    """Full-time total line cut since opening while under is at low water."""
    c = F.col
    rows = quotes.where((c("market") == "over_under") & (c("period") == "full"))
    per = rows.groupBy("match_id").agg(
        odds.round_n(_mean(c("cur_line") - c("ini_line")), 4).alias("line_change"), odds.round_n(_mean(c("cur_b")), 3).alias("under_avg")
    )
    return per.withColumn("low_goal_risk", F.coalesce((c("line_change") < 0) & (c("under_avg") <= low_water), F.lit(False)))


def outlier_book(quotes: DataFrame, far: float = 0.2, calm: float = 0.1) -> DataFrame:
    """Bookmakers whose price moved far while the section's median bookmaker did not."""
    c, section = F.col, ["match_id", "market", "period"]
    per_book = quotes.groupBy(*section, "company_id").agg(_mean(F.abs(c("cur_a") - c("ini_a"))).alias("move"))
    middle = per_book.groupBy(*section).agg(F.median("move").alias("median_move"), F.count(F.lit(1)).alias("books"))
    out = per_book.join(middle, section).where((c("move") >= far) & (c("median_move") <= calm) & (c("books") >= 3))
    return out.withColumns({"move": odds.round_n(c("move"), 4), "median_move": odds.round_n(c("median_move"), 4)})


def series_quality(
    ticks: DataFrame, now: Column, keys: tuple[str, ...] = ("match_id", "bookmaker_key"), index: str = "event_id",
    gap_hours: float = 6, stale_hours: float = 24, block: int = 100_000,
) -> DataFrame:
    """Per series in arrival order: ticks, gaps, repeated times, reversed times, staleness."""
    rows = previous_row(ticks, list(keys), F.floor(F.col(index) / block), [index], ["ts"])
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp"))) / 3.6e9
    per = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count_if(F.col("_step") > gap_hours).alias("gaps"),
        F.count_if(F.col("_step") == 0).alias("duplicates"),
        F.count_if(F.col("_step") < 0).alias("reversed"),
        F.max("ts").alias("last_ts"),
    )
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_hours * 3600.0).cast("decimal(18,6)"))
    return per.withColumn("stale", F.col("last_ts") < now.cast("timestamp_ntz") - age)


def market_completeness_gate(docs: DataFrame) -> DataFrame:
    """Two or more of five markets missing raises the risk; missing context caps the confidence.

    Optional flags: has_injuries, has_lineups, has_xg (absent columns count as missing).
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in docs.columns else F.lit(False)
    injuries, lineups, xg = (flag(n) for n in ("has_injuries", "has_lineups", "has_xg"))
    cap = F.when(~injuries, F.lit(60)).otherwise(F.lit(100))
    cap = F.least(cap, F.when(~injuries & ~lineups & ~xg, F.lit(65)).otherwise(F.lit(100)))
    return docs.withColumns({"raise_risk": F.size("missing_markets") >= 2, "confidence_cap": cap})
