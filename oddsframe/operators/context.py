"""Fixture context: candidate dates, scoped rows, weather, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.functions.odds import round_n
from oddsframe.functions.text import text
from oddsframe.operators.link import link_fixtures
from oddsframe.operators.quotes import pick_first
from oddsframe.session import written


def kickoff_date(raw: Column, now: Column) -> Column:
    """Date in a kickoff text: a full date, or month and day in the year of `now`."""
    iso = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
    month_day = r"\b(\d{1,2})[-/](\d{1,2})\b"
    part = lambda p, i: F.lpad(F.regexp_extract(raw, p, i), 2, "0")
    full = F.concat_ws("-", F.regexp_extract(raw, iso, 1), part(iso, 2), part(iso, 3))
    short = F.concat_ws("-", F.year(now).cast("string"), part(month_day, 1), part(month_day, 2))
    return F.when(raw.rlike(iso), full.try_cast("date")).when(raw.rlike(month_day), short.try_cast("date"))


def candidate_dates(matches: DataFrame, now: Column, kickoff: Column | None = None) -> DataFrame:
    """Dates to look up fixtures for: today, tomorrow, and each kickoff date and its neighbours.

    Dates are merged before they are spread, so the work after the scan is per date.
    """
    day = kickoff if kickoff is not None else kickoff_date(text(F.col("kickoff_raw")), now)
    dates = matches.select(day.alias("d")).where("d is not null").distinct()
    around = dates.select(F.explode(F.array(F.date_sub("d", 1), F.col("d"), F.date_add("d", 1))).alias("fixture_date"))
    today = F.to_date(now)
    fixed = matches.sparkSession.range(1).select(F.explode(F.array(today, F.date_add(today, 1))).alias("fixture_date"))
    return around.unionByName(fixed).distinct()


def context_for_match(docs: DataFrame, ctx: DataFrame) -> DataFrame:
    """Context rows of the given matches, plus the rows that name no match.

    Rows without a match hold for every match; they are kept once, as scope `general` with no
    match id, instead of once per match.  A match's context is its own rows and the general ones.
    """
    key = lambda c: F.lower(F.trim(text(F.col(c))))
    ids = docs.select("match_id", key("match_id").alias("_k"))
    keyed = ctx.withColumn("_k", key("match_id"))
    own = ids.join(keyed.where("_k <> ''").drop("match_id"), "_k").drop("_k").withColumn("scope", F.lit("own"))
    general = keyed.where("_k = ''").drop("_k", "match_id").withColumns(
        {"match_id": F.lit(None).cast("string"), "scope": F.lit("general")}
    )
    return own.unionByName(general)


def weather_at_kickoff(fixtures: DataFrame, hourly: DataFrame) -> DataFrame:
    """Forecast of the kickoff hour per fixture, else the place's first hour.

    fixtures: fixture_id, place, kickoff_ts; hourly: place, hour_ts and the measures.
    """
    hours = pick_first(hourly.withColumn("_hour", F.date_trunc("hour", "hour_ts")), ["place", "_hour"], [F.col("hour_ts")])
    first = pick_first(hourly, ["place"], [F.col("hour_ts")])
    measures = [c for c in hourly.columns if c != "place"]
    at = fixtures.withColumn("_hour", F.date_trunc("hour", "kickoff_ts"))
    exact = hours.select("place", "_hour", F.struct(*measures).alias("_w"))
    fallback = first.select("place", F.struct(*measures).alias("_f"))
    joined = at.join(exact, ["place", "_hour"], "left").join(fallback, "place", "left")
    out = joined.withColumn("_x", F.coalesce("_w", "_f")).withColumn("exact_hour", F.col("_w").isNotNull())
    return out.select(*fixtures.columns, "exact_hour", "_x.*")


def assemble_context(
    matches: DataFrame,
    fixtures: DataFrame,
    injuries: DataFrame,
    lineups: DataFrame,
    weather: DataFrame,
    keys: tuple[str, ...] = ("batch_id",),
    rosters: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The context tables of a batch: linked fixtures, their rows tagged with the match, and gaps.

    Linking runs once: its one row per match is written to the shared folder, and all tables read that.
    rosters: fixture_id, squad; with it injuries name a squad in place of a fixture and belong to all its fixtures.
    Matches meet their squads first, so that the rows of a squad are not shuffled once a fixture.
    """
    linked = written(link_fixtures(matches, fixtures, keys=keys), "linked")
    tag = linked.select(*keys, "match_id", "fixture_id")
    fixture_cols = [c for c in fixtures.columns if c not in {*keys, "home", "away", "source_index"}]
    titled = matches.select(
        *keys, "match_id", *[F.col(c).alias(f"match_{c}") for c in ("league", "home", "away") if c in matches.columns]
    )
    found = (
        linked.withColumn("match_score", round_n(F.col("score"), 3))
        .select(*keys, "match_id", "fixture_id", "match_score", "reversed")
        .join(titled, [*keys, "match_id"])
        .join(fixtures.select(*keys, *fixture_cols), [*keys, "fixture_id"])
    )
    hurt = tag.join(injuries, "fixture_id") if rosters is None else tag.join(rosters, "fixture_id").join(injuries, "squad").drop("squad")
    gaps = matches.join(linked.select(*keys, "match_id"), [*keys, "match_id"], "left_anti")
    title = F.concat_ws(" · ", *[F.nullif(F.col(c), F.lit("")) for c in ("league", "home", "away") if c in matches.columns])
    missing = gaps.select(*keys, "match_id", F.lit("fixture_match").alias("type"), title.alias("title"), F.lit("no reliable fixture").alias("reason"))
    status = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("requested")).join(
        linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("linked")), list(keys), "left"
    )
    return {
        "fixture_matches": found,
        "injuries": hurt,
        "lineups": tag.join(lineups, "fixture_id"),
        "weather": tag.join(weather, "fixture_id"),
        "missing": missing,
        "source_status": status.withColumn("linked", F.coalesce("linked", F.lit(0))),
    }


def union_context(tables: dict[str, DataFrame]) -> DataFrame:
    """All context rows as (match_id, kind, item json)."""
    parts = [
        df.select("match_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "match_id"])).alias("item"))
        for kind, df in tables.items()
        if "match_id" in df.columns
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
