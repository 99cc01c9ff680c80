"""CSV and JSON-lines exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.operators.quotes import FLAT_COLUMNS

# Export headers, in order.
POOL_HEADERS = [
    "pool", "rule", "ruleLabel", "frontEndId", "matchId", "kickOffTime", "status", "tournament", "tournamentCode", "home",
    "away", "line", "selection", "selectionName", "odds", "homeOdds", "drawOdds", "awayOdds", "poolStatus", "lineStatus",
    "combinationStatus", "updateAt", "sourcePage",
]
PROBABILITY_HEADERS = [
    "matchId", "league", "kickoffTime", "state", "score", "home", "away", "companyName", "companyId", "market", "oddsType",
    "type", "percent", "description", "count", "overCount", "underCount", "overPercent", "underPercent", "kind", "rawLine",
    "sourcePage", "sourceLabel",
]
CROWD_HEADERS = [
    "matchId", "guessId", "league", "kickoffTime", "state", "score", "home", "away", "homeRank", "awayRank", "asianLine",
    "asianLineOdds", "asianCount", "asianHomePercent", "asianAwayPercent", "asianHomeSupportOdds", "asianAwaySupportOdds",
    "asianLean", "asianEdge", "totalLine", "totalLineOdds", "totalCount", "overPercent", "underPercent", "overSupportOdds",
    "underSupportOdds", "totalLean", "totalEdge", "maxPercent", "maxEdge", "hot", "detailUrl", "sourcePage",
]
HEADERS = {"flat": FLAT_COLUMNS, "pool": POOL_HEADERS, "probability": PROBABILITY_HEADERS, "crowd": CROWD_HEADERS}
# Table columns whose names differ from the header by more than the case style.
_OTHER_NAMES = {"kickOffTime": "kickoff_ts", "kickoffTime": "kickoff_raw", "combinationStatus": "comb_status"}


# Columns kept for a model's input, in order.
COMPACT_POOL = [
    "pool", "rule", "ruleLabel", "frontEndId", "matchId", "rawMatchId", "kickOffTime", "status", "tournament", "home", "away",
    "line", "selection", "selectionName", "odds", "homeOdds", "drawOdds", "awayOdds", "poolStatus", "lineStatus",
    "combinationStatus", "updateAt", "sourcePage",
]
COMPACT_PROBABILITY = [
    "matchId", "league", "kickoffTime", "state", "score", "home", "away", "companyName", "market", "oddsType", "type", "percent",
    "description", "count", "overCount", "underCount", "overPercent", "underPercent", "kind", "rawLine", "sourcePage",
]
COMPACT_CROWD = [
    "matchId", "guessId", "league", "kickoffTime", "state", "score", "home", "away", "homeRank", "awayRank", "asianLine",
    "asianLineOdds", "asianCount", "asianHomePercent", "asianAwayPercent", "asianHomeSupportOdds", "asianAwaySupportOdds",
    "asianLean", "asianEdge", "totalLine", "totalLineOdds", "totalCount", "overPercent", "underPercent", "overSupportOdds",
    "underSupportOdds", "totalLean", "totalEdge", "maxPercent", "maxEdge", "hot", "detailUrl", "sourcePage",
]
COMPACT = {"flat": FLAT_COLUMNS, "pool": COMPACT_POOL, "probability": COMPACT_PROBABILITY, "crowd": COMPACT_CROWD}


def _column(df: DataFrame, header: str) -> Column:
    """The table column behind an export header, as text."""
    snake = re.sub(r"(?<!^)([A-Z])", r"_\1", header).lower()
    for name in (header, snake, _OTHER_NAMES.get(header)):
        if name in df.columns:
            return F.col(name).cast("string")
    return F.lit(None).cast("string")


def export_columns(df: DataFrame, kind: str) -> DataFrame:
    """The header set of a kind as text columns, '' where a value is missing."""
    return df.select(*[F.coalesce(_column(df, h), F.lit("")).alias(h) for h in HEADERS[kind]])


def compact_rows(df: DataFrame, kind: str = "flat") -> DataFrame:
    """The model-input columns of a kind, and each row as JSON without its empty values."""
    rows = df.select(*[F.nullif(_column(df, h), F.lit("")).alias(h) for h in COMPACT[kind]])
    return rows.withColumn("compact_json", F.to_json(F.struct(*COMPACT[kind])))


def write_csv(df: DataFrame, path: str, kind: str = "flat") -> None:
    """Every field quoted, quotes doubled; one file per task."""
    out = export_columns(df, kind)
    out.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; missing values are left out."""
    df.write.mode("overwrite").json(path)
