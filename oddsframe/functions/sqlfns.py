"""The scalar helpers as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "first_number(s STRING) RETURNS DOUBLE": r"try_cast(regexp_extract(replace(s, ',', ''), '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE)",
    "norm_odds(s STRING) RETURNS STRING": (
        "CASE WHEN coalesce(trim(s), '') = '' THEN '' WHEN try_cast(trim(s) AS DECIMAL(18,6)) IS NULL THEN trim(s) "
        "ELSE cast(cast(try_cast(trim(s) AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS STRING) END"
    ),
    "hk_odds(d DECIMAL(18,6)) RETURNS DECIMAL(18,2)": "cast(d - 1 AS DECIMAL(18,2))",
    "decimal_odds(h DECIMAL(18,6)) RETURNS DECIMAL(18,2)": "cast(h + 1 AS DECIMAL(18,2))",
    "line_value(s STRING) RETURNS DOUBLE": (
        "CASE WHEN trim(s) <> '' THEN aggregate(transform(split(s, '/'), p -> try_cast(trim(p) AS DOUBLE)), 0D, (a, p) -> a + p) "
        "/ size(split(s, '/')) END"
    ),
    "implied_overround(w DOUBLE, d DOUBLE, l DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN w <> 0 AND d <> 0 AND l <> 0 THEN 1D / w + 1D / d + 1D / l END"
    ),
    "fair_share(p DOUBLE, w DOUBLE, d DOUBLE, l DOUBLE) RETURNS DOUBLE": (
        "CASE WHEN w <> 0 AND d <> 0 AND l <> 0 THEN (1D / p) / (1D / w + 1D / d + 1D / l) END"
    ),
    "risk_label(s DOUBLE) RETURNS STRING": "CASE WHEN s >= 70 THEN '高' WHEN s >= 40 THEN '中' ELSE '低' END",
    "confidence_label(s DOUBLE) RETURNS STRING": "CASE WHEN s >= 72 THEN '高' WHEN s >= 50 THEN '中' ELSE '低' END",
    "pressure_label(s DOUBLE) RETURNS STRING": "CASE WHEN s >= 70 THEN '強' WHEN s >= 40 THEN '中' ELSE '弱' END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the session's SQL functions; they inline into the plan like built-in expressions."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
