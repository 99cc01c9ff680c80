"""Football odds-market analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

from oddsframe.session import build_session

__all__ = ["build_session"]
