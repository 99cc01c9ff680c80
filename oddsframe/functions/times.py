"""Kickoff parsing and time closeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = r"(\d{4})-(\d{1,2})-(\d{1,2}).*?(\d{1,2}):(\d{2})"
_MONTH_DAY = r"(\d{1,2})-(\d{1,2}).*?(\d{1,2}):(\d{2})"
_CLOCK = r"(\d{1,2}):(\d{2})"


def _part(raw: Column, pattern: str, group: int) -> Column:
    return F.lpad(F.regexp_extract(raw, pattern, group), 2, "0")


def _stamp(day: Column, hour: Column, minute: Column) -> Column:
    return F.try_to_timestamp(F.concat(day, F.lit(" "), hour, F.lit(":"), minute), F.lit("yyyy-MM-dd HH:mm")).cast(
        "timestamp_ntz"
    )


def parse_kickoff(raw: Column, now: Column) -> Column:
    """Kickoff from the four text forms in use.

    ISO or `yyyy-MM-dd ... HH:mm`, `MM-dd ... HH:mm` in the year of `now`, and `HH:mm`,
    which moves to the next day when more than two hours past.  A day that its year lacks, such as
    29 February of another year, gives NULL.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, "/", "-"), r"\s+", " "))
    now = now.cast("timestamp_ntz")
    iso_zone = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp").cast("timestamp_ntz")
    )
    full_day = F.concat(
        F.regexp_extract(t, _FULL, 1), F.lit("-"), _part(t, _FULL, 2), F.lit("-"), _part(t, _FULL, 3)
    )
    full = F.when(t.rlike(_FULL), _stamp(full_day, _part(t, _FULL, 4), _part(t, _FULL, 5)))
    month_day = F.concat(
        F.year(now).cast("string"), F.lit("-"), _part(t, _MONTH_DAY, 1), F.lit("-"), _part(t, _MONTH_DAY, 2)
    )
    partial = F.when(t.rlike(_MONTH_DAY), _stamp(month_day, _part(t, _MONTH_DAY, 3), _part(t, _MONTH_DAY, 4)))
    today = F.date_format(now, "yyyy-MM-dd")
    clock = F.when(t.rlike(_CLOCK), _stamp(today, _part(t, _CLOCK, 1), _part(t, _CLOCK, 2)))
    rolled = F.when(clock < now - F.expr("interval 2 hours"), clock + F.expr("interval 1 day")).otherwise(clock)
    return F.coalesce(iso_zone, F.when(t.rlike(_FULL), full).when(t.rlike(_MONTH_DAY), partial).otherwise(rolled))


# fixed values: score up to so many minutes apart, then the score beyond
DATED_STEPS = ((10, 1.0), (60, 0.8), (180, 0.55), 0.0)
CLOCK_STEPS = ((10, 1.0), (60, 0.8), (120, 0.55), 0.25)


def _stepped(gap: Column, steps: tuple) -> Column:
    *upto, beyond = steps
    return F.coalesce(*[F.when(gap <= most, score) for most, score in upto], F.lit(beyond))


def time_score(gap_minutes: Column, clock_only: Column | None = None) -> Column:
    """Closeness of two kickoffs; a clock without a date compares around the day."""
    dated = _stepped(gap_minutes, DATED_STEPS)
    unknown = gap_minutes.isNull()
    if clock_only is None:
        return F.when(unknown, 0.5).otherwise(dated)
    turn = gap_minutes % 1440
    around = F.least(turn, F.lit(1440) - turn)
    clock = _stepped(around, CLOCK_STEPS)
    return F.when(unknown, 0.5).when(clock_only, clock).otherwise(dated)


def script_time(col: Column) -> Column:
    """`y,m-1,d,h,mi,s` as text `yyyy-MM-dd HH:mm:ss`; other text unchanged."""
    p = F.split(col, ",")
    two = lambda i: F.lpad(p[i], 2, "0")
    made = F.concat(
        p[0], F.lit("-"), F.lpad(F.split(p[1], "-")[0], 2, "0"), F.lit("-"), two(2),
        F.lit(" "), two(3), F.lit(":"), two(4), F.lit(":"), two(5),
    )
    return F.when(F.size(p) == 6, made).otherwise(col)
