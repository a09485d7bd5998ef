"""Times: event time, windows and freshness. All take an explicit ``as_of``, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parsed(text: Column | str) -> Column:
    """The time of an RFC 3339 text, or null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(t))


def event_time(valid_from: Column | str = "valid_from", created_at: Column | str = "created_at") -> Column:
    """B1: valid_from if it parses, else created_at; null if neither does."""
    return F.coalesce(parsed(valid_from), parsed(created_at))


def parse_time_bound(text: Column | str, upper: bool) -> Column:
    """B2: a time, or a date that stands for its first or last moment; anything else is an error."""
    t = F.col(text) if isinstance(text, str) else text
    day = F.try_to_timestamp(F.concat(t, F.lit("T23:59:59.999Z" if upper else "T00:00:00Z")))
    bound = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(parsed(t))
    return F.when(bound.isNull() & t.isNotNull(), F.raise_error(F.concat(F.lit("not a time bound: "), t)).cast("timestamp")).otherwise(bound)


def in_window(df: DataFrame, since: str | None, until: str | None, time: Column | None = None) -> DataFrame:
    """Rows inside, ends included; rows without a time pass."""
    at = event_time() if time is None else time
    ok = F.lit(True)
    if since is not None:
        ok = ok & (at >= parse_time_bound(F.lit(since), False))
    if until is not None:
        ok = ok & (at <= parse_time_bound(F.lit(until), True))
    return df.where(at.isNull() | ok)


def last_days(df: DataFrame, n: int, as_of: str, time: Column | None = None) -> DataFrame:
    """Rows of the last n days before as_of."""
    at = event_time() if time is None else time
    return df.where(at.isNull() | (at >= F.timestamp_add("DAY", F.lit(-n), F.lit(as_of).cast("timestamp"))))


def freshness(at: Column | str, decay_days: float, as_of: str) -> Column:
    """C17: exp(-age / decay) by whole seconds of age, 1 for the future, 0.5 without a time."""
    t = F.col(at) if isinstance(at, str) else at
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(t)) / 86400.0
    # least and greatest would pass over a null
    return F.when(t.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-age / decay_days))))
