"""Parsing, formatting and day arithmetic on epoch milliseconds; the day zone is a fixed offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000
ZONE_MS = 8 * 3_600_000


def parse_ms(value: Column, kind: T.DataType, strict: bool = False) -> Column:
    """Epoch ms of a timestamp, or of text or a long: 10 digits are seconds, 13 are ms, else local text.

    Anything else is null, or with ``strict`` an error.
    """
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(value.cast("timestamp"))
    if not isinstance(kind, (T.StringType, T.LongType)):
        if strict:
            raise ValueError(f"no time can be read from {kind.simpleString()}")
        return F.lit(None).cast("long")
    s = value.cast("string")
    text = F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    local = F.unix_millis(text) - ZONE_MS
    digits = s.rlike("^[0-9]+$")
    out = F.when(digits & (F.length(s) == 10), s.try_cast("long") * 1000).when(digits & (F.length(s) == 13), s.try_cast("long")).otherwise(local)
    return F.when(out.isNull() & value.isNotNull(), F.raise_error(F.concat(F.lit("not a time: "), s)).cast("long")).otherwise(out) if strict else out


def floor_to(ms: Column, slide: int) -> Column:
    """Start of the pane that holds ``ms``."""
    return ms - F.pmod(ms, F.lit(slide))


def format_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local text of epoch seconds; needs the session zone UTC."""
    return F.date_format(F.timestamp_seconds(seconds + ZONE_MS // 1000), pattern)


def format_day(seconds: Column) -> Column:
    return format_text(seconds, "yyyy-MM-dd")


def day_start(ms: Column, zone_ms: int = ZONE_MS) -> Column:
    """Epoch ms of the local midnight at or before ``ms``."""
    return ms - F.pmod(ms + zone_ms, F.lit(DAY_MS))


def last_pane(ms: Column, slide: int, zone_ms: int = ZONE_MS) -> Column:
    return day_start(ms, zone_ms) + (DAY_MS - slide)


def windows_after(pane: Column, slide: int, until: Column, zone_ms: int = ZONE_MS) -> Column:
    """Ends of the windows of the pane's day that a late row in ``pane`` changes, up to ``until``."""
    end = F.least(day_start(pane, zone_ms) + DAY_MS, until)
    return F.when(end >= pane + slide, F.sequence(pane + slide, end, F.lit(slide))).otherwise(F.array().cast("array<bigint>"))
