"""Points in time as text and numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(time: Column, zoned: bool = True) -> Column:
    """Microseconds since 1970 in UTC. ``zoned``: a timestamp with time zone; else one without, taken as UTC."""
    if zoned:
        return F.unix_micros(time)
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    return days * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def epoch_millis(time: Column, zoned: bool = True) -> Column:
    """Whole milliseconds since 1970, rounded down."""
    return F.floor(micros(time, zoned) / F.lit(1000).cast("decimal(20,0)")).cast("long")


def iso_utc(time: Column, zoned: bool = True) -> Column:
    """ISO 8601 in UTC with its offset: microseconds if there are any, as ``2024-05-01T10:00:00.000120+00:00``."""
    n = micros(time, zoned)
    part = F.pmod(n, F.lit(1_000_000).cast("long"))
    whole = F.expr(_EPOCH) + F.make_dt_interval(secs=((n - part) / 1_000_000).cast("decimal(18,6)"))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))
