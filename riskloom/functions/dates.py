"""ISO-8601 formatting and parsing of event times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_format(ts: Column) -> Column:
    """'YYYY-MM-DDTHH:MM:SS' plus '.ffffff' only when the microseconds are
    non-zero (Python's isoformat)."""
    frac = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def parse_iso(s: Column) -> Column:
    """ISO text → TIMESTAMP_NTZ (no time-zone shift)."""
    return F.to_timestamp_ntz(s)
