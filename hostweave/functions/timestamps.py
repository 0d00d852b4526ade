"""Timestamp text in the forms exporters write, brought to one form.

A time that cannot be read becomes ``ingest_ts``, which the caller passes in: results never depend on
the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_Z = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
SECONDS_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def event_time(raw: Column) -> Column:
    """Timestamp of a text, or NULL: naive text is UTC, a number is epoch seconds."""
    text = F.trim(raw)
    epoch = F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("bigint"))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), epoch).otherwise(F.try_to_timestamp(text))


def normal_time(raw: Column, ingest_ts: str) -> Column:
    """Text with microseconds and ``Z``. Text already ending in ``Z`` with a fraction is kept as it is."""
    text = F.trim(raw)
    zulu = F.when(F.contains(text, F.lit(".")), text).otherwise(F.replace(text, F.lit("Z"), F.lit(".000000Z")))
    return F.coalesce(
        F.when(text.endswith("Z"), zulu).otherwise(F.date_format(event_time(text), MICROS_Z)), F.lit(ingest_ts)
    )


def normal_time_seconds(raw: Column, ingest_ts: str) -> Column:
    """Whole-second text with ``Z``; text without a zone counts as unreadable."""
    text = F.trim(raw)
    zoned = text.endswith("Z") | F.contains(F.substring(text, 11, 1000), F.lit("+"))
    return F.coalesce(F.when(zoned, F.date_format(F.try_to_timestamp(text), SECONDS_Z)), F.lit(ingest_ts))
