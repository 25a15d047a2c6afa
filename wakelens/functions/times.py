"""Times as UTC and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(local: Column, zone: str | Column) -> Column:
    """The UTC wall clock of a wall-clock time in ``zone``."""
    return F.to_utc_timestamp(local, zone)


def iso_utc(moment: Column) -> Column:
    """``2024-05-06T07:08:09Z`` in UTC; six more digits only where there are microseconds.

    Whatever the session's zone is, the text is that of UTC.
    """
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    fraction = F.date_format(utc, ".SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != ".000000", fraction).otherwise(""), F.lit("Z"))
