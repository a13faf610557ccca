"""Dates and times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsreach import constants as K

# Fixed pattern: a time zone at the end of an RFC 3339 text.
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def wall_literal(value: datetime, dtype: T.DataType) -> Column:
    """Literal of the column's own type, so that a comparison with it reaches the file scan."""
    return F.lit(value.isoformat(sep=" ")).cast(dtype)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_all_day(text: Column | str) -> Column:
    """True for a plain date, which is how whole-day events arrive."""
    return F.length(_col(text)) == K.DATE_LENGTH


def parse_moment(text: Column | str, offset: str = K.LOCAL_OFFSET) -> Column:
    """Instant of an RFC 3339 text or date; a text without a zone is local time."""
    text = _col(text)
    zoned = F.when(is_all_day(text), F.concat(text, F.lit(f"T00:00:00{offset}"))).when(
        text.rlike(ZONE), text
    ).otherwise(F.concat(text, F.lit(offset)))
    return zoned.try_cast("timestamp")


def wall_time(moment: Column | str, zone: str) -> Column:
    """Wall-clock time of an instant in ``zone``, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), _col(moment).cast("timestamp_ntz"))


def render_moment(moment: Column | str, all_day: Column | str, zone: str = K.LOCAL_ZONE) -> Column:
    """Date in the local zone for whole-day events, else the ISO instant in UTC."""
    local_date = F.date_format(wall_time(moment, zone), "yyyy-MM-dd")
    utc = wall_time(moment, "UTC")
    seconds = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.when(_col(all_day), local_date).otherwise(F.concat(seconds, fraction, F.lit("+00:00")))


def month_of(moment: Column | str) -> Column:
    """First day of the month as a date."""
    return F.trunc(_col(moment).cast("date"), "month")


def quarter_of(moment: Column | str) -> Column:
    """First day of the quarter as a date."""
    return F.trunc(_col(moment).cast("date"), "quarter")


def date_of(moment: Column | str) -> Column:
    """Calendar date."""
    return _col(moment).cast("date")


def iso_date(moment: Column | str) -> Column:
    """``YYYY-MM-DD`` text."""
    return F.date_format(_col(moment), "yyyy-MM-dd")
