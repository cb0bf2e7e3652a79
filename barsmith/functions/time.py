"""Times are bigint milliseconds since 1970 in UTC. None of these expressions depends on the session's time zone."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/Chicago"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def to_ntz(ms: Column) -> Column:
    """Milliseconds to a UTC wall-clock timestamp without zone."""
    return F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH))


def from_ntz(ts: Column) -> Column:
    """The milliseconds of a UTC wall-clock timestamp without zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), ts)
    return days * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(seconds * 1000).cast("bigint")


def local(ms: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """Wall-clock time in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), to_ntz(ms))


def local_day_start(ms: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """The UTC milliseconds of local midnight on the local day of ``ms``."""
    midnight = F.to_date(local(ms, zone)).cast("timestamp_ntz")
    return from_ntz(F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight))


def unit_to_ms(raw: Column) -> Column:
    """Seconds or milliseconds, told apart by size, to milliseconds (half to even)."""
    return F.rint(F.when(F.abs(raw) < 1e11, raw * 1000).otherwise(raw)).cast("bigint")


def iso(ms: Column) -> Column:
    """ISO-8601 with a final Z."""
    return F.concat(F.date_format(to_ntz(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def parse_time(text: Column) -> Column:
    """Milliseconds of a number in a text, or of ISO-8601 (Z, an offset, or none: UTC); null if it is neither."""
    clean = F.trim(text)
    number = clean.try_cast("double")
    stamped = F.when(clean.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), clean).otherwise(F.concat(clean, F.lit("Z")))
    return F.coalesce(unit_to_ms(number), F.unix_millis(F.try_to_timestamp(stamped)))


def parse_time_param(value) -> int:
    """The same for one value on the driver; raises ValueError if it cannot be read."""
    if isinstance(value, datetime):
        return round((value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp() * 1000)
    if isinstance(value, str):
        value = value.strip()
        if not value:
            raise ValueError("an empty time")
        try:
            value = float(value)
        except ValueError:
            return parse_time_param(datetime.fromisoformat(value))
    return round(value * 1000 if abs(value) < 1e11 else value)


def in_session(ms: Column) -> Column:
    """Sunday 17:00 to Friday 16:00 Chicago time, halted 16:00 to 17:00 each day, shut on Saturday."""
    at = local(ms)
    day, hour = F.weekday(at), F.hour(at)  # Monday is 0
    return F.when(day == 5, False).when(day == 6, hour >= 17).when(day == 4, hour < 16).otherwise(hour != 16)


def session_day(ms: Column) -> Column:
    """The date of the session: a session starts at 17:00 on the eve."""
    return F.to_date(local(ms) - F.expr("INTERVAL 17 HOURS"))
