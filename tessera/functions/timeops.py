"""Time functions on zone-free timestamps: everything is counted in microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a column, whatever the session's zone (zone-free timestamps read as UTC)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def seconds(ts: str) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def exploded(ts: Column) -> dict[str, Column]:
    """Calendar parts; day of week counts from 0, Sunday."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day_of_week": F.dayofweek(ts) - 1,
        "day_of_month": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
    }


def midnight(us: Column) -> Column:
    return us - F.pmod(us, F.lit(DAY))


def rounded_up_ms(us: Column) -> Column:
    """Whole milliseconds, rounded up."""
    return F.ceil(us / 1000).cast("long")


def throttle(us: Column, interval_us: int) -> Column:
    """The tick an instant belongs to: work done once per tick is done every ``interval_us``."""
    return F.floor(us / interval_us).cast("long")


def delta(days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0, ms: float = 0, us: int = 0) -> int:
    """A span of time in microseconds."""
    return DAY * days + HOUR * hours + 60_000_000 * minutes + int(1_000_000 * seconds) + int(1000 * ms) + us


def in_units(us: Column, unit_us: int) -> Column:
    """Whole units of a span, truncated toward zero."""
    return F.when(us >= 0, F.floor(us / unit_us)).otherwise(F.ceil(us / unit_us))


def span_parts(us: Column) -> dict[str, Column]:
    """Days, hours, minutes, seconds and milliseconds of a span, each the whole of it, truncated; and milliseconds rounded up."""
    sizes = {"days": DAY, "hours": HOUR, "minutes": 60_000_000, "seconds": 1_000_000, "ms": 1000}
    return {k: in_units(us, n).cast("long") for k, n in sizes.items()} | {"ms_up": rounded_up_ms(us)}


#: Forms in which times are read, tried in this order.
FORMS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss", "EEE MMM dd HH:mm:ss yyyy", "MM/dd/yyyy HH:mm:ss")


def parse_time(s: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """Microseconds since the epoch of a time in any of the forms, read as UTC (a trailing zone name of UTC may stand); null if it has none."""
    plain = F.regexp_replace(F.trim(s), r"(?: ?(?:UTC|GMT|Z))$", "")
    # names of days and months are read without the day's, which the date tells
    plain = F.regexp_replace(plain, "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    found = [F.try_to_timestamp(plain, F.lit(f.replace("EEE, ", "").replace("EEE ", ""))) for f in forms]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.coalesce(*[f.cast("timestamp_ntz") for f in found]))


def from_exploded(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Microseconds since the epoch of calendar parts in UTC; null if there is no such time."""
    ts = F.try_make_timestamp_ntz(year, month, day, hour, minute, second)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def timespec(us: Column) -> Column:
    """(sec, nsec) with nsec from 0, of a time before the epoch too."""
    sec = F.floor(us / 1_000_000).cast("long")
    return F.struct(sec.alias("sec"), ((us - sec * 1_000_000) * 1000).cast("long").alias("nsec"))


def from_timespec(spec: Column) -> Column:
    return spec["sec"] * 1_000_000 + F.floor(spec["nsec"] / 1000).cast("long")


def now_us() -> Column:
    """The query's one instant, in microseconds."""
    return F.unix_micros(F.current_timestamp())
