"""Clock strings, service dates, lead bands: the time rules as column expressions.

Delays, leads and schedules are integer seconds. A service date is a DATE, an instant a
TIMESTAMP read in a UTC session, and local wall-clock time is an explicit conversion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ZONE = "Europe/Dublin"
HALF_DAY = 43_200
FULL_DAY = 86_400
ABSENT_CLOCKS = ("", "00:00", "00:00:00")
ABSENT_FULL_CLOCKS = ("", "00:00:00")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
LEAD_BANDS = (
    (0, 300, "0-5 min"),
    (300, 900, "5-15 min"),
    (900, 1800, "15-30 min"),
    (1800, 3600, "30-60 min"),
    (3600, 1_000_000_000, "60+ min"),
)
BAND_NAMES = tuple(name for _, _, name in LEAD_BANDS)
MAX_LEAD_SEC = 4 * 3600
MIN_VANTAGE_DELAY_SEC = -30 * 60
ROLLOVER_SEC = 3 * 3600
SETTLE_HOURS = 6
QUIET_FROM, QUIET_TO = "00:30:00", "05:30:00"
QUANTUM_SEC = 6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(" \t\r\n"))


def key(c: Column | str) -> Column:
    """A code as a join key: trimmed, upper case."""
    return F.upper(trimmed(c))


def clock_seconds(c: Column | str, absent: tuple[str, ...] = ABSENT_CLOCKS) -> Column:
    """`HH:MM[:SS]` as seconds since midnight; placeholders and junk are null."""
    c = col(c)
    parts = F.split(trimmed(c), ":")
    hour = F.try_element_at(parts, F.lit(1)).try_cast("int")
    minute = F.try_element_at(parts, F.lit(2)).try_cast("int")
    second = F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(0)
    return F.when(~c.isin(*absent), hour * 3600 + minute * 60 + second)


def clock_text(seconds: Column | str) -> Column:
    """Seconds, possibly past midnight or negative, as `HH:MM:SS`."""
    s = F.pmod(col(seconds).cast("int"), F.lit(FULL_DAY))
    text = F.format_string(
        "%02d:%02d:%02d",
        F.floor(s / 3600).cast("int"),
        F.floor(s % 3600 / 60).cast("int"),
        (s % 60).cast("int"),
    )
    return F.when(s.isNotNull(), text)


def fold(d: Column | str) -> Column:
    """A clock difference brought into plus or minus half a day."""
    d = col(d)
    return F.when(d > HALF_DAY, d - FULL_DAY).when(d < -HALF_DAY, d + FULL_DAY).otherwise(d)


def delay(actual: Column | str, scheduled: Column | str) -> Column:
    """Actual minus scheduled, anchored to the stop's own schedule."""
    return fold(col(actual) - col(scheduled))


def forward_gap(start: Column | str, end: Column | str) -> Column:
    """`end - start` where only a run across midnight is corrected."""
    g = col(end) - col(start)
    return F.when(g < -HALF_DAY, g + FULL_DAY).otherwise(g)


def feed_date(c: Column | str) -> Column:
    """`25 Aug 2026` as a DATE; anything else is null."""
    parts = F.split(trimmed(c), r"\s+")
    month = F.array_position(
        F.array(*[F.lit(m.lower()) for m in MONTHS]),
        F.lower(F.substring(F.try_element_at(parts, F.lit(2)), 1, 3)),
    )
    iso = F.concat_ws(
        "-",
        F.try_element_at(parts, F.lit(3)),
        F.when(month > 0, month).cast("string"),
        F.try_element_at(parts, F.lit(1)),
    )
    return F.when((F.size(parts) == 3) & (month > 0), F.try_to_date(iso, "y-M-d"))


def feed_date_text(d: Column | str) -> Column:
    return F.date_format(col(d), "dd MMM yyyy")


def instant(stamp: Column | str) -> Column:
    """ISO text as an instant. Text without an offset is local railway time."""
    c = trimmed(stamp)
    ts = F.try_to_timestamp(c)
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, ts).otherwise(F.to_utc_timestamp(ts, ZONE))


def local_time(ts: Column | str) -> Column:
    """Wall clock of an instant, kept as a timestamp in the UTC session."""
    return F.from_utc_timestamp(col(ts), ZONE)


def local_stamp(stamp: Column | str) -> Column:
    """Wall clock of ISO text; text without an offset already is wall clock."""
    c = trimmed(stamp)
    ts = F.try_to_timestamp(c)
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), local_time(ts)).otherwise(ts)


def wall_seconds(wall: Column | str) -> Column:
    w = col(wall)
    return F.hour(w) * 3600 + F.minute(w) * 60 + F.second(w)


def service_seconds(wall: Column | str, service_date: Column | str) -> Column:
    """Wall clock as seconds from midnight of the service date; may pass 86,400."""
    w = col(wall)
    return wall_seconds(w) + FULL_DAY * F.datediff(w.cast("date"), col(service_date))


def in_quiet_hours(wall: Column | str) -> Column:
    t = F.date_format(col(wall), "HH:mm:ss")
    return (t >= QUIET_FROM) & (t < QUIET_TO)


def is_settled(service_date: Column | str, now: Column | str) -> Column:
    """The date is over and six more hours have passed, both in wall-clock time."""
    end = F.to_utc_timestamp(F.date_add(col(service_date), 1).cast("timestamp"), ZONE)
    return col(now) >= end + F.expr(f"INTERVAL {SETTLE_HOURS} HOURS")


def band(seconds: Column | str) -> Column:
    """The half-open lead band a value falls in; null when negative or absent."""
    s = col(seconds)
    out = F.when(s < 0, F.lit(None).cast("string"))
    for lo, hi, name in LEAD_BANDS:
        out = out.when((s >= lo) & (s < hi), F.lit(name))
    return out


def lead_or_rebuilt(lead: Column | str, scheduled: Column | str, made: Column | str) -> Column:
    """The logged lead, or schedule minus statement corrected across midnight."""
    gap = col(scheduled) - col(made)
    return F.coalesce(col(lead), F.when(gap < -HALF_DAY, gap + FULL_DAY).otherwise(gap))


def departed(origin: Column | str, polled: Column | str) -> Column:
    """Whether a board entry had left its origin when the board was read."""
    o, p = col(origin), col(polled)
    return (
        F.when(o.isNull() | p.isNull(), "unknown")
        .when(F.pmod(p - o, F.lit(FULL_DAY)) < HALF_DAY, "departed")
        .otherwise("not_yet_departed")
    )


def board_time(kind: Column | str, arrival: Column | str, departure: Column | str) -> Column:
    """The time that applies at this stop, chosen by its type; a real 00:00 is kept."""
    a, d = F.nullif(trimmed(arrival), F.lit("")), F.nullif(trimmed(departure), F.lit(""))
    return F.coalesce(
        F.when(col(kind) == "O", F.coalesce(d, a)).otherwise(F.coalesce(a, d)), F.lit("")
    )


def weekday_name(d: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS]), F.weekday(col(d)) + 1)


def clock_hour(seconds: Column | str) -> Column:
    return F.floor(F.pmod(col(seconds), F.lit(FULL_DAY)) / 3600).cast("int")


def clock_minute(seconds: Column | str) -> Column:
    return F.floor(F.pmod(col(seconds), F.lit(FULL_DAY)) / 60).cast("int")


def split_of(d: Column | str, ranges: dict[str, tuple[str, str]], excluded: tuple[str, ...] = ()) -> Column:
    """Name of the date range a date falls in; excluded dates belong to none."""
    d = col(d)
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(ranges.items())):
        out = F.when(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), name).otherwise(out)
    if excluded:
        out = F.when(~d.isin(*[F.lit(x).cast("date") for x in excluded]), out)
    return out
