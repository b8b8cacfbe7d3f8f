"""Exchange time: naive Eastern feed stamps, settlement instants and tenors."""

from __future__ import annotations

from datetime import date, datetime, time
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"

# Settlement conventions and day count.
MORNING_ROOTS = ("SPX",)
MORNING = (9, 30)
AFTERNOON = (16, 0)
SECONDS_PER_YEAR = 365.0 * 24 * 3600

# A calendar date, then optionally any one separator and a time of day.
_NAIVE = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d)(?:[.,](\d{1,9}))?)?)?)?$"
)


def eastern_instant(text: Column) -> Column:
    """Instant of a naive Eastern ISO stamp; NULL if empty, aware or unreadable.

    A plain cast is both too lenient (a bare time of day becomes today) and too
    strict (no compact dates), hence the explicit layout.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(text, _NAIVE, i)

    def number(i: int) -> Column:
        return F.coalesce(part(i).try_cast("int"), F.lit(0))

    micros = F.rpad(F.substring(part(8), 1, 6), 6, "0").try_cast("int")
    seconds = number(7).cast("decimal(16,6)") + F.coalesce(micros, F.lit(0)) / F.lit(1000000).cast("decimal(16,6)")
    made = F.try_make_timestamp(
        number(1), number(3), number(4), number(5), number(6), seconds.cast("decimal(16,6)"), F.lit(ZONE)
    )
    return F.when(text.rlike(_NAIVE), made)


def looks_aware(text: Column) -> Column:
    """A stamp with an offset, although the feed never sends one."""
    return text.rlike(r"^\d{4}-?\d{2}-?\d{2}.\d{2}.*(Z|[+-]\d{2}(:?\d{2}){0,2})$")


def eastern_print(instant: Column) -> Column:
    """The naive Eastern second-resolution form in which prints are compared."""
    return F.date_format(F.from_utc_timestamp(instant, ZONE), "yyyy-MM-dd'T'HH:mm:ss")


def settlement_instant(expiry: Column, root: Column) -> Column:
    morning = root.isin(*MORNING_ROOTS)

    def pick(i: int) -> Column:
        return F.when(morning, MORNING[i]).otherwise(AFTERNOON[i])

    return F.make_timestamp(
        F.year(expiry), F.month(expiry), F.dayofmonth(expiry),
        pick(0), pick(1), F.lit(0).cast("decimal(16,6)"), F.lit(ZONE),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def tenor_years(expiry: Column, root: Column, as_of: Column) -> Column:
    """ACT/365 years to settlement; zero or negative once settled."""
    return seconds_between(as_of, settlement_instant(expiry, root)) / SECONDS_PER_YEAR


def log_moneyness(strike: Column, forward: Column) -> Column:
    """ln(K/F); NULL unless both are positive."""
    return F.when((strike > 0) & (forward > 0), F.ln(strike / forward))


def settlement(expiry: date, root: str) -> datetime:
    """The settlement instant of one contract, for driver-side callers."""
    hour, minute = MORNING if root in MORNING_ROOTS else AFTERNOON
    return datetime.combine(expiry, time(hour, minute), tzinfo=ZoneInfo(ZONE))
