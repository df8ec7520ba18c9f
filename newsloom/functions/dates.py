"""Date functions on columns, and one on a text for what is read in Python. All times are naive and in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import html

#: A day, a month or a month and a day, a year, and perhaps a time with a half of the day and an offset.
PATTERN = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?:\D{1,12}?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM|SA|CH)?)?(?:.{0,4}?GMT\s*([+-])(\d{1,2})(?::?(\d{2}))?)?"


def day_first_datetime(text: Column) -> Column:
    """dd/mm/yyyy, or mm/dd/yyyy where that is no date, with an optional time, half of the day (AM, PM, SA, CH) and offset from GMT."""
    part = lambda i: F.regexp_extract(text, PATTERN, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int")
    hour = number(4)
    late, early = part(7).isin("PM", "CH"), part(7).isin("AM", "SA")
    hour = F.when(late & (hour < 12), hour + 12).when(early & (hour == 12), F.lit(0)).otherwise(hour)

    def at(day: Column, month: Column) -> Column:
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", number(3), month, day, hour, number(5), number(6)), F.lit("yyyy-MM-dd HH:mm:ss"))

    minutes = (number(9) * 60 + number(10)) * F.when(part(8) == "-", 1).otherwise(-1)
    found = F.coalesce(at(number(1), number(2)), at(number(2), number(1)))
    return F.when(part(3) == "", F.lit(None)).otherwise(F.timestamp_seconds(F.unix_timestamp(found) + minutes * 60)).cast("timestamp_ntz")


def parse_datetime(text: Column) -> Column:
    """RFC 2822, ISO 8601 or a day-first date, in this order, as naive UTC; null where none fits."""
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    rfc = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(text)))
    return F.coalesce(rfc.cast("timestamp_ntz"), iso.cast("timestamp_ntz"), day_first_datetime(text))


_GAP = r"(?:\s|,|\||-|–|—|lúc|luc)+"
_TIME = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?\s*"
_DAY_FIRST, _MONTH_FIRST = r"(?P<day>\d{1,2})[/-](?P<month>\d{1,2})[/-](?P<year>\d{4})", r"(?P<month>\d{1,2})[/-](?P<day>\d{1,2})[/-](?P<year>\d{4})"
_HALF, _HALF_EN = "(?P<half>AM|PM|SA|CH)?", "(?P<half>AM|PM)?"
#: A date with its time after it or before it, day first and then month first; at last a day alone.
MOMENTS = tuple(map(re.compile, (_DAY_FIRST + _GAP + _TIME + _HALF, _TIME + _HALF + _GAP + _DAY_FIRST, _MONTH_FIRST + _GAP + _TIME + _HALF_EN, _TIME + _HALF_EN + _GAP + _MONTH_FIRST, _DAY_FIRST)))
_OFFSET = re.compile(r"GMT\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?", re.IGNORECASE)


def moment(text: str | None) -> datetime | None:
    """RFC 2822, ISO 8601 or a date as news pages show it, in this order, as naive UTC; None where none fits."""
    text = (text or "").strip()
    for read in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), _shown):
        try:
            found = read(text)
            if found is not None:
                return found if found.tzinfo is None else found.astimezone(timezone.utc).replace(tzinfo=None)
        except (TypeError, ValueError, IndexError, OverflowError):  # no such date, or beyond the calendar
            continue
    return None


def _shown(text: str) -> datetime | None:
    """The first of MOMENTS that is a date, by its offset from GMT."""
    text = html.tagless(text)
    offset = _OFFSET.search(text)
    zone = timezone((1 if offset[1] == "+" else -1) * timedelta(hours=int(offset[2]), minutes=int(offset[3] or 0))) if offset else None
    for pattern in MOMENTS:
        m = pattern.search(text)
        if m is None:
            continue
        at = m.groupdict()
        half = at.pop("half", None)
        at = {k: int(v or 0) for k, v in at.items()}
        if half in ("PM", "CH") and at["hour"] < 12:
            at["hour"] += 12
        elif half in ("AM", "SA") and at["hour"] == 12:
            at["hour"] = 0
        try:
            return datetime(**at, tzinfo=zone)
        except ValueError:
            continue
    return None


def recency(published: Column, as_of: Column, days: float) -> Column:
    """exp(-age / days), at most 1; 0 without a date."""
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 86400.0
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-age / days))), F.lit(0.0))


def recency_bonus(published: Column, as_of: Column) -> Column:
    """Up to 0.1 for the newest, falling by whole days to 0 at 30; 0 without a date."""
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 86400.0))
    return F.coalesce(F.greatest(F.lit(0.0), 0.1 * (1.0 - F.least(age, F.lit(30)) / 30.0)), F.lit(0.0))
