"""ISO-8601 and epoch timestamps to UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import as_column

# Extended and basic calendar dates, ISO week dates, an optional time and an optional offset.
DATE_SHAPE = (
    r"(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2})"
    r"|([0-9]{4})-?W([0-9]{2})(?:-?([1-7]))?)"
)
TIME_SHAPE = (
    r"(?:[\s\S](?:([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9])(?:[.,][0-9]+)?)?)?"
    r"|([01][0-9]|2[0-3])([0-5][0-9])(?:([0-5][0-9])(?:[.,][0-9]+)?)?)"
    r"(?:([+-])([01][0-9]|2[0-3])(?::?([0-5][0-9])(?::?([0-5][0-9])(?:[.,][0-9]+)?)?)?)?)?"
)
ISO_SHAPE = rf"\A{DATE_SHAPE}{TIME_SHAPE}\z"
# The form nearly every source sends; Spark reads it directly.
USUAL_SHAPE = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    r"(?:\.[0-9]{1,6})?(?:[+-](?:0[0-9]|1[0-7]):[0-5][0-9])?\z"
)
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799  # years 1 to 9999


def iso_to_timestamp(text: Column | str) -> Column:
    """Second precision; no offset means UTC; null where the text is no ISO timestamp.

    Nothing here depends on the time zone of the session.
    """
    trimmed = F.regexp_replace(F.btrim(as_column(text), F.lit(" \t\r\n")), r"[Zz]\z", "+00:00")

    def seconds(stamp: Column) -> Column:
        zoned = F.when(F.rlike(stamp, F.lit(r"[+-][0-9:]{5}\z")), stamp).otherwise(
            F.concat(stamp, F.lit("+00:00"))
        )
        return F.when(
            F.rlike(stamp, F.lit(USUAL_SHAPE)), F.unix_timestamp(zoned.try_cast("timestamp"))
        ).when(F.rlike(stamp, F.lit(ISO_SHAPE)), _unusual_seconds(stamp))

    return F.timestamp_seconds(_once(trimmed, seconds))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Apply a function that mentions its argument often, computing the argument once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The groups of ISO_SHAPE, alternatives merged: date parts, week parts, clock, offset.
ISO_PARTS = "$1$4|$2$5|$3$6|$7|$8|$9|$10$13|$11$14|$12$15|$16|$17|$18|$19"


def _unusual_seconds(text: Column) -> Column:
    """Basic, week-date and shortened forms; only such rows come here, and are matched once."""
    parts = F.split(F.regexp_replace(text, ISO_SHAPE, ISO_PARTS), r"\|")

    def seconds(part: Column) -> Column:
        def number(index: int) -> Column:
            return F.coalesce(part[index].try_cast("int"), F.lit(0))

        calendar = F.concat_ws("-", part[0], part[1], part[2]).try_cast("date")
        # ISO week one holds 4 January and starts on a Monday.
        week_one = F.trunc(F.concat(part[3], F.lit("-01-04")).try_cast("date"), "week")
        week_days = (number(4) - 1) * 7 + F.coalesce(part[5].try_cast("int"), F.lit(1)) - 1
        week = F.when(number(4).between(1, 53), F.date_add(week_one, week_days))
        day = F.unix_date(F.when(part[3] == "", calendar).otherwise(week)).cast("bigint")
        clock = number(6) * 3600 + number(7) * 60 + number(8)
        offset = number(10) * 3600 + number(11) * 60 + number(12)
        return day * 86400 + F.when(part[9] == "-", clock + offset).otherwise(clock - offset)

    return _once(parts, seconds)


def epoch_to_timestamp(value: Column | str, milliseconds: bool = False) -> Column:
    seconds = F.floor(as_column(value) / (1000 if milliseconds else 1))
    inside = seconds.between(FIRST_SECOND, LAST_SECOND)
    return F.when(inside, F.timestamp_seconds(F.when(inside, seconds)))


def utc_text(moment: Column | str) -> Column:
    """Fixed-width UTC text; an empty string for a missing moment."""
    seconds = F.unix_timestamp(as_column(moment))
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))

    def two(number: Column) -> Column:
        return F.lpad(number.cast("int").cast("string"), 2, "0")

    hour, minute, second = two(rest / 3600), two(rest / 60 % 60), two(rest % 60)
    text = F.concat(day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, F.lit("Z"))
    return F.coalesce(text, F.lit(""))


def iso_to_utc_text(text: Column | str) -> Column:
    return utc_text(iso_to_timestamp(text))


def epoch_to_utc_text(value: Column | str, milliseconds: bool = False) -> Column:
    return utc_text(epoch_to_timestamp(value, milliseconds))
