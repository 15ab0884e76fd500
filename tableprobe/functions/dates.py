"""Does a text look like a date, and which one?

Spellings that are read: year first (``2024-01-31``, ``2024/1/31``, ``20240131``), day or month first
(``31.01.2024``, ``1/31/24``), and month names (``31 Jan 2024``, ``January 31, 2024``, ``Wed, 31 Jan 2024``); each with
an optional time, fraction of a second, AM or PM, and offset (``Z``, ``UTC``, ``+02:00``). Day and month are checked
against the calendar. ``01/02/2024`` is a date in either order; :func:`day_first` decides which one from all
values of the column.

Everything is made of built-in expressions. A text that does not start like a date is left after one look at
its first characters, which is what most texts cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref

# Names of months and week days, and the spelling of times.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?"
OFFSET = r"z|utc|gmt|[+-](?:0\d|1[0-4]):?[0-5]\d|[+-](?:0\d|1[0-4])"
END = rf"(?:(?:t|\s)\s*({CLOCK})\s*([ap]m)?\s*({OFFSET})?)?$"
YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + END
COMPACT = r"^((?:1[6-9]|2\d)\d{2})(0[1-9]|1[0-2])([0-3]\d)(?:t?([0-2]\d)([0-5]\d)([0-5]\d)?)?$"
NUMBERS = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + END
WEEKDAY = rf"^(?:(?:{'|'.join(DAYS)})[a-z]*\.?,?\s+)?"
DAY_NAME = WEEKDAY + rf"(\d{{1,2}})(?:st|nd|rd|th)?[-\s/.]+{MONTH}[-\s/.,]+(\d{{4}}|\d{{2}})" + END
NAME_DAY = WEEKDAY + rf"{MONTH}[-\s/.]+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]\s*(\d{{4}})" + END
CANDIDATE = rf"^(?:\d{{1,4}}[-/.\s]|\d{{8}}|(?:{'|'.join(MONTHS + DAYS)})|\d{{1,2}}(?:st|nd|rd|th))"
LONGEST = 64


def _clean(text: Column) -> Column:
    """The trimmed text in lower case, NULL unless it starts like a date."""
    v = F.lower(F.trim(text))
    return F.when(v.rlike(CANDIDATE) & (F.length(v) <= LONGEST), v)


def _month(v: Column, pattern: str, group: int) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(v, pattern, group)).cast("string")


def _written(v: Column, day_first: bool = False) -> Column:
    """Year, month and day as ``2024-1-31``, whether or not there is such a day."""
    numbers = "$4-$3-$1" if day_first else "$4-$1-$3"
    day_name = F.concat_ws("-", F.regexp_extract(v, DAY_NAME, 3), _month(v, DAY_NAME, 2), F.regexp_extract(v, DAY_NAME, 1))
    name_day = F.concat_ws("-", F.regexp_extract(v, NAME_DAY, 3), _month(v, NAME_DAY, 1), F.regexp_extract(v, NAME_DAY, 2))
    parts = (
        F.when(v.rlike(YEAR_FIRST), F.regexp_replace(v, YEAR_FIRST, "$1-$3-$4"))
        .when(v.rlike(NUMBERS), F.regexp_replace(v, NUMBERS, numbers))
        .when(v.rlike(COMPACT), F.regexp_replace(v, COMPACT, "$1-$2-$3"))
        .when(v.rlike(DAY_NAME), day_name)
        .when(v.rlike(NAME_DAY), name_day)
    )
    # Two digits of a year are 1970 to 2069.
    return F.regexp_replace(F.regexp_replace(parts, r"^([0-6]\d)-", "20$1-"), r"^([7-9]\d)-", "19$1-")


def _in_calendar(written: Column) -> Column:
    return written.try_cast("date").isNotNull()


def is_date(text: Column) -> Column:
    """Whether the text is a date of the calendar, in either order of day and month; False for NULL."""
    v = _clean(text)
    other = F.regexp_replace(F.regexp_replace(v, NUMBERS, "$4-$3-$1"), r"^(\d\d)-", "20$1-")
    return F.coalesce(_in_calendar(_written(v)) | (v.rlike(NUMBERS) & _in_calendar(other)), F.lit(False))


def date_share(text: Column) -> Column:
    """Aggregate: share of the non-null texts that read as a date; NULL without any."""
    return F.try_divide(F.count(F.when(is_date(text), 1)), F.count(text))


def day_first(df: DataFrame, column: str) -> bool:
    """Whether the day stands first in dates written in numbers, from all values of the column.

    More values must need that order than need the other one.
    """
    v = _clean(ref(column))
    one, two = (F.when(v.rlike(NUMBERS), F.regexp_extract(v, NUMBERS, k).try_cast("int")) for k in (1, 3))
    found = df.agg(F.count(F.when(one > 12, 1)).alias("day"), F.count(F.when(two > 12, 1)).alias("month")).first()
    return found["day"] > found["month"]


def parsed_date(text: Column, day_first: bool = False) -> Column:
    """The time a text names, else NULL; without an offset in the time zone of the session.

    Numbers that are no date in the wanted order of day and month are tried in the other one.
    """
    v = _clean(text)
    wanted, other = _written(v, day_first), _written(v, not day_first)
    date = F.coalesce(wanted.try_cast("date"), other.try_cast("date")).cast("string")
    compact = F.rpad(F.regexp_replace(v, COMPACT, "$4$5$6"), 6, "0")
    compact = F.regexp_replace(compact, r"^(\d\d)(\d\d)(\d\d)$", "$1:$2:$3")
    clock = F.when(v.rlike(COMPACT), compact).otherwise(F.replace(F.regexp_extract(v, END, 1), F.lit(","), F.lit(".")))
    clock = F.regexp_replace(F.when(clock == "", "00:00").otherwise(clock), r"^(\d{1,2}:\d\d)$", "$1:00")
    offset = F.regexp_replace(F.regexp_extract(v, END, 3), "utc|gmt|z", "+0000")
    offset = F.regexp_replace(F.regexp_replace(offset, r"^([+-]\d\d)$", "$1:00"), r"^([+-]\d\d)(\d\d)$", "$1:$2")
    moment = F.concat(date, F.lit(" "), clock, offset).try_cast("timestamp")
    half, hour = F.regexp_extract(v, END, 2), F.substring_index(clock, ":", 1).try_cast("int")
    hours = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
    return moment + F.make_dt_interval(hours=hours)
