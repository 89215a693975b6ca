"""Times written as text in one of several common forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.functions.text import strip

# Alternatives of one Spark pattern each: a single parse tries them in this order.
MONTH_FIRST = "[M/d/yyyy][M-d-yyyy][M.d.yyyy]"
DAY_FIRST = "[d/M/yyyy][d-M-yyyy][d.M.yyyy]"
UNAMBIGUOUS = "[yyyy/M/d][d-MMM-yyyy][d MMM yyyy][d MMMM yyyy][MMM d, yyyy][MMMM d, yyyy]"
CLOCK = "[ h:mm:ss a][ h:mm a][ H:mm:ss][ H:mm]"
#: What such a date looks like; other texts are not parsed, as a failed parse is costly.
SHAPE = r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[ -]\p{L}{3,9}[ -]\d{4}|\p{L}{3,9} \d{1,2}, \d{4})( |$)"

#: Two numbers before a year, of which either may be the day.
SHORT_DATE = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}"


def parsed_time(value: Column, day_first: bool = False) -> Column:
    """The time of a text: ISO forms, then the forms above with an optional time of day; null where none fits.

    Of two numbers before a year the first is the month, or the day with ``day_first``.
    """
    text = strip(value)
    pattern = (DAY_FIRST if day_first else MONTH_FIRST) + UNAMBIGUOUS + CLOCK
    return F.coalesce(F.try_to_timestamp(text), F.when(text.rlike(SHAPE), F.try_to_timestamp(text, F.lit(pattern))))


def short_date_number(value: Column, place: int) -> Column:
    """The first or second number of a date written as two numbers and a year."""
    return F.regexp_extract(value, SHORT_DATE, place).try_cast("int")


def day_first(first_number: Column, second_number: Column) -> Column:
    """Whether dates put the day first, by the largest numbers in both places: some first one is over 12 and no second one."""
    return (F.coalesce(first_number, F.lit(0)) > 12) & (F.coalesce(second_number, F.lit(0)) <= 12)


def writes_day_first(df: DataFrame, column: str) -> bool:
    """Whether a text column's dates put the day first. Runs one aggregate."""
    places = [F.max(short_date_number(F.col(f"`{column}`"), i)) for i in (1, 2)]
    return df.agg(day_first(*places)).first()[0]
