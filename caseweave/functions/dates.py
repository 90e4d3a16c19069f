"""Day-month-year text, date repair and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Day, month and four-digit year with any separator or none; anything else is replaced as a whole.
_DMY = r"^\s*(\d{1,2})[^0-9A-Za-z]*(\d{1,2})[^0-9A-Za-z]*(\d{4})\s*$|^.*$"
# A month abbreviation or a two-digit year.
_SHORT = r"^\s*\d{1,2}[^0-9A-Za-z]+([A-Za-z]{3}[^0-9A-Za-z]+(\d{4}|\d{2})|\d{1,2}[^0-9A-Za-z]+\d{2})\s*$"


def parse_dmy(text: Column | str) -> Column:
    """Date from day-month-year text with any separator or none; NULL if it is no date.

    English month abbreviations and two-digit years (of this century) are accepted
    too. The common form becomes an ISO date by one replacement and a cast; the much
    slower pattern parser only sees text that looks like one of the short forms.
    """
    text = F.col(text) if isinstance(text, str) else text
    iso = F.regexp_replace(text, _DMY, "$3-$2-$1")
    plain = F.regexp_replace(F.trim(text), "[^0-9A-Za-z]+", "-")
    short = F.when(text.rlike(_SHORT), F.try_to_date(plain, "d-[MMM][M]-[yyyy][yy]"))
    return F.coalesce(iso.try_cast("date"), short)


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of the month; NULL unless the month is a whole number from 1 to 12."""
    year = F.col(year) if isinstance(year, str) else year
    month = F.col(month) if isinstance(month, str) else month
    valid = month.between(1, 12) & (month == F.floor(month)) & year.between(1, 9999)
    return F.when(valid, F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))


def repair_date(text: Column | str, year: Column | str, month: Column | str) -> Column:
    """Parsed date, else the first of the reported month, else NULL."""
    return F.coalesce(parse_dmy(text), month_start(year, month))


def month_label(month: Column | str) -> Column:
    """English month abbreviation, for display only."""
    month = F.col(month) if isinstance(month, str) else month
    return F.date_format(month_start(F.lit(2000), month), "MMM")


def month_axis(year: int = 2020) -> Column:
    """Array of (month, first day, position of that day on a 52-week axis)."""
    first = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    last = F.make_date(F.lit(year), F.lit(12), F.lit(1))
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.transform(
        months,
        lambda day: F.struct(
            F.month(day).alias("month"),
            day.alias("first_day"),
            (F.dayofyear(day) / 365 * 52 + 1).alias("week_position"),
        ),
    )
