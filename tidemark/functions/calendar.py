"""Solar Hijri (Jalali) dates by whole-number arithmetic, from 1799 to 2254.

In these years 8 of 33 years are leap years, evenly spread: before year y there were
floor((8 y + 21) / 33) of them. So year y begins floor((12053 y + 21) / 33) days after a
fixed day, and the year of a day follows by division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the fixed day to 1970-01-01.
EPOCH = 492_633
# ---- fixed values
MONTHS = "فروردین اردیبهشت خرداد تیر مرداد شهریور مهر آبان آذر دی بهمن اسفند".split()
DIGITS = "۰۱۲۳۴۵۶۷۸۹"
MOMENTS, MINUTES, HOURS, DAYS = "لحظاتی پیش", " دقیقه پیش", " ساعت پیش", " روز پیش"
# ---- end of fixed values


def jalali_parts(date: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of month."""
    days = F.unix_date(date.cast("date")) + EPOCH
    year = F.floor((33 * days + 11) / 12053)
    of_year = days - F.floor((12053 * year + 21) / 33)
    early = of_year < 186  # six months of 31 days, then months of 30
    month = F.when(early, 1 + F.floor(of_year / 31)).otherwise(7 + F.floor((of_year - 186) / 30))
    day = F.when(early, of_year % 31 + 1).otherwise((of_year - 186) % 30 + 1)
    return year, month, day


def jalali_date(date: Column) -> Column:
    """yyyy/mm/dd; an empty string for a null."""
    text = F.concat_ws("/", *(F.lpad(p.cast("string"), n, "0") for p, n in zip(jalali_parts(date), (4, 2, 2))))
    return F.when(date.isNull(), "").otherwise(text)


def jalali_date_persian(date: Column) -> Column:
    return F.translate(jalali_date(date), "0123456789", DIGITS)


def jalali_date_time(ts: Column) -> Column:
    return F.when(ts.isNull(), "").otherwise(F.concat(jalali_date(ts), F.date_format(ts, " HH:mm")))


def jalali_long(date: Column) -> Column:
    year, month, day = jalali_parts(date)
    names = F.array(*map(F.lit, MONTHS))
    text = F.concat_ws(" ", day.cast("string"), F.element_at(names, month.cast("int")), year.cast("string"))
    return F.when(date.isNull(), "").otherwise(text)


def age_label(ts: Column, as_of: Column) -> Column:
    """How long before as_of, in words up to 30 days, then the date."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    said = lambda unit, words: F.concat(F.floor(seconds / unit).cast("string"), F.lit(words))
    return (
        F.when(ts.isNull(), "")
        .when(seconds < 60, MOMENTS)
        .when(seconds < 3600, said(60, MINUTES))
        .when(seconds < 86400, said(3600, HOURS))
        .when(seconds < 30 * 86400, said(86400, DAYS))
        .otherwise(jalali_date(ts))
    )


def expires_at(created: Column, hours: int) -> Column:
    return created + F.make_dt_interval(hours=F.lit(hours))


def locked_until(ts: Column, minutes: int = 15) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(minutes))


def window_start(ts: Column, seconds: int = 60) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)
