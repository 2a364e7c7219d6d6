"""Calendar columns: tournament weeks close on a Sunday."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_end(day) -> Column:
    """The Sunday closing the week of a day."""
    return F.date_add(day, F.lit(6) - F.weekday(day))


def last_complete_sunday(day) -> Column:
    """The last Sunday on or before a day."""
    return F.date_sub(day, (F.weekday(day) + 1) % 7)


def is_weekend(day) -> Column:
    return F.weekday(day) >= 5


def first_weekend_after(day) -> Column:
    return F.least(F.next_day(day, "SAT"), F.next_day(day, "SUN"))


def strict_date(text) -> Column:
    """An ISO day and nothing else; any other spelling is NULL."""
    iso = F.col(text) if isinstance(text, str) else text
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))


def sundays_reached(day, back: int, ahead: int, first: Column, last: Column) -> Column:
    """The Sundays in [day - back, day + ahead], kept inside [first, last].

    The array is bounded by the two spans, so exploding it multiplies rows by a
    constant the configuration sets and never by the data.
    """
    day = F.col(day) if isinstance(day, str) else day
    start = week_end(F.greatest(F.date_sub(day, back), first))
    stop = F.least(F.date_add(day, ahead), last)
    step = F.expr("interval 7 days")
    none = F.array().cast("array<date>")
    return F.when(start <= stop, F.sequence(start, stop, step)).otherwise(none)
