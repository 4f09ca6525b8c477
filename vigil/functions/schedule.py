"""Weekly schedules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def is_active(ts: Column, days: Column, start_s: Column, end_s: Column) -> Column:
    """Whether a schedule (days: Monday = 0; seconds of the day, null: all day) holds at ts.

    A window past midnight belongs to the day on which it begins.
    """
    today, now = F.weekday(ts), second_of_day(ts)
    yesterday = (today + 6) % 7
    on = F.array_contains(days, today)
    always = start_s.isNull() | end_s.isNull()
    same_day = on & (now >= start_s) & (now < end_s)
    overnight = (on & (now >= start_s)) | (F.array_contains(days, yesterday) & (now < end_s))
    return F.when(always, on).when(start_s <= end_s, same_day).otherwise(overnight)
