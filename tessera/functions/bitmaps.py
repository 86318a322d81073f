"""Activity bitmaps of 32 days: bit 31 is the day itself, bit 31 - n the day n days before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TODAY = 1 << 31


def shifted(bitmap: Column, active: Column) -> Column:
    """The bitmap one day later; null is no activity yet."""
    return F.shiftright(F.coalesce(bitmap, F.lit(0)).cast("long"), 1).bitwiseOR(F.when(active, F.lit(TODAY)).otherwise(F.lit(0)).cast("long"))


def active_days_ago(bitmap: Column, days: int) -> Column:
    return bitmap.bitwiseAND(F.lit(1 << (31 - days)).cast("long")) > 0


def day_of_month_bit(day: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - day)


def as_bits(bitmap: Column) -> Column:
    return F.lpad(F.bin(bitmap), 32, "0")


def from_days(days: Column, today: Column) -> Column:
    """The bitmap of ``today`` from an array of active dates, in closed form: no day-by-day loop."""
    ago = F.filter(F.transform(days, lambda d: F.datediff(today, d)), lambda n: (n >= 0) & (n <= 31))
    return F.aggregate(F.array_distinct(ago), F.lit(0).cast("long"), lambda s, n: s + F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(31) - n))
