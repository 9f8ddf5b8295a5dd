"""Cron expressions as sets of bits: when a schedule fires, and at which firing a row is taken up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an expression in order: name, first and last value.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
#: Days within which any date comes again, 29 February between centuries without a leap year included.
HORIZON = 366 * 8 + 1


@dataclass(frozen=True)
class Cron:
    """minute, hour, day, month and weekday (0 is Sunday) as bits; starred tells of day and weekday whether they were left open.

    Where both are given a day that fits either counts.
    """

    minute: int
    hour: int
    day: int
    month: int
    weekday: int
    starred: tuple[bool, bool]

    @classmethod
    def read(cls, text: str) -> Cron:
        """Of five fields, each `*`, numbers, ranges `a-b`, steps `/n` and lists of these."""
        parts = text.split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"a schedule has five fields: {text!r}")
        bits = [_bits(part, low, high) for part, (_, low, high) in zip(parts, FIELDS, strict=True)]
        bits[4] = (bits[4] | bits[4] >> 7) & 0x7F  # 7 is Sunday too
        return cls(*bits, (parts[2].startswith("*"), parts[4].startswith("*")))

    def times(self) -> list[int]:
        """Minutes of the day at which it fires."""
        return [60 * h + m for h in range(24) if self.hour >> h & 1 for m in range(60) if self.minute >> m & 1]

    def on(self, day: Column) -> Column:
        """Whether it fires on a date."""
        has = lambda bits, n: F.call_function("shiftright", F.lit(bits).cast("long"), n.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        by_day, by_weekday = has(self.day, F.dayofmonth(day)), has(self.weekday, F.dayofweek(day) - 1)
        days = by_day & by_weekday if any(self.starred) else by_day | by_weekday
        return has(self.month, F.month(day)) & days


def _bits(field: str, low: int, high: int) -> int:
    out = 0
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, dash, last = span.partition("-")
        if span == "*":
            a, b = low, high
        elif dash:
            a, b = int(first), int(last)
        else:
            a = int(first)
            b = high if step else a
        every = int(step) if step else 1
        if not (low <= a <= b <= high and every > 0):
            raise ValueError(f"{field!r} is not within {low} to {high}")
        out |= sum(1 << k for k in range(a, b + 1, every))
    return out


def fire_times(spark: SparkSession, cron: str, start: str, end: str) -> DataFrame:
    """at: when the schedule fires, from start to before end, both times without a zone."""
    schedule = Cron.read(cron)
    day = F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int"))
    n = spark.range(1).select(F.date_diff(F.to_date(F.lit(end)), F.to_date(F.lit(start))).alias("n")).first().n + 1
    minutes = F.explode(F.array(*[F.lit(m) for m in schedule.times()]))
    at = lambda: _at(F.col("day"), F.col("minute"))
    days = spark.range(n).select(day.alias("day")).where(schedule.on(F.col("day")))
    rows = days.select("day", minutes.alias("minute")).select(at().alias("at"))
    return rows.where((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")))


def _at(day: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)


def next_fire(time: Column, cron: str) -> Column:
    """The first firing at or after a time without a zone, worked out for each row by itself; null for null, and for a schedule of dates that do not exist.

    The times of a day are few, and of the days to come only those are looked at that lie before the first that fits.
    """
    schedule = Cron.read(cron)
    times = F.array(*[F.lit(m) for m in schedule.times()])
    day = F.to_date(time)
    minute = F.ceil((F.unix_micros(time.cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(day.cast("timestamp_ntz").cast("timestamp"))) / F.lit(60_000_000)).cast("int")
    later = F.get(F.filter(times, lambda m: m >= minute), F.lit(0))
    # days are looked through a week, a year and the whole horizon at a time
    reach = lambda a, b: F.get(F.filter(F.sequence(F.date_add(day, a), F.date_add(day, b)), schedule.on), F.lit(0))
    following = F.coalesce(reach(1, 7), reach(8, 366), reach(367, HORIZON))
    return F.when(schedule.on(day) & later.isNotNull(), _at(day, later)).otherwise(_at(following, F.get(times, F.lit(0))))
