"""German dates, days left, risk and reminder days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WS

#: Month names, risk levels in rising order, days before a deadline on which a reminder is due.
MONTHS = {"januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}
RISKS = ("low", "medium", "high", "critical")
REMINDER_DAYS = (14, 7, 3, 1)
RETENTION_DAYS = 30


def full_year(year: Column) -> Column:
    """Two-digit years from 70 on are of the last century; three digits and more stay."""
    return F.when(year >= 100, year).when(year >= 70, year + 1900).otherwise(year + 2000)


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none; years below 100 are none."""
    return F.when((y >= 100) & (y <= 9999), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def german_date(text: Column) -> Column:
    """yyyy-MM-dd, d.M.y or d. Month yyyy, trimmed; null for anything else."""
    t = F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
    part = lambda pattern, g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).cast("int")
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    dotted = rf"^([0-9]{{1,2}})\.{WS}?([0-9]{{1,2}})\.{WS}?([0-9]{{2,4}})$"
    long = rf"^([0-9]{{1,2}})\.{WS}?(\p{{L}}+){WS}+([0-9]{{4}})$"
    month = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])
    return (
        F.when(t.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(dotted), _date(full_year(part(dotted, 3)), part(dotted, 2), part(dotted, 1)))
        .when(t.rlike(long), _date(part(long, 3), month[F.lower(F.regexp_extract(t, long, 2))], part(long, 1)))
    )


def utc_date(at: Column) -> Column:
    """The date of a moment in UTC, whatever the session's zone."""
    return F.to_date(F.to_utc_timestamp(at, F.current_timezone()))


def days_until(deadline: Column, now: Column) -> Column:
    """Whole days from now's UTC date to the deadline, negative once it has passed."""
    return F.datediff(deadline, utc_date(now))


def risk_rank(risk: Column) -> Column:
    """Place of a risk level, -1 if unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk), F.lit(0)).cast("int") - 1


def higher_risk(a: Column, b: Column) -> Column:
    return F.when(risk_rank(a) >= risk_rank(b), a).otherwise(b)


def risk_by_days(days: Column) -> Column:
    return F.when(days <= 3, "critical").when(days <= 7, "high").when(days <= 14, "medium").otherwise("low")


def escalated(risk: Column, deadline: Column, now: Column) -> Column:
    """The risk, raised as the deadline comes near, never lowered; without deadline as it is."""
    return F.when(deadline.isNull(), risk).otherwise(higher_risk(risk, risk_by_days(days_until(deadline, now))))


def reminder_dates(deadline: Column, now: Column) -> Column:
    """Midnights REMINDER_DAYS before the deadline that lie after now, rising."""
    midnight = deadline.cast("timestamp")
    days = F.array(*[F.lit(d) for d in REMINDER_DAYS])
    return F.filter(F.transform(days, lambda d: midnight - F.make_interval(days=d)), lambda t: t > now)


def delete_after(now: Column, days: int = RETENTION_DAYS) -> Column:
    return now + F.make_interval(days=F.lit(days))


def deadline_text(deadline: Column) -> Column:
    """Reminders write dates padded."""
    return F.date_format(deadline, "dd.MM.yyyy")


def deadline_view(deadline: Column) -> Column:
    """The analysis view writes them unpadded."""
    return F.date_format(deadline, "d.M.yyyy")
