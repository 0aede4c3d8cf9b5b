"""Calendar expressions over a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("daily", "weekly", "monthly")

# Weekday names in display order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def parse_granularity(value: str) -> str:
    level = str(value).strip().lower()
    if level not in GRANULARITIES:
        raise ValueError(
            f"Unsupported granularity {value!r}. Expected one of: {', '.join(GRANULARITIES)}."
        )
    return level


def period_end(day: Column, granularity: str) -> Column:
    """Label of the period a day falls in: its Sunday, or the last day of its month."""
    level = parse_granularity(granularity)
    if level == "weekly":
        return F.date_add(F.trunc(day, "week"), 6)
    if level == "monthly":
        return F.last_day(day)
    return day


def calendar_parts(day: str) -> dict[str, str]:
    """Nine integer calendar parts as SQL text; Monday is weekday 0."""
    return {
        "calendar_day_of_week": f"weekday({day})",
        "calendar_month": f"month({day})",
        "calendar_quarter": f"quarter({day})",
        "calendar_day_of_month": f"dayofmonth({day})",
        "calendar_day_of_year": f"dayofyear({day})",
        "calendar_week_of_year": f"weekofyear({day})",
        "calendar_is_weekend": f"CAST(weekday({day}) >= 5 AS TINYINT)",
        "calendar_is_month_start": f"CAST(dayofmonth({day}) = 1 AS TINYINT)",
        "calendar_is_month_end": f"CAST(last_day({day}) = {day} AS TINYINT)",
    }


def calendar_cycles(day: str) -> dict[str, str]:
    """Six sine and cosine encodings; month and day of year count from zero here."""
    angles = {
        "dow": f"2 * pi() * weekday({day}) / 7",
        "month": f"2 * pi() * (month({day}) - 1) / 12",
        "doy": f"2 * pi() * (dayofyear({day}) - 1) / 365.25D",
    }
    return {
        f"calendar_{name}_{wave}": f"{wave}({angle})"
        for name, angle in angles.items()
        for wave in ("sin", "cos")
    }
