"""Calendar buckets: period starts, labels and the choice of grain from a span."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Span in days above which a grain applies, widest first.
CHART_GRAINS = ((730, "year"), (180, "quarter"), (35, "month"), (None, "day"))
SERIES_GRAINS = ((7300, "year"), (1825, "quarter"), (270, "month"), (45, "week"), (None, "day"))
FORECAST_GRAINS = ((1825, "quarter"), (270, "month"), (45, "week"), (None, "day"))


def choose_grain(span_days: Column, ladder) -> Column:
    """Grain name for a span, from a ladder of (more than this many days, grain)."""
    *steps, (_, finest) = ladder
    choice = None
    for days, grain in steps:
        hit = span_days > days
        choice = F.when(hit, grain) if choice is None else choice.when(hit, grain)
    return choice.otherwise(finest)


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days, not calendar boundaries crossed."""
    return F.timestamp_diff("DAY", start, end)


def period_start(when: Column, grain: str | Column) -> Column:
    """First day of the period that holds ``when``. Weeks start on Monday."""
    day = F.to_date(when)
    if isinstance(grain, str):
        return day if grain == "day" else F.trunc(day, grain)
    return (
        F.when(grain == "year", F.trunc(day, "year"))
        .when(grain == "quarter", F.trunc(day, "quarter"))
        .when(grain == "month", F.trunc(day, "month"))
        .when(grain == "week", F.trunc(day, "week"))
        .otherwise(day)
    )


def period_after(start: Column, steps: Column, grain: Column) -> Column:
    """The period start ``steps`` periods later."""
    return (
        F.when(grain == "year", F.add_months(start, steps * 12))
        .when(grain == "quarter", F.add_months(start, steps * 3))
        .when(grain == "month", F.add_months(start, steps))
        .when(grain == "week", F.date_add(start, steps * 7))
        .otherwise(F.date_add(start, steps))
    )


def chart_label(when: Column, grain: str | Column) -> Column:
    """``YYYY``, ``YYYY-Qn``, ``YYYY-MM`` or ``YYYY-MM-DD``."""
    day = F.to_date(when)
    year = F.date_format(day, "yyyy")
    labels = {
        "year": year,
        "quarter": F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")),
        "month": F.date_format(day, "yyyy-MM"),
        "day": F.date_format(day, "yyyy-MM-dd"),
    }
    if isinstance(grain, str):
        return labels.get(grain, labels["day"])
    return (
        F.when(grain == "year", labels["year"])
        .when(grain == "quarter", labels["quarter"])
        .when(grain == "month", labels["month"])
        .otherwise(labels["day"])
    )
