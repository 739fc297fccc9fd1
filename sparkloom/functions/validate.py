"""Validators as expressions: each gives the list of what is wrong with a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Bounds of the power and student domains, and student categories.
POWER_RANGES = {"Voltage": (200.0, 250.0), "Global_intensity": (0.0, 50.0), "Global_active_power": (0.0, 10.0)}
STUDENT_RANGES = {
    "Hours_Studied": (0, 50), "Attendance": (0, 100), "Sleep_Hours": (0, 24), "Previous_Scores": (0, 100),
    "Tutoring_Sessions": (0, 10), "Physical_Activity": (0, 10),
}
_LEVELS = ("Low", "Medium", "High")
STUDENT_VALUES = {
    "Gender": ("Male", "Female"), "School_Type": ("Public", "Private"), "Teacher_Quality": _LEVELS,
    "Parental_Involvement": _LEVELS, "Access_to_Resources": _LEVELS, "Extracurricular_Activities": ("Yes", "No"),
    "Motivation_Level": _LEVELS, "Internet_Access": ("Yes", "No"), "Family_Income": _LEVELS,
    "Peer_Influence": ("Negative", "Neutral", "Positive"), "Learning_Disabilities": ("Yes", "No"),
    "Parental_Education_Level": ("High School", "College", "Postgraduate"), "Distance_from_Home": ("Near", "Moderate", "Far"),
}

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[0-9][0-9 ()-]{6,18}$"


def number_error(text: Column, name: str, low: float | None = None, high: float | None = None) -> Column:
    """Null when the text is a number in bounds, else what is wrong with it."""
    value = text.try_cast("double")
    out = F.when(text.isNull() | (strip(text) == ""), f"{name}: missing").when(value.isNull(), f"{name}: not a number")
    if low is not None:
        out = out.when(value < low, f"{name}: below {low:g}")
    if high is not None:
        out = out.when(value > high, f"{name}: above {high:g}")
    return out


def choice_error(text: Column, name: str, values: Sequence[str]) -> Column:
    return F.when(text.isNull() | ~text.isin(*values), f"{name}: not allowed")


def errors(*found: Column) -> Column:
    """The array of those that are not null."""
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def record_errors(ranges: Mapping[str, tuple[float, float]], values: Mapping[str, Sequence[str]]) -> Column:
    numbers = [number_error(F.col(c), c, lo, hi) for c, (lo, hi) in ranges.items()]
    return errors(*numbers, *[choice_error(F.col(c), c, v) for c, v in values.items()])


def date_parts_error(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Errors of calendar parts; the last day depends on the month and leap years."""
    last = F.dayofmonth(F.last_day(F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))))
    return errors(
        F.when(~F.coalesce(month.between(1, 12), F.lit(False)), "month"),
        F.when(~F.coalesce(day.between(1, last), F.lit(False)), "day"),
        F.when(~F.coalesce(hour.between(0, 23), F.lit(False)), "hour"),
    )


def is_email(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(EMAIL), F.lit(False))


def is_phone(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(PHONE), F.lit(False))
