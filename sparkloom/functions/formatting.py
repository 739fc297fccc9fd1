"""Numbers, shares, sizes, durations and long texts as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, digits: int = 2) -> Column:
    """1,234.50"""
    return F.format_number(c, digits)


def percent(c: Column, digits: int = 2) -> Column:
    """A fraction as 12.34%."""
    return F.concat(F.format_string(f"%.{digits}f", (c * 100).cast("double")), F.lit("%"))


def byte_size(c: Column) -> Column:
    """Bytes with the largest unit below them, two decimals."""
    out = F.format_string("%.2f TB", (c / F.lit(1024.0**4)).cast("double"))
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        shown = F.format_string(f"%.2f {unit}", (c / F.lit(1024.0**power)).cast("double"))
        out = F.when(c < 1024.0 ** (power + 1), shown).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """Seconds as 1h 02m 03s."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """At most so many characters, the mark included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)
