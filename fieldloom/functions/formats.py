"""Numbers for people: scaled, grouped, ranked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display colours of ranks.
TOP, MIDDLE, BOTTOM = "#2E7D32", "#616161", "#C62828"


def number_text(value: Column, decimals: int, scale: float = 1.0, unit: str = "") -> Column:
    text = F.format_number(value.cast("double") / scale, decimals)
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    last, tens = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    end = F.when(tens.between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def rank_color(rank: Column, total: Column) -> Column:
    """The two best ranks first, then the two last."""
    return F.when(rank <= 2, TOP).when(rank >= total - 1, BOTTOM).otherwise(MIDDLE)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def elapsed(seconds: float) -> str:
    """``1h 02m 03s`` and shorter."""
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    if hours:
        return f"{hours}h {minutes:02d}m {rest:02d}s"
    return f"{minutes}m {rest:02d}s" if minutes else f"{seconds:.2f}s"
