"""Ordered severities and confidences, as Python values and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")


def rank(value: str, order: tuple[str, ...] = SEVERITIES) -> int:
    """Position in the order; unknown values come last."""
    return order.index(value) if value in order else len(order)


def normal(value: str) -> str:
    value = (value or "").strip().lower()
    return value if value in SEVERITIES else "medium"


def rank_column(c: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def normal_column(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*SEVERITIES), low).otherwise("medium")


def at_least(c: Column, floor: str, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Whether the value is as severe (or confident) as ``floor``."""
    return rank_column(c, order) <= rank(floor, order)
