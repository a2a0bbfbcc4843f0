"""Statistics as Column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share: the two x with n (share - x)**2 = z**2 x (1 - x), a quadratic in x; 0, 0 without rows."""
    share_, c = wins / F.nullif(n, F.lit(0)), z * z / F.nullif(n, F.lit(0))
    square, linear = 1 + c, 2 * share_ + c
    root = F.sqrt(linear * linear - 4 * square * share_ * share_)
    return tuple(F.coalesce((linear + sign * root) / (2 * square), F.lit(0.0)) for sign in (-1, 1))


def wilson_sql(wins: str, n: str, z: float = 1.96) -> tuple[str, str]:
    c, p = f"({z * z!r}::DOUBLE / {n})", f"({wins} / {n}::DOUBLE)"
    linear, square = f"(2 * {p} + {c})", f"(1 + {c})"
    return tuple(f"(({linear} {sign} sqrt({linear} * {linear} - 4 * {square} * {p} * {p})) / (2 * {square}))" for sign in "-+")


def share(c: Column) -> Column:
    """The share of rows where c is true; NULL without rows."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))
