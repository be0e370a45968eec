"""Rounding and percentage scores on doubles; halves round towards plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def one_place(x: Column) -> Column:
    return half_up(x * 10) / 10


def share3(n: Column, total: Column) -> Column:
    """n / total to three places."""
    return half_up(n / total * 1000) / 1000


def percent(n: Column, total: Column) -> Column:
    """100 n / total to one place, 0 for an empty total."""
    return F.when(total > 0, one_place(100.0 * n / total)).otherwise(F.lit(0.0))


def pct_score(bad: Column, total: Column) -> Column:
    """100 where nothing is bad or counted, 0 where all is; may be negative where more than all is."""
    return F.when(total <= 0, F.lit(100.0)).otherwise(one_place(100 * (1 - bad / total)))
