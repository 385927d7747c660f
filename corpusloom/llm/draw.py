"""Bounded samples that come out the same on every run and in every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(wanted: int, of: int) -> float:
    """The share of rows that holds twice as many as are wanted, by expectation."""
    return min(1.0, 2.0 * wanted / max(of, 1))


def part(key: Column, share_of_all: float) -> Column:
    """Whether a hash ``key`` falls into this share of them."""
    return F.lit(True) if share_of_all >= 1 else F.pmod(key, F.lit(10**9)) < int(share_of_all * 10**9)


def least(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the least values of ``key``; rows of one value are
    drawn as one. What comes to the driver is the last value that is drawn."""
    keys = df.select(key).distinct().orderBy(key).limit(rows)
    last = keys.agg(F.max(key)).first()[0]
    return df.filter(F.col(key) <= F.lit(last)).dropDuplicates([key])
