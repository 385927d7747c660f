"""Joins on keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of all rows above which a key is dealt to several tasks; so there are fewer such keys than this.
SHARES = 1024


def heavy_keys(counted: DataFrame, keys: list[str], count: str, shares: int = SHARES) -> DataFrame:
    """The keys of ``counted``, a written table of one row a key, that hold more than
    a ``shares``-th of all that ``count`` adds up to, and ``__parts``, in how many such
    shares they go: under ``shares`` rows whatever the input, so they may be broadcast."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    part = max(1, -(-total // shares))
    return counted.filter(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("__parts"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame, tie: Column) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key), as an inner join on keys.

    Rows of a heavy key are dealt by the hash ``tie`` over its parts, and its row of the
    table is copied to each of them: fewer than two copies a share."""
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.pmod(tie, parts).cast("int")).drop("__parts")
    copies = table.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")
