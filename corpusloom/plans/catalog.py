"""Registry of the retrieval and analytics queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None, longs=()):
    """Add a query ``f(spark, sf_dir)`` under ``name`` with its optional SQL; ``longs``
    are columns that SQL counts in 64 bits."""

    def keep(f):
        def query(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in longs})

        QUERIES[name] = query if longs else f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
