"""Grouped aggregates (survey §2.4): counts, distinct counts, averages, joined
strings, per-group maxima and monthly counts.  All of them aggregate
partially before the shuffle, so a heavy group costs no more than a light one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str | Column, alias: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def count_distinct(df: DataFrame, col: str, alias: str = "n_distinct") -> DataFrame:
    """``count(DISTINCT col)``: NULL is not counted."""
    return df.agg(F.count_distinct(F.col(col)).alias(alias))


def count_of_distinct(df: DataFrame, cols: Sequence[str], alias: str = "cnt") -> DataFrame:
    """``count(*)`` over ``SELECT DISTINCT cols``: an all-NULL row counts once."""
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias(alias))


def avg_expr(df: DataFrame | GroupedData, **named_exprs: Column) -> DataFrame:
    """The mean of each named expression, over all rows or per group."""
    return df.agg(*[F.avg(e).alias(n) for n, e in named_exprs.items()])


def string_agg_by(df: DataFrame, key: str, col: str, sep: str = " ",
                  alias: str = "joined") -> DataFrame:
    """``string_agg(col, sep)`` per key, values in ascending order, NULLs skipped,
    NULL when every value is NULL (``listagg`` semantics)."""
    return df.groupBy(key).agg(
        F.expr(f"listagg(`{col}`, '{sep}') WITHIN GROUP (ORDER BY `{col}`)").alias(alias))


def max_by_group(df: DataFrame, key: str, col: str, alias: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.max(col).alias(alias or f"max_{col}"))


def month_counts(df: DataFrame, key: str, date: str, alias: str = "cnt") -> DataFrame:
    """Counts per (key, ``to_char(date, 'YYYY-MM')``)."""
    return df.groupBy(key, F.date_format(date, "yyyy-MM").alias("dt")).agg(
        F.count(F.lit(1)).alias(alias))
