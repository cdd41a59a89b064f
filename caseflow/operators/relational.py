"""Projections, filters, joins, distinct, sort and top-k (survey §2.2, 2.3, 2.6).

Thin, declarative wrappers: each returns a DataFrame Catalyst can push down and
prune.  Filters on plain columns reach the Parquet scan as ``PushedFilters``;
date-window filters are written as half-open date ranges for the same reason.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.operators.windows import sort_exprs


# --- projections -------------------------------------------------------------

def project(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.select(*cols)


MODEL_COLUMNS = ("no_days", "party", "ac_count", "state", "status")


def select_by_name(df: DataFrame, cols: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Keep the named columns (the five modelling columns by default)."""
    return df.select(*cols)


def reorder_cols(df: DataFrame, order: Sequence[int]) -> DataFrame:
    """Positional reorder ``df[, c(2, 1, 3)]`` (1-based positions)."""
    return df.select(*[df.columns[i - 1] for i in order])


def drop_col(df: DataFrame, col: str | int) -> DataFrame:
    """Drop by name or by 1-based position (``df[, -3]``)."""
    return df.drop(df.columns[col - 1] if isinstance(col, int) else col)


def rename_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


# --- filters -----------------------------------------------------------------

def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_contains_ci(df: DataFrame, col: str, needle: str) -> DataFrame:
    """``upper(col) LIKE '%NEEDLE%'`` (not pushed to Parquet: it is a function of the column)."""
    return df.where(F.upper(F.col(col)).like(f"%{needle.upper()}%"))


def filter_like_empty(df: DataFrame, col: str) -> DataFrame:
    """``col LIKE ''``: only empty strings; NULL never matches."""
    return df.where(F.col(col).like(""))


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def filter_conj(df: DataFrame, **equalities) -> DataFrame:
    """AND of ``col = value`` literals (typed literals, never string splicing)."""
    cond = F.lit(True)
    for c, v in equalities.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def month_window(year: int, month_lo: int, month_hi: int) -> tuple[_dt.date, _dt.date] | None:
    """The half-open date range of months ``lo..hi`` of ``year`` (month 0 reads as 1);
    None when the window is empty."""
    lo = max(int(month_lo), 1)
    hi = min(int(month_hi), 12)
    if hi < lo:
        return None
    start = _dt.date(int(year), lo, 1)
    end = _dt.date(int(year) + 1, 1, 1) if hi == 12 else _dt.date(int(year), hi + 1, 1)
    return start, end


def filter_year_months(df: DataFrame, col: str, year: int, month_lo: int, month_hi: int) -> DataFrame:
    """Same rows as ``to_char(d,'YYYY') = year AND to_char(d,'MM') BETWEEN lpad(lo) AND lpad(hi)``,
    written as a date range so Parquet row-group statistics can skip data."""
    win = month_window(year, month_lo, month_hi)
    if win is None:
        return df.where(F.lit(False))
    start, end = win
    return df.where((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end)))


def filter_type_eq(df: DataFrame, value: str, col: str = "type") -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def distinct_col(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.select(*cols).distinct()


def unique_sorted(df: DataFrame, col: str) -> DataFrame:
    """``sort(unique(x))``: distinct non-NULL values in ascending order."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(F.col(col).asc())


def is_empty(df: DataFrame) -> bool:
    """Zero-row guard for callers (reads at most one row)."""
    return df.isEmpty()


# --- joins -------------------------------------------------------------------

def join_inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "inner")


def join_star(bills: DataFrame, sponsors: DataFrame, members: DataFrame) -> DataFrame:
    """bills ⋈ sponsors ⋈ members: one row per (bill, sponsor) with party and state."""
    b = bills.withColumnRenamed("id", "bill_id")
    m = members.withColumnRenamed("bioguideid", "sponsor_id")
    return b.join(sponsors.select("bill_id", "sponsor_id"), "bill_id").join(m, "sponsor_id")


def join_agg_subquery(bills: DataFrame, actions: DataFrame) -> DataFrame:
    """bills joined to their action count (``JOIN (SELECT count(*) ... GROUP BY bill_id)``)."""
    cnt = actions.groupBy("bill_id").agg(F.count(F.lit(1)).alias("ac_count"))
    return bills.withColumnRenamed("id", "bill_id").join(cnt, "bill_id")


def anti_not_exists(df: DataFrame, cond_a: Column, cond_b: Column, key: str = "bill_id") -> DataFrame:
    """Rows matching ``cond_a`` whose key has no row matching ``cond_b``."""
    return df.where(cond_a).join(df.where(cond_b).select(key), key, "left_anti")


def semi_in(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``col IN (subquery)`` as a left semi join (AQE broadcasts ``keys`` if its measured size allows)."""
    return df.join(keys.select(col), col, "left_semi")


def corr_scalar_max(df: DataFrame, group: str, col: str) -> DataFrame:
    """Rows whose ``col`` equals the max of ``col`` among rows with the same ``group``
    (the correlated scalar subquery, decorrelated to aggregate + equi-join;
    a NULL group never matches)."""
    m = df.groupBy(group).agg(F.max(col).alias(col)).where(F.col(group).isNotNull())
    return df.join(m, [group, col])


# --- sort and top-k ----------------------------------------------------------

def sort_by(df: DataFrame, cols: Sequence[str], desc: Sequence[bool] | None = None) -> DataFrame:
    """ORDER BY with NULLs last in both directions (range-partitioned parallel sort)."""
    desc = list(desc or [False] * len(cols))
    return df.orderBy(*[sort_exprs([c], d)[0] for c, d in zip(cols, desc)])


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """``ORDER BY by DESC, tiebreak LIMIT k`` (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(F.col(by).desc_nulls_last(), *sort_exprs(list(tiebreak))).limit(k)


def head_n(df: DataFrame, n: int = 6, order: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows in a defined order."""
    return (df.orderBy(*sort_exprs(list(order))) if order else df).limit(n)
