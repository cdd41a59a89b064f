"""Global orders without a single-partition window: range partitions and running sums.

``ranged`` cuts rows into consecutive ranges of bounded size in a given order and
writes them once with their range number, so every later use sees the same
bounds.  Running sums then need one row per range (a table of rows / range size
entries) and a window inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import shared_table

#: Rows that one task orders at a time.
ROWS_PER_RANGE = 1 << 20

#: Range bounds drawn from a sample: the driver gets about a hundred rows for each, so more and smaller
#: ranges are cut by position inside these.
SAMPLED_RANGES = 256


def ranged(df: DataFrame, order: Sequence[Column], rows_per_range: int = ROWS_PER_RANGE, stored: bool = False) -> DataFrame:
    """``df`` with ``_rid``: consecutive ranges of about ``rows_per_range`` rows in ``order``.

    The number of ranges follows the counted rows.  Rows that compare equal share
    a range unless it is cut by position, so ``order`` should end in something unique.  The
    result is read from a written table: the bounds are sampled once, not once per use.
    ``stored``: ``df`` is read from a written table already."""
    whole = df if stored else shared_table(df, "unranged")
    rows = whole.count()
    n = -(-rows // max(1, rows_per_range))
    if n <= 1:
        return whole.withColumn("_rid", F.lit(0))
    sampled = max(SAMPLED_RANGES, -(-rows // ROWS_PER_RANGE))
    if n > sampled:
        place = F.monotonically_increasing_id()  # the partition above bit 33, the position in it below
        cut = F.shiftright(place, 33) * F.lit(1 << 33) + F.floor(place % F.lit(1 << 33) / F.lit(rows_per_range)).cast("long")
        return shared_table(whole.repartitionByRange(sampled, *order).sortWithinPartitions(*order).withColumn("_rid", cut), "ranged")
    return shared_table(whole.repartitionByRange(n, *order).withColumn("_rid", F.spark_partition_id()), "ranged")


def nulls_last(cols: Sequence[str]) -> list[Column]:
    """Sort keys that put NULLs last and compare the same in a range partitioning."""
    return [e for c in cols for e in (F.col(c).isNull().asc(), F.col(c).asc())]


def running_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], rows_per_range: int = ROWS_PER_RANGE,
                 inclusive: bool = False, suffix: str = "_before", by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """For each row, the sum of each ``value_col`` over all rows earlier in
    ``order_col`` order (``inclusive`` adds the row itself), within equal ``by``
    columns.  ``order_col`` should be unique within ``by``; NULLs come last."""
    by = list(by)
    keys = nulls_last([*by, order_col])
    rows = ranged(df, keys, rows_per_range, stored)
    totals = rows.groupBy(*by, "_rid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # one row per range (and group in it)
    wb = Window.partitionBy(*by).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_rid").alias("_k_rid"),
                         *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_b_{v}") for v in value_cols])
    w = Window.partitionBy(*by, "_rid").orderBy(*nulls_last([order_col])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = rows.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_i_{v}") for v in value_cols])
    on = F.col("_rid") == F.col("_k_rid")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    return inner.join(base, on).select(
        *df.columns, *[(F.col(f"_b_{v}") + F.col(f"_i_{v}")).alias(f"{v}{suffix}") for v in value_cols])
