"""Ordered per-key operators: next step, whole-group max, latest row per key.

Ordering is always explicit: ``order`` columns ascending with NULLs last (the
reference's ``ORDER BY action_date``), followed by ``tiebreak`` columns, so a
result never depends on which of two same-day actions Spark happens to see
first.

Skew: a single bill may hold a large share of all actions.  ``latest_*`` and
``max_*`` are aggregates (partial aggregation, no group is ever buffered).
``lead_step`` needs the rows of a bill in order; bills with more rows than one
task should order are cut into ranges of the full ordering key, and the rows at
the range borders are stitched with a per-(bill, range) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.exprs import f_micros
from caseflow.operators.prefix import ROWS_PER_RANGE, nulls_last, ranged
from caseflow.session import shared_table


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def sort_exprs(cols: Sequence[str], desc: bool = False) -> list[Column]:
    """SQL-style ordering with NULLs last for either direction."""
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c in cols]


def order_struct(df: DataFrame, order: Sequence[str], tiebreak: Sequence[str] = (),
                 desc: bool = False) -> Column:
    """A struct whose natural ascending order equals the SQL ordering
    ``order [DESC] NULLS LAST, tiebreak ASC NULLS LAST``.

    Used as the ordering key of ``min_by`` so "first row per key" is an
    aggregate (partial aggregation) instead of a sort of each group.  For a
    descending order the value is negated, so ``order`` must be numeric, a
    date or a timestamp there.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    fields = []
    for i, c in enumerate(order):
        v = F.col(c)
        if desc:
            t = types.get(c, "")
            if t == "date":
                v = -F.unix_date(v)
            elif t.startswith("timestamp"):
                v = -f_micros(v, t)
            elif t == "string":
                raise TypeError(f"descending min_by key needs a numeric or date column: {c}")
            else:
                v = -v
        fields += [F.col(c).isNull().alias(f"n{i}"), v.alias(f"v{i}")]
    for j, c in enumerate(tiebreak):
        fields += [F.col(c).isNull().alias(f"tn{j}"), F.col(c).alias(f"tv{j}")]
    return F.struct(*fields)


def heavy_keys(df: DataFrame, key: str, max_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Keys (NULL included) with more than ``max_rows`` rows, by exact count: at most
    rows / ``max_rows`` of them, as a written table, or an empty local one in the
    usual case of none (one job).  Only the key column is read."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > F.lit(max_rows)).select(key)
    return df.sparkSession.createDataFrame([], n.schema) if n.isEmpty() else shared_table(n, "heavy-keys")


def _lead_window(df: DataFrame, part: str, ordering: list[Column], cols, names) -> DataFrame:
    w = Window.partitionBy(part).orderBy(*ordering)
    return df.select("*", *[F.lead(c, 1).over(w).alias(n) for c, n in zip(cols, names)])


def _lead_split(df: DataFrame, part: str, order_cols: list[str], cols, names, max_rows: int) -> DataFrame:
    """Exact ``lead`` for heavy keys: rows are cut into ranges of the full order
    (key, order columns, read order), lead runs within each (key, range), and the
    last row of a range takes the first row of the key's next range.

    The ranges come from one written table, so all branches see the same bounds."""
    rows = ranged(df.withColumn("_uid", F.monotonically_increasing_id()),
                  nulls_last([part, *order_cols, "_uid"]), max_rows)
    w = Window.partitionBy(part, "_rid").orderBy(*nulls_last([*order_cols, "_uid"]))
    inner = rows.select("*", F.lead(F.lit(True), 1).over(w).alias("_has_next"),
                        *[F.lead(c, 1).over(w).alias(n) for c, n in zip(cols, names)])
    # first row of every (key, range): one row per group, partial aggregation
    place = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(
        e for c in (*order_cols, "_uid") for e in (F.col(c).isNull(), F.col(c)))])
    firsts = rows.groupBy(part, "_rid").agg(
        F.min_by(F.struct(*[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)]), place).alias("_first"))
    # the key's next range: at most (ranges + heavy keys) rows in total
    after = F.lead("_first", 1).over(Window.partitionBy(part).orderBy("_rid"))
    fix = firsts.select(F.col(part).alias("_k"), F.col("_rid").alias("_r"), after.alias("_next_first"))
    out = inner.join(fix, F.col(part).eqNullSafe(F.col("_k")) & (F.col("_rid") == F.col("_r")), "left")
    fixed = [F.when(F.col("_has_next").isNull(), F.col("_next_first").getField(f"x{i}"))
             .otherwise(F.col(n)).alias(n) for i, n in enumerate(names)]
    return out.select(*df.columns, *fixed)


def lead_step(df: DataFrame, part: str = "bill_id", order: Sequence[str] = ("action_date",),
              tiebreak: Sequence[str] = (), cols: Sequence[str] = ("action_date", "type"),
              names: Sequence[str] = ("next_row", "next_type"), skew: str = "auto",
              max_rows: int = ROWS_PER_RANGE, hot_keys: DataFrame | None = None) -> DataFrame:
    """``lead(c, 1) OVER (PARTITION BY part ORDER BY order, tiebreak)`` for each of ``cols``.

    ``skew``: ``"auto"`` splits the keys (NULL too) that have more than
    ``max_rows`` rows, ``"none"`` uses a plain window, ``"all"`` sends every key
    through the split path.  ``hot_keys`` passes the heavy keys if they are known."""
    order_cols = _as_list(order) + _as_list(tiebreak)
    ordering = sort_exprs(order_cols)
    if skew == "none":
        return _lead_window(df, part, ordering, cols, names)
    if skew == "all":
        return _lead_split(df, part, order_cols, cols, names, max_rows)
    heavy = (hot_keys if hot_keys is not None else heavy_keys(df, part, max_rows)).select(F.col(part).alias("_k"))
    if heavy.isEmpty():
        return _lead_window(df, part, ordering, cols, names)
    same = F.col(part).eqNullSafe(F.col("_k"))
    light = _lead_window(df.join(heavy, same, "left_anti"), part, ordering, cols, names)
    return light.unionByName(_lead_split(df.join(heavy, same, "left_semi"), part, order_cols, cols, names, max_rows))


def _join_back(df: DataFrame, per_key: DataFrame, part: str) -> DataFrame:
    """Join a one-row-per-key aggregate back to its rows; NULL keys match each
    other, as rows with a NULL key share one window partition in SQL."""
    k = per_key.withColumnRenamed(part, "_k")
    return df.join(k, df[part].eqNullSafe(k["_k"]), "inner").drop("_k")


def max_over(df: DataFrame, part: str, col: str, alias: str = "group_max") -> DataFrame:
    """``max(col) OVER (PARTITION BY part)`` as an aggregate joined back.

    The aggregate has one row per key; the join back is a plain equi-join whose
    heavy keys AQE splits (skew join), so no group is buffered in one task.
    """
    m = df.groupBy(part).agg(F.max(col).alias(alias))
    return _join_back(df, m, part)


def filter_eq_window_max(df: DataFrame, part: str = "bill_id", col: str = "action_date") -> DataFrame:
    """Rows whose ``col`` equals the maximum of their group (all ties kept)."""
    m = df.groupBy(part).agg(F.max(col).alias("_max"))
    return _join_back(df, m, part).where(F.col(col) == F.col("_max")).drop("_max")


def latest_per_key(df: DataFrame, key: str = "bill_id", order: str = "action_date",
                   tiebreak: Sequence[str] = (), value: str = "text",
                   alias: str = "status") -> DataFrame:
    """``DISTINCT ON (key) key, value ORDER BY key, order DESC`` (NULL order last,
    ties broken by ``tiebreak`` ascending) as a ``min_by`` aggregate."""
    ok = order_struct(df, [order], tiebreak, desc=True)
    return df.groupBy(key).agg(F.min_by(F.col(value), ok).alias(alias))


def first_value_latest(df: DataFrame, key: str = "bill_id", order: str = "action_date",
                       tiebreak: Sequence[str] = (), value: str = "text",
                       alias: str = "status") -> DataFrame:
    """``DISTINCT first_value(value) OVER (PARTITION BY key ORDER BY order DESC)``:
    the distinct latest values over all keys."""
    return latest_per_key(df, key, order, tiebreak, value, alias).select(alias).distinct()


def latest_per_date(df: DataFrame, date: str = "action_date", tiebreak: Sequence[str] = (),
                    value: str = "text", alias: str = "status") -> DataFrame:
    """``DISTINCT ON (date) ... ORDER BY date DESC`` then DISTINCT of the values:
    one value per date (the first by ``tiebreak``), de-duplicated."""
    ok = order_struct(df, [], tiebreak)
    per_date = df.groupBy(date).agg(F.min_by(F.col(value), ok).alias(alias))
    return per_date.select(alias).distinct()
