"""Descriptive statistics and cross-tabs: xtabs, six-number summary, histogram,
row counts, schema info, factor levels and the dashboard KPIs.

All of them are aggregates that reduce map-side; nothing is collected except
where a bounded list is needed to name output columns (pivot values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# quantile probabilities of R's summary(): min, Q1, median, Q3, max
SUMMARY_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def xtabs(long: DataFrame, row: str, col: str, value: str, values: Sequence[str]) -> DataFrame:
    """Dense cross-tab ``xtabs(value ~ row + col)``: one row per ``row`` label,
    one column per listed ``col`` value, sum of ``value``, 0 where absent.
    The value list is passed in (no extra job to discover it)."""
    vals = list(values)
    wide = long.groupBy(row).pivot(col, vals).agg(F.sum(value))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v)
                              for v in vals]).orderBy(F.col(row).asc_nulls_last())


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, v, c): rows per distinct non-NULL value of each column, in one
    pass over ``df`` (columns stacked, partial aggregation before the shuffle)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s"))
    return (stacked.where(F.col("s.v").isNotNull())
            .groupBy(F.col("s.variable").alias("variable"), F.col("s.v").alias("v"))
            .agg(F.count(F.lit(1)).alias("c")))


def exact_quantiles(counts: DataFrame, probs: Sequence[float] = SUMMARY_PROBS) -> DataFrame:
    """Exact linear-interpolation quantiles (R type 7) of every variable of a
    (variable, v, c) value-count table, without gathering values: a distributed
    running sum gives each distinct value's rank range and each quantile reads
    the two order statistics around rank (n-1)p.  Memory per task stays bounded
    whatever the number of distinct values.  Rows: variable, mean, q0, q1, ..."""
    from caseflow.operators.prefix import running_sums
    r = running_sums(counts, "v", ["c"], by=["variable"])
    n = r.groupBy(F.col("variable").alias("_var")).agg(F.sum("c").alias("_n"))  # one row per variable
    r = r.join(n, F.col("variable") == F.col("_var"))
    aggs = [(F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        at = lambda k: (F.col("c_before") <= k) & (k < F.col("c_before") + F.col("c"))
        aggs += [F.max(F.when(at(F.floor(h)), F.col("v"))).alias(f"lo{i}"),
                 F.max(F.when(at(F.ceil(h)), F.col("v"))).alias(f"hi{i}"), F.max(h).alias(f"h{i}")]
    row = r.groupBy("variable").agg(*aggs)
    return row.select("variable", "mean", *[(F.col(f"lo{i}") + (F.col(f"h{i}") - F.floor(F.col(f"h{i}")))
                                             * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"q{i}")
                                            for i in range(len(probs))])


def summary_stats(df: DataFrame, cols: Sequence[str], exact: bool = True,
                  accuracy: int = 10000) -> DataFrame:
    """R ``summary()`` per numeric column: min, Q1, median, mean, Q3, max.

    ``exact`` (default): one pass over ``df`` builds the value-count table of
    all columns, and exact type-7 quantiles come from its distributed running
    sums with bounded memory.  ``exact=False`` uses
    ``percentile_approx``.  Output is long: one row per column name.
    """
    if not exact:
        aggs = [F.struct(F.percentile_approx(F.col(c).cast("double"), list(SUMMARY_PROBS), accuracy).alias("q"),
                         F.avg(F.col(c).cast("double")).alias("m")).alias(f"s{i}") for i, c in enumerate(cols)]
        wide = df.agg(*aggs)
        out = None
        for i, c in enumerate(cols):
            q = F.col(f"s{i}.q")
            row = wide.select(F.lit(c).alias("variable"), q[0].alias("min"), q[1].alias("q1"), q[2].alias("median"),
                              F.col(f"s{i}.m").alias("mean"), q[3].alias("q3"), q[4].alias("max"))
            out = row if out is None else out.unionByName(row)
        return out
    q = exact_quantiles(value_counts(df, cols))
    return q.select("variable", F.col("q0").alias("min"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
                    "mean", F.col("q3").alias("q3"), F.col("q4").alias("max"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def schema_info(df: DataFrame) -> DataFrame:
    """``str()``/``colnames()``: one row per column with its position and type."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def factor_levels(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-NULL levels with their 0-based index (R factor order),
    numbered by a distributed running count (any column may be passed)."""
    from caseflow.operators.prefix import running_sums
    lv = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_sums(lv, col, ["_one"]).select(col, F.col("_one_before").cast("bigint").alias("level_index"))


def kpis(features: DataFrame, members_born: DataFrame | None = None) -> DataFrame:
    """The dashboard's three info boxes as real queries: most actions on one
    bill, longest bill in days (and, with a birthday table, the youngest sponsor)."""
    aggs = [F.max("ac_count").cast("bigint").alias("max_actions"),
            F.max("no_days").cast("bigint").alias("max_days")]
    out = features.agg(*aggs)
    if members_born is not None:
        # a one-value scalar subquery, not a join
        youngest = members_born.select(F.max_by("name", "birthday")).scalar()
        out = out.select("*", youngest.alias("youngest_sponsor"))
    return out


def histogram(df: DataFrame, col: str, lo: float, width: float, n_bins: int) -> DataFrame:
    """Counts in right-closed bins ``(lo + (i-1)w, lo + i w]`` (R ``hist``), the
    lowest bin also taking ``lo``; values outside the range are not counted.
    Every bin appears, with 0 when empty (the bin list is generated, not data)."""
    x = F.col(col).cast("double")
    b = F.greatest(F.ceil((x - F.lit(lo)) / F.lit(width)), F.lit(1)).cast("int")
    inside = (x >= F.lit(lo)) & (x <= F.lit(lo + width * n_bins))
    counts = df.where(inside).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    spark = df.sparkSession
    bins = spark.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
