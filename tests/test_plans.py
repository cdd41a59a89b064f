"""Plan shapes: anti/semi joins, top-k, pushed filters, single-pass outcome aggregate."""

from caseflow.plans.registry import QUERIES
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_not_exists_is_anti_join(spark):
    assert "LeftAnti" in plan(QUERIES["rejected_not_public"](spark, SF001))


def test_topk_is_semi_join_and_take_ordered(spark):
    p = plan(QUERIES["topk_monthly"](spark, SF001))
    assert "LeftSemi" in p and "TakeOrderedAndProject" in p


def test_equality_filter_pushed_to_scan(spark):
    df = QUERIES["filter_eq"](spark, SF001)
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey," in df._jdf.queryExecution().executedPlan().toString()


def test_bill_features_single_aggregate_over_actions(spark):
    p = QUERIES["bill_features"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in p            # no per-bill window: one partial aggregate
    # lineitem is read twice: once as actions (one aggregate gives count, latest
    # date and outcome) and once by the test binding for bills.updatedate
    assert p.count("Relation [l_orderkey") == 2


def test_heavy_key_takes_range_split_path(spark):
    from pyspark.sql import functions as F
    from caseflow.operators.windows import lead_step
    df = spark.range(400000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("t"))
    out = lead_step(df, "k", ["t"], (), ["t"], ["next_t"], skew="auto", max_rows=50_000)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "_rid" in p          # the heavy key 0 is split by range
    assert out.where("k = 0 AND next_t IS NULL").count() == 1
