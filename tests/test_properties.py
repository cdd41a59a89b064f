"""Properties from the survey's test strategy, on the bound test tables and on
generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseflow.operators import text as TX
from caseflow.plans.registry import QUERIES
from tests.conftest import SF001


def test_xtabs_total_equals_long_total(spark):
    wide = QUERIES["topk_monthly_wide"](spark, SF001)
    long = QUERIES["topk_monthly"](spark, SF001)
    names = [c for c in wide.columns if c.startswith("c")]
    w = wide.agg(sum(F.sum(F.col(f"`{n}`")) for n in names)).first()[0]
    assert w == long.agg(F.sum("cnt")).first()[0]


def test_lead_rows_kept_equals_actions_minus_bills(spark):
    from caseflow.operators.windows import lead_step
    from caseflow.sources.tables import TEST_TIEBREAK, bind_test_tables
    a = bind_test_tables(spark, SF001).actions_lean
    kept = lead_step(a, tiebreak=list(TEST_TIEBREAK)).where("next_type IS NOT NULL").count()
    assert kept == a.count() - a.select("bill_id").distinct().count()


def test_outcome_counts_cover_features(spark):
    pr = QUERIES["pass_referred"](spark, SF001).agg(F.sum("cnt")).first()[0]
    assert pr == QUERIES["bill_features"](spark, SF001).count()


def test_latest_keeps_every_bill(spark):
    # distinct bills over the latest-per-bill set equals distinct bills over actions
    a = QUERIES["count_distinct_sub"](spark, SF001).first()[0]
    b = QUERIES["count_distinct_bills"](spark, SF001).first()[0]
    assert a == b


texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab céZ中", max_size=12)), min_size=1, max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=texts, seq=st.integers(1, 6), block=st.integers(1, 9))
def test_windows_equal_brute_force(spark, texts, seq, block):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    s = "".join((t or "").lower() + "\n" for t in texts)
    exp = [(i, s[i:i + seq], s[i + seq]) for i in range(len(s) - seq)]
    got = sorted(tuple(r) for r in TX.t_windows(df, seq=seq, block=block, rows_per_range=2).collect())
    assert got == exp
