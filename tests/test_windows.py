"""lead_step: the split (skew) path equals the plain window, on skewed and real data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow.operators.prefix import nulls_last, ranged, running_sums

from caseflow.operators.windows import heavy_keys, lead_step
from tests.conftest import SF001


def _rows(df):
    return sorted((tuple(r) for r in df.select("k", "d", "s", "next_d", "next_s").collect()), key=repr)


def test_split_path_equals_window_on_hot_key(spark):
    base = dt.date(2020, 1, 1)
    data = [("hot", base + dt.timedelta(days=i % 50), i, f"t{i % 7}") for i in range(3000)]
    data += [(f"c{i}", base + dt.timedelta(days=i % 3), i, "x") for i in range(300)]
    data += [("hot", None, 99999, "nulldate")]
    df = spark.createDataFrame(data, "k string, d date, s int, t string")
    args = dict(part="k", order=["d"], tiebreak=["s"], cols=["d", "s"], names=["next_d", "next_s"])
    ref = _rows(lead_step(df, skew="none", **args))
    assert _rows(lead_step(df, skew="all", max_rows=400, **args)) == ref
    hot = spark.createDataFrame([("hot",)], "k string")
    assert _rows(lead_step(df, skew="auto", hot_keys=hot, max_rows=500, **args)) == ref


def test_heavy_keys_are_counted_exactly(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"))
    assert sorted(str(r["k"]) for r in heavy_keys(df, "k", 999).collect()) == ["-1", "None"]
    assert heavy_keys(df, "k", 1000).isEmpty()


@pytest.mark.parametrize("null_share,hot_share", [(0, 3), (3, 0), (3, 4), (2, 2)])
def test_heavy_and_null_keys_with_an_extra_column(spark, null_share, hot_share):
    k = F.col("id") % 300
    if hot_share:
        k = F.when(F.col("id") % hot_share == 1, F.lit(-1)).otherwise(k)
    if null_share:
        k = F.when(F.col("id") % null_share == 0, F.lit(None)).otherwise(k)
    df = spark.range(6000).select(k.alias("k"), F.expr("date_add(date'2020-01-01', cast(pmod(xxhash64(id), 40) as int))").alias("d"),
                                  F.col("id").alias("s"), (F.col("id") % 5).cast("string").alias("w")).repartition(5)
    args = dict(part="k", order=["d"], tiebreak=["s"], cols=["d", "s"], names=["next_d", "next_s"])
    ref = lead_step(df, skew="none", **args)
    got = lead_step(df, skew="auto", max_rows=300, **args)
    # the branches read different columns, as a weighted step table does
    assert _rows(got) == _rows(ref) and got.count() == 6000
    agg = lambda x: sorted(map(tuple, x.groupBy("w").agg(F.count("next_s"), F.sum(F.datediff("next_d", "d"))).collect()))
    assert agg(got) == agg(ref)


def test_ranges_are_bounded(spark):
    df = spark.range(40_000).select(F.xxhash64("id").alias("o"), F.lit(1).alias("v"))
    sizes = [r[1] for r in ranged(df, nulls_last(["o"]), 500).groupBy("_rid").count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 1500
    got = running_sums(df, "o", ["v"], 500).orderBy("o").collect()
    assert [r.v_before for r in got] == list(range(40_000))


def test_running_sums_by_group_and_null_order(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(50)] + [("b", i, 2) for i in range(30)] + [(None, 5, 3), ("a", None, 7)],
                               "g string, o int, v int")
    got = {(r.g, r.o): r.v_before for r in running_sums(df, "o", ["v"], 10, by=["g"]).collect()}
    assert got == {**{("a", i): i for i in range(50)}, **{("b", i): 2 * i for i in range(30)}, (None, 5): 0, ("a", None): 50}


def test_split_path_on_test_tables(spark):
    from caseflow.sources.tables import TEST_TIEBREAK, bind_test_tables
    a = bind_test_tables(spark, SF001).actions_lean
    args = dict(tiebreak=list(TEST_TIEBREAK))
    x = lead_step(a, skew="none", **args).select("bill_id", "line_no", "part_id", "committee", "next_row", "next_type")
    y = lead_step(a, skew="all", max_rows=900, **args).select(x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_many_small_ranges_sample_few_rows(spark, monkeypatch):
    from caseflow.operators import prefix
    monkeypatch.setattr(prefix, "SAMPLED_RANGES", 4)
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("v"))
    out = prefix.ranged(df, prefix.nulls_last(["v"]), 20)
    files = out.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4  # a partition for each sampled range, a hundred without the cut by position
    r = out.groupBy("_rid").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("_rid").collect()
    assert sum(x.n for x in r) == 2000 and all(x.n <= 20 for x in r)
    assert all(a.hi < b.lo for a, b in zip(r, r[1:]))
    sums = prefix.running_sums(df.withColumn("one", F.lit(1).cast("long")), "v", ["one"], 20).collect()
    assert len(sums) == 2000 and all(x.one_before == x.v for x in sums)
