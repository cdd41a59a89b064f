"""Process composites on hand fixtures: ties, NULLs, fan-out, negative days."""

from pyspark.sql import functions as F

from caseflow.plans import process as P
from tests.fixtures import tables


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_bill_features_edges(spark):
    t = tables(spark)
    bf = P.bill_features(t.actions, t.bills, t.sponsors, t.members)
    got = rows(bf, "bill_id", "no_days", "party", "ac_count", "status")
    # B1 two sponsors (fan-out), B3 lower-case marker at its latest date and a
    # negative day count truncated toward zero, B4 has no sponsor (drops out)
    assert got == [("B1", 60, "D", 4, "Passed"), ("B1", 60, "R", 4, "Passed"),
                   ("B2", 0, "D", 1, "REFERRED"), ("B3", -1, "R", 3, "Passed"),
                   ("B5", 2, "R", 2, "REFERRED")]
    dates = {r["bill_id"]: r["createdate"] for r in bf.collect()}
    assert dates["B1"] == "01/01/2015"


def test_outcomes_general_marker_path(spark):
    t = tables(spark)
    # a marker with a blank forces the exact joined-string path
    a = P.bill_outcomes(t.actions, ("%law committee%",))
    assert rows(a, "bill_id", "status") == [("B1", "REFERRED"), ("B2", "REFERRED"),
                                           ("B3", "REFERRED"), ("B4", "REFERRED"), ("B5", "REFERRED")]
    b = P.bill_outcomes(t.actions, ("%committee floor%",))
    # B1's latest date has only BecameLaw; B5's latest date joins 'Committee IntroReferral'
    assert dict(rows(b, "bill_id", "status"))["B5"] == "REFERRED"
    c = P.bill_outcomes(t.actions, ("%committee introreferral%",))
    assert dict(rows(c, "bill_id", "status"))["B5"] == "Passed"


def test_pass_referred_totals(spark):
    t = tables(spark)
    bf = P.bill_features(t.actions, t.bills, t.sponsors, t.members)
    pr = dict(rows(P.pass_referred(bf), "status", "cnt"))
    assert sum(pr.values()) == bf.count()


def test_transitions_tiebreak_and_fanout(spark):
    t = tables(spark)
    tr = rows(P.transitions(t.actions, t.bills, tiebreak=["seq"], skew="none"), "type", "next_type", "no_days")
    assert ("Committee", "Floor", 0.0) in tr          # same-day pair ordered by seq
    assert ("IntroReferral", "Committee", 2.0) in tr  # B1: 4 days, B5: same day
    # NULL date sorts last: B3 goes NULL-type -> becamelaw -> Floor(NULL date)
    assert ("becamelaw", "Floor", None) in tr
    f = rows(P.transitions_filtered(t.actions, t.bills, t.sponsors, t.members, party="D",
                                    tiebreak=["seq"], skew="none"), "type", "next_type", "no_days")
    assert ("IntroReferral", "Committee", 4.0) in f   # B1 only (its sponsor M2 is D; B5's is R)


def test_transitions_weighted_equals_fanout(spark):
    t = tables(spark)
    # every bill gets two identical sponsor rows of the same member: means must not change
    sp = t.sponsors.unionByName(t.sponsors)
    a = rows(P.transitions_filtered(t.actions, t.bills, sp, t.members, tiebreak=["seq"], skew="none"),
             "type", "next_type", "no_days")
    b = rows(P.transitions_filtered(t.actions, t.bills, t.sponsors, t.members, tiebreak=["seq"],
                                    skew="none"), "type", "next_type", "no_days")
    assert a == b


def test_dwell_crosstab_dilution(spark):
    t = tables(spark)
    ct = P.dwell_crosstab(t.actions, t.bills, types=("IntroReferral", "Committee"), tiebreak=["seq"],
                          by_next=False, skew="none")
    r = {x["type"]: x for x in ct.collect()}
    assert r["IntroReferral"]["introreferral"] == 2.0      # B1: 4 days, B5: 0 days
    assert r["IntroReferral"]["committee"] == 0.0          # ELSE 0 dilutes the other columns


def test_topk_monthly_ties_and_range(spark):
    t = tables(spark)
    out = P.topk_monthly(t.actions, t.committees, k=1)
    # Budget (C2 + C3 share the name) has 3 referrals, Rules 1
    assert rows(out, "name", "dt", "cnt") == [("Budget", "2015-03", 1), ("Budget", "2015-04", 1),
                                             ("Budget", "2015-05", 1)]
    rng = P.topk_monthly(t.actions, t.committees, k=1, year=2015, month_lo=0, month_hi=4)
    assert rows(rng, "dt") == [("2015-03",), ("2015-04",)]
    empty = P.topk_monthly(t.actions, t.committees, k=1, year=2015, month_lo=7, month_hi=6)
    assert empty.count() == 0
    wide = P.topk_monthly_wide(t.actions, t.committees, k=2)
    assert wide.columns == ["dt", "Budget", "Rules"]
    assert wide.agg(F.sum("Budget") + F.sum("Rules")).first()[0] == 4


def test_latest_and_anti(spark):
    t = tables(spark)
    ls = dict(rows(P.latest_status(t.actions, ["seq"]), "bill_id", "status"))
    assert ls["B5"] == "Rejected motion"   # same day: lowest seq first
    assert ls["B3"] is None                # latest dated action has NULL text
    rj = rows(P.rejected_not_public(t.actions), "bill_id")
    assert rj == [("B4",)]                 # B5 became public


def test_window_max_keeps_null_key_group(spark):
    from caseflow.operators.windows import filter_eq_window_max, max_over
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2), ("a", 2), ("b", None)], "k string, v int")
    mo = sorted((tuple(r) for r in max_over(df, "k", "v", "m").collect()), key=repr)
    assert mo == sorted([(None, 1, 3), (None, 3, 3), ("a", 2, 2), ("a", 2, 2), ("b", None, None)], key=repr)
    fm = sorted((tuple(r) for r in filter_eq_window_max(df, "k", "v").collect()), key=repr)
    assert fm == sorted([(None, 3), ("a", 2), ("a", 2)], key=repr)


def test_month_window_edges(spark):
    import datetime as dt
    from caseflow.operators.relational import filter_year_months, month_window
    assert month_window(2015, 0, 12) == (dt.date(2015, 1, 1), dt.date(2016, 1, 1))
    assert month_window(2015, 3, 3) == (dt.date(2015, 3, 1), dt.date(2015, 4, 1))
    assert month_window(2015, 7, 6) is None
    t = tables(spark)
    assert filter_year_months(t.actions, "action_date", 2015, 0, 1).count() == 5  # January, NULL date excluded
    assert filter_year_months(t.actions, "action_date", 2015, 7, 6).count() == 0


def test_markers_over_long_runs_equal_the_whole_string(spark):
    """Runs of equal types are cut to what the markers can tell apart; the whole joined string decides the same."""
    import datetime as dt
    import random
    import re
    rnd = random.Random(3)
    types = ["A", "AB", "", "B x", None]
    bills = {}
    for b in range(60):
        bills[f"B{b}"] = [t for t in types for _ in range(rnd.choice([0, 0, 1, 2, 5, 40]))] or [None]
    df = spark.createDataFrame([(b, dt.date(2020, 1, 1), t) for b, ts in bills.items() for t in ts], "bill_id string, action_date date, type string").repartition(3)

    def like(s, pattern):
        rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.upper())
        return re.fullmatch(rx, s.upper(), re.S) is not None

    for marker in ["%a a a%", "a a", "%a ab%", "a%b x", "%b x b x b x", "_ a%", "%  %", "a a a a a", "%a%b%a%", ""]:
        want = sorted((b, "Passed" if any(t is not None for t in ts) and like(" ".join(sorted(t for t in ts if t is not None)), marker) else "REFERRED")
                      for b, ts in bills.items())
        assert rows(P.bill_outcomes(df, (marker,)), "bill_id", "status") == want, marker


def test_a_heavy_bill_is_split_over_tasks(spark):
    """One bill with 70 % of all actions: its join with the weights is split, and the steps stay exact."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    acts = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 500)).alias("bill_id"),
                                      F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 997).cast("int")).alias("action_date"),
                                      F.concat(F.lit("t"), F.col("id") % 5).alias("type"), F.col("id").alias("seq")).repartition(8)
    bills = acts.select(F.col("bill_id").alias("id")).distinct()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = P.transitions(acts, bills, ["seq"], max_rows=2000)
        got = rows(out, "type", "next_type", "no_days")
        assert "skew=true" in out._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = rows(P.transitions(acts, bills, ["seq"], skew="none"), "type", "next_type", "no_days")
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))
