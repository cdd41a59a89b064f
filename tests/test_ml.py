"""Splits, evaluation arithmetic and learner sanity on small data."""

from pyspark.sql import functions as F

from caseflow.plans import evaluate as EV
from caseflow.plans import ml as M


def test_split_disjoint_and_complete(spark):
    df = spark.range(2000).select(F.col("id").alias("bill_id"))
    s = M.ml_split(df, 0.85, 42)
    tr = s.where("split = 'train'").count()
    assert tr + s.where("split = 'test'").count() == 2000
    assert 0.8 < tr / 2000 < 0.9


def test_confusion_stats_hand_arithmetic(spark):
    rows = ([("Passed", "Passed")] * 40 + [("Passed", "REFERRED")] * 10
            + [("REFERRED", "Passed")] * 5 + [("REFERRED", "REFERRED")] * 45)
    df = spark.createDataFrame(rows, "predicted string, actual string")
    r = EV.ml_confusion_stats(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (40, 10, 5, 45)
    assert abs(r.accuracy - 0.85) < 1e-12
    assert abs(r.sensitivity - 40 / 45) < 1e-12 and abs(r.specificity - 45 / 55) < 1e-12
    pe = (50 * 45 + 50 * 55) / 100 ** 2
    assert abs(r.kappa - (0.85 - pe) / (1 - pe)) < 1e-12
    # a class missing from the predictions still gets its column
    only = spark.createDataFrame([("Passed", "Passed"), ("Passed", "REFERRED")], "predicted string, actual string")
    assert EV.ml_confusion(only).columns == ["predicted", "Passed", "REFERRED"]


def test_auc_ties_and_symmetry(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.5, False), (3.0, True)],
                               "s double, y boolean")
    auc = EV.ml_roc_auc(df, "s", F.col("y")).first()[0]
    # pairs: 3 pos x 2 neg = 6; wins 5, one tie at 1.0 -> 5.5 / 6
    assert abs(auc - 5.5 / 6) < 1e-12
    neg = EV.ml_roc_auc(df.withColumn("s", -F.col("s")), "s", F.col("y")).first()[0]
    assert abs(neg - (1 - auc)) < 1e-12


def test_tree_learns_separable(spark):
    rows = [(i, i % 30, "R" if i % 2 else "D", (i % 5) + (20 if i % 30 > 15 else 0), "CA",
             "Passed" if i % 30 > 15 else "REFERRED") for i in range(600)]
    df = spark.createDataFrame(rows, "bill_id long, no_days int, party string, ac_count long, state string, status string")
    train, test = M.ml_stratified_split(df, 0.85, 1)
    pred = M.ml_predict(M.ml_tree(train, max_depth=3), test, keep=["bill_id"])
    acc = EV.ml_confusion_stats(pred).first().accuracy
    assert acc > 0.95


def test_greedy_ensemble_prefers_better_model(spark):
    rows = [(float(i % 2), float(i % 2) * 0.9 + 0.05, 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "y double, good double, bad double")
    w = M.ml_greedy_ensemble(df, ["good", "bad"], "y", iters=20)
    assert w[0] > w[1]


def test_exact_quantiles(spark):
    import numpy as np
    from caseflow.operators import stats as S
    vals = [float(x) for x in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    exp = [float(np.quantile(vals, p)) for p in S.SUMMARY_PROBS]
    got = S.summary_stats(df, ["x"]).first()
    assert [got["min"], got["q1"], got["median"], got["q3"], got["max"]] == exp
    q = S.exact_quantiles(S.value_counts(df, ["x"])).first()
    assert [q[f"q{i}"] for i in range(5)] == exp and abs(q["mean"] - sum(vals) / len(vals)) < 1e-12


def test_stratified_split_is_exact_within_each_class(spark):
    rows = [(i, "rare" if i % 100 == 0 else "often") for i in range(1000)] + [(5, "often"), (None, None)]
    df = spark.createDataFrame(rows, "bill_id long, status string")
    got = {(r.status, r.split): r.n for r in M.ml_stratified_labels(df, 0.85).groupBy("status", "split").agg(
        F.count_distinct(F.coalesce("bill_id", F.lit(-1))).alias("n")).collect()}
    assert got == {("rare", "train"): 9, ("rare", "test"): 1, ("often", "train"): 842, ("often", "test"): 148, (None, "train"): 1}
    assert M.hash_threshold(1.0) > "ffffffff" and M.ml_split(df, 1.0).where("split = 'test'").isEmpty()


def test_knn_matches_brute_force(spark):
    import numpy as np
    from caseflow.plans.neighbours import ml_knn
    rng = np.random.default_rng(2)
    def rows(n):
        far = np.vstack([rng.integers(0, 12, (n - 3, 2)), rng.integers(500, 900, (3, 2))])
        return [(int(a), int(b), "Passed" if rng.random() < 0.4 else "REFERRED") for a, b in far]
    train, test = rows(120), [(*r[:2],) for r in rows(60)] + [(None, 1), (5000, -5000)]
    tr = spark.createDataFrame(train, "a int, b int, y string")
    te = spark.createDataFrame(test, "a int, b int")
    x = np.array([r[:2] for r in train], float)
    s = x.std(0, ddof=1)
    pos = np.array([r[2] == "Passed" for r in train])
    for k in (1, 5, 200):
        want = {}
        for p in test:
            if None in p:
                want[p] = None
                continue
            d = np.round((((x - np.array(p, float)) / s) ** 2).sum(1), 9)
            near = d <= np.sort(d)[min(k, len(d)) - 1]
            want[p] = round(float(pos[near].mean()), 9)
        got = {(r.a, r.b): None if r.p_positive is None else round(r.p_positive, 9) for r in ml_knn(tr, te, ["a", "b"], "y", "Passed", k).collect()}
        assert got == want
    assert ml_knn(tr.limit(0), te, ["a", "b"], "y", "Passed").where("p_positive is not null").isEmpty()


def test_knn_in_a_dense_spot(spark):
    """Distinct points by the ten thousand within a thousandth of the range, some far ones: leaves stay
    within their bound, and the neighbours are those of a plain search."""
    import numpy as np
    from caseflow.plans import neighbours as N
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 1e-4, (20_000, 2)), rng.uniform(-50, 50, (200, 2))])
    y = rng.random(len(x)) < 0.3
    train = spark.createDataFrame([(float(a), float(b), "P" if c else "N") for (a, b), c in zip(x, y)], "a double, b double, y string").repartition(4)
    ask = np.vstack([rng.normal(0, 1e-4, (40, 2)), rng.uniform(-60, 60, (40, 2)), x[:5], [[0.0, 2e-3], [1e3, 0.0]]])
    test = spark.createDataFrame([(float(a), float(b)) for a, b in ask], "a double, b double")
    s = x.std(0, ddof=1)
    got = {(r.a, r.b): r.p_positive for r in N.ml_knn(train, test, ["a", "b"], "y", "P", 5, digits=12, leaf_points=64).collect()}
    for p in ask:
        dist = np.round((((x - p) / s) ** 2).sum(1), 12)
        near = dist <= np.sort(dist)[4]
        assert abs(got[tuple(p)] - y[near].mean()) < 1e-12
    points = train.select(F.col("a").alias("_v0"), F.col("b").alias("_v1"), F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("_p"))
    low = [float(v) for v in x.min(0) / s]
    levels, leaves = N.partition_tree(points, ["_v0", "_v1"], [float(v) for v in s], low, float((x.max(0) / s - low).max()), 64)
    assert leaves.count() == len(x) and leaves.groupBy("level", "c0", "c1").count().where("count > 64").isEmpty() and len(levels) > 4
    reached = N.reached_leaves(test.select(F.col("a").alias("_v0"), F.col("b").alias("_v1")), ["_v0", "_v1"], levels, [float(v) for v in s], 5, 2e-12)
    assert reached.groupBy("_v0", "_v1").count().agg(F.max("count")).first()[0] <= 40


def test_greedy_weights_equal_a_plain_search(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).astype(float)
    p = np.column_stack([np.clip(y * 0.5 + rng.normal(0.25, 0.3, 300), 0, 1), np.clip(y * 0.3 + rng.normal(0.3, 0.2, 300), 0, 1)])
    w = M.ml_greedy_ensemble(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(p, y)], "a double, b double, y double"), ["a", "b"], "y", 50)
    n = np.zeros(2)
    for _ in range(50):
        n[int(np.argmin([(((p @ (n + np.eye(2)[c])) / (n.sum() + 1) - y) ** 2).sum() for c in range(2)]))] += 1
    assert np.allclose(w[:2], n / 50)


def test_models_score_records_without_a_label_and_ensembles_beat_chance(spark):
    rows = [(i, i % 30, "R" if i % 2 else "D", (i % 5) + (20 if i % 30 > 15 else 0), "CA",
             "Passed" if (i % 30 > 15) != (i % 17 == 0) else "REFERRED") for i in range(600)]
    df = spark.createDataFrame(rows, "bill_id long, no_days int, party string, ac_count long, state string, status string")
    train, test = M.ml_stratified_split(df, 0.8, 1)
    out = M.ml_predict(M.ml_tree(train, max_depth=3), test.drop("status"), keep=["bill_id"])
    assert out.columns == ["bill_id", "predicted", "p_passed", "message"] and out.count() == test.count()
    fits = {"tree": lambda t: M.ml_tree(t, max_depth=3), "logit": M.ml_logit}
    held = M.ml_ensembles(train, test, fits, k=3, iters=50)
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    auc = {r.model: r.auc for r in EV.ml_col_auc(held, ["tree", "logit", "greedy", "stacked"], F.col("status") == "Passed").collect()}
    assert min(auc.values()) > 0.8


def test_learners_meet_distinct_rows_once(spark, monkeypatch):
    """Five copies of a table under other bill numbers give the fits of the table, from as many rows."""
    monkeypatch.setattr(M, "DISTINCT_ROWS", 200)
    monkeypatch.setattr(M, "COUNTED_FROM", 1000)
    rows = [(i, i * 37 % 61, "RD"[i % 2], i * 11 % 13, f"S{i % 5}", "Passed" if i * 37 % 61 > 30 and i % 7 else "REFERRED") for i in range(600)]
    one = spark.createDataFrame(rows, "bill_id long, no_days int, party string, ac_count long, state string, status string")
    many = spark.range(5).crossJoin(one).withColumn("bill_id", F.col("bill_id") + F.col("id") * 600).drop("id")
    fit_rows = M.distinct_rows(many)
    assert fit_rows.count() == one.drop("bill_id").distinct().count() and fit_rows.agg(F.sum(M.WEIGHT)).first()[0] == 3000
    assert len(fit_rows.inputFiles()) > 1 and M.distinct_rows(many) is fit_rows
    for fit in (M.ml_tree, M.ml_logit):
        a, b = ({r.bill_id: r["probability"][0] for r in fit(t).transform(one).collect()} for t in (one, many))
        assert max(abs(a[k] - b[k]) for k in a) < 1e-6
    a, b = (dict(M.adaboost_predict(M.ml_adaboost(t, rounds=3), one, ["bill_id"]).collect()) for t in (one, many))
    assert a == b
