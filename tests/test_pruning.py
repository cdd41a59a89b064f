"""Weakest-link pruning against a search of all subtrees; the table; class-wise folds; counts beyond a long."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.plans import evaluate as EV
from caseflow.plans import ml as M
from caseflow.plans import pruning as P


def random_tree(rng, nodes):
    """A tree of ``nodes`` inner nodes with random class counts; children are numbered in preorder."""
    left, right, counts = [], [], []

    def grow(inner):
        t = len(left)
        left.append(-1)
        right.append(-1)
        counts.append(None)
        if not inner:
            counts[t] = [float(x) for x in rng.integers(0, 9, 2) + np.array([1, 0])]
        else:
            a = int(rng.integers(0, inner))
            left[t] = grow(a)
            right[t] = grow(inner - 1 - a)
            counts[t] = [x + y for x, y in zip(counts[left[t]], counts[right[t]])]
        return t

    grow(nodes)
    return P.Tree(left, right, counts)


def subtrees(tree, t=0):
    """(errors, end nodes) of every pruned subtree."""
    out = [(tree.errors(t), frozenset([t]))]
    if tree.left[t] >= 0:
        out += [(a + c, b | d) for a, b in subtrees(tree, tree.left[t]) for c, d in subtrees(tree, tree.right[t])]
    return out


def test_sequence_equals_a_search_of_all_subtrees(rng=np.random.default_rng(6)):
    for _ in range(150):
        tree = random_tree(rng, int(rng.integers(0, 8)))
        every = subtrees(tree)
        sequence, leaf_from = P.pruning_sequence(tree)
        assert sequence[-1][1:] == (1, tree.errors(0)) and sequence[0][0] == 0
        levels = [a for a, *_ in sequence]
        for alpha, size, errors in sequence:
            for beta in [float(alpha), *[(float(a) + float(b)) / 2 for a, b in zip(levels, levels[1:]) if a == alpha]]:
                cost, least = min((round(e + beta * len(x), 9), len(x)) for e, x in every)
                assert (round(errors + beta * size, 9), size) == (cost, least)  # the smallest of the cheapest
                best = [x for e, x in every if round(e + beta * len(x), 9) == cost and len(x) == least]
                assert best == [frozenset(P.ends(tree, leaf_from, beta + 1e-12))]


def test_table_rows(rng=np.random.default_rng(8)):
    tree = random_tree(rng, 12)
    rows = P.cp_rows(tree, 0.0)
    assert rows[0][1:] == (0, 1.0) and rows[-1][0] == 0.0
    assert all(a[0] > b[0] and a[1] < b[1] and a[2] >= b[2] for a, b in zip(rows, rows[1:]))
    floor = rows[1][0] / 2 + rows[2][0] / 2
    cut = P.cp_rows(tree, floor)
    assert cut[:2] == rows[:2] and cut[2][0] == floor and cut[2][1:] == rows[2][1:] and len(cut) == 3
    assert P.best_cp([(0.5, 0, 1.0, 1.0, 0.1), (0.2, 1, 0.6, 0.7, 0.1), (0.0, 4, 0.5, 0.65, 0.1)]) == 0.2
    assert P.best_cp([(0.5, 0, 1.0, 1.0, 0.1), (0.2, 1, 0.6, 0.7, 0.1), (0.0, 4, 0.5, 0.65, 0.1)], one_se=False) == 0.0


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        days, party, acts = int(rng.integers(0, 60)), "RD"[i % 2], int(rng.integers(0, 12))
        good = (days > 30) != (party == "R" and acts > 8)
        rows.append((i, days, party, acts, f"S{i % 5}", "Passed" if good != (rng.random() < 0.15) else "REFERRED"))
    return spark.createDataFrame(rows, "bill_id long, no_days int, party string, ac_count long, state string, status string").repartition(3)


def test_the_table_prefers_the_tree_behind_the_noise(spark, noisy):
    table = P.ml_cp_table(noisy, max_depth=7, k=5).collect()
    assert [r.splits for r in table] == sorted(r.splits for r in table) and table[0].rel_error == 1.0 and table[0].xerror == 1.0
    errors = noisy.groupBy("status").count().collect()
    n, root = sum(r["count"] for r in errors), min(r["count"] for r in errors)
    for r in table:
        m = r.xerror * root
        assert abs(m - round(m)) < 1e-6 and abs(r.xstd - math.sqrt(m - m * m / n) / root) < 1e-9
    best = min(table, key=lambda r: r.xerror)
    assert best.splits < table[-1].splits and best.xerror < table[-1].xerror and best.xerror < 0.5
    model = P.ml_pruned_tree(noisy, max_depth=7, k=5)
    out = M.ml_predict(model, noisy, keep=["bill_id"])
    full = M.ml_predict(P.ml_pruned_tree(noisy, cp=0.0, max_depth=7), noisy, keep=["bill_id"])
    wrong, least = (x.where("predicted <> actual").count() for x in (out, full))
    assert least == round(table[-1].rel_error * root)  # the table's training error is that of the predictions
    assert wrong == round(next(r.rel_error for r in table if r.splits == len(set(model.ends)) - 1) * root)
    assert out.where("p_passed < 0 or p_passed > 1 or (predicted = 'Passed') <> (p_passed >= 0.5)").isEmpty()
    root_only = P.ml_pruned_tree(noisy, cp=2.0, max_depth=3)
    assert len(set(root_only.ends)) == 1 and M.ml_predict(root_only, noisy.drop("status")).select("predicted").distinct().count() == 1


def test_folds_are_dealt_within_each_class(spark):
    rows = [(i, "rare" if i % 100 == 0 else "often") for i in range(1000)] + [(i, "often") for i in range(1, 50)] + [(None, None)]
    df = spark.createDataFrame(rows, "bill_id long, status string")
    out = M.ml_stratified_folds(df, 5, 3)
    assert out.count() == len(rows)
    per = {(r.status, r.fold): r.n for r in out.groupBy("status", "fold").agg(F.count_distinct("bill_id").alias("n")).collect()}
    assert {per[("rare", f)] for f in range(5)} == {2} and {per[("often", f)] for f in range(5)} == {198}
    assert out.groupBy("bill_id", "status").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_counts_beyond_a_long(spark):
    big = 10_000_000_000
    rows = [("m", 0.1, 0, big), ("m", 0.5, big, big), ("m", 0.9, big, 0)]
    auc = EV.auc_of_counts(spark.createDataFrame(rows, "model string, s double, npos long, nneg long")).first().auc
    assert abs(auc - (0.5 * (0.5 * 0.5 + 0.5) + 0.5)) < 1e-12
    one = spark.createDataFrame([(4 * big, big, 2 * big, 2 * big)], "n long, tp long, pa long, pp long")
    acc, kappa = EV.agreement(*[F.col(c).cast("double") for c in one.columns])
    assert tuple(one.select(acc, kappa).first()) == (0.5, 0.0)
