"""Gain-ratio trees against a plain recursive search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.functions.beta import betainc
from caseflow.plans import gain_ratio as G
from caseflow.plans import ml as M

NUMS, CATS = ("a", "b"), ("p", "s")


def bits(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c)


def labels(rows):
    return [sum(r["y"] == c for r in rows) for c in ("no", "yes")]


def best(rows, least=2):
    """(attribute, threshold or levels, gain, ratio) by looking at every split."""
    found = []
    for c in NUMS:
        known = [r for r in rows if r[c] is not None]
        values = sorted({r[c] for r in known})
        options = []
        for v in values[:-1]:
            low, high = [r for r in known if r[c] <= v], [r for r in known if r[c] > v]
            if min(len(low), len(high)) >= least:
                gain = bits(labels(known)) - len(low) / len(known) * bits(labels(low)) - len(high) / len(known) * bits(labels(high)) - math.log2(len(values) - 1) / len(known)
                options.append((round(gain, 9), -v, gain, bits([len(low), len(high)])))
        if options:
            *_, gain, info = max(options)
            found.append((c, -max(options)[1], gain, info))
    for c in CATS:
        known = [r for r in rows if r[c] is not None]
        parts = {v: [r for r in known if r[c] == v] for v in sorted({r[c] for r in known})}
        if sum(len(x) >= least for x in parts.values()) >= 2:
            gain = bits(labels(known)) - sum(len(x) / len(known) * bits(labels(x)) for x in parts.values())
            found.append((c, list(parts), gain, bits([len(x) for x in parts.values()])))
    found = [f for f in found if f[2] > 1e-9 and f[3] > 0]
    if not found:
        return None
    mean = sum(f[2] for f in found) / len(found)
    able = [f for f in found if f[2] >= mean - 1e-9]
    c, cut, gain, info = min(able, key=lambda f: (-round(f[2] / f[3], 9), f[0]))
    return c, cut, gain, gain / info


def plain(rows, depth, path=""):
    """{path: split} of the whole tree."""
    split = best(rows) if depth and len(rows) >= 4 and min(labels(rows)) else None
    if split is None:
        return {}
    c, cut, gain, ratio = split
    out = {path: (c, cut if not isinstance(cut, list) else None, 2 if not isinstance(cut, list) else len(cut), round(gain, 9), round(ratio, 9), len(rows))}
    join = f"{path} & " if path else ""
    if isinstance(cut, list):
        for v in cut:
            out |= plain([r for r in rows if r[c] == v], depth - 1, f"{join}{c}={v}")
    else:
        out |= plain([r for r in rows if r[c] is not None and r[c] <= cut], depth - 1, f"{join}{c}<={cut:g}")
        out |= plain([r for r in rows if r[c] is not None and r[c] > cut], depth - 1, f"{join}{c}>{cut:g}")
    return out


def table(rng, n=500):
    rows = []
    for i in range(n):
        a, b, p = int(rng.integers(0, 30)), round(float(rng.normal()), 2), "xyz"[int(rng.integers(3))]
        good = (a > 12) if p == "x" else (b > 0.3) if p == "y" else rng.random() < 0.2
        rows.append({"id": i, "a": a if i % 37 else None, "b": b, "p": p if i % 41 else None, "s": f"s{int(rng.integers(6))}",
                     "y": "yes" if good != (rng.random() < 0.1) else "no"})
    return rows


SCHEMA = "id int, a int, b double, p string, s string, y string"


@pytest.mark.parametrize("seed", [1, 2])
def test_every_split_equals_a_plain_search(spark, seed):
    rows = table(np.random.default_rng(seed))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    tree = G.grow(df, NUMS, CATS, "y", max_depth=4)
    got = {n.path: (n.attribute, n.threshold, len(n.children), round(n.gain, 9), round(n.ratio, 9), int(sum(n.counts))) for n in tree.nodes if n.attribute}
    assert got == plain(rows, 4)
    # rows end where their path says
    out = tree.placed(df).select("id", "_node").collect()
    def holds(r, path):
        for step in path.split(" & ") if path else []:
            c = step[0]
            if r[c] is None or not (r[c] <= float(step[3:]) if "<=" in step else r[c] > float(step[2:]) if ">" in step else r[c] == step[2:]):
                return False
        return True
    for o in out:
        n, r = tree.nodes[o["_node"]], rows[o["id"]]
        assert holds(r, n.path) and not any(holds(r, tree.nodes[c].path) for c in n.children)


def test_upper_error_is_the_binomial_limit():
    for wrong, n in [(0, 6), (1, 16), (5, 40), (39, 40), (300, 2000)]:
        rate = G.upper_errors(wrong, n, 0.25) / n
        # as few errors or fewer have probability 0.25 at the limit
        assert abs(1 - betainc(wrong + 1, n - wrong, rate) - 0.25) < 1e-9
    assert G.upper_errors(4, 4, 0.25) == 4
    assert abs(G.upper_errors(0, 6, 0.25) - 6 * (1 - 0.25 ** (1 / 6))) < 1e-9


def test_pruning_keeps_what_pays_and_helps_on_new_rows(spark):
    rng = np.random.default_rng(7)
    train, test = (spark.createDataFrame(table(rng, 900), SCHEMA) for _ in range(2))
    full = G.grow(train, NUMS, CATS, "y", max_depth=6)
    size = len(full.nodes)
    plain_nodes = [G.Node(n.counts, n.depth, n.path, n.attribute, n.threshold, n.levels, n.gain, n.ratio, n.first) for n in full.nodes]
    pruned = G.GainRatioTree(G.prune(plain_nodes, 0.25), full.classes, NUMS, CATS)
    assert len(pruned.nodes) < size

    def bound(t, nodes):
        n = sum(nodes[t].counts)
        own = G.upper_errors(n - max(nodes[t].counts), n, 0.25)
        branch = sum(bound(c, nodes) for c in nodes[t].children) if nodes[t].children else None
        if branch is not None:
            assert own > branch + 0.1  # every kept split pays
        return own if branch is None else branch

    bound(0, pruned.nodes)
    wrong = {k: t.transform(test).where((F.col("prediction") == 1.0) != (F.col("y") == "yes")).count() for k, t in (("full", full), ("pruned", pruned))}
    assert wrong["pruned"] <= wrong["full"] and wrong["pruned"] < 0.25 * 900
    assert pruned.transform(test).count() == 900


def test_defined_cases(spark):
    rows = [(i, i % 10, "u" if i % 10 > 4 else "v", "Passed" if i % 10 > 4 else "REFERRED") for i in range(100)]
    df = spark.createDataFrame(rows, "bill_id int, no_days int, party string, status string")
    tree = G.ml_gain_ratio_tree(df, ["no_days"], ["party"])
    odd = spark.createDataFrame([(1, None, None), (2, 3, "new"), (3, 9, "u"), (4, 0, "v")], "bill_id int, no_days int, party string")
    out = {r.bill_id: r.prediction for r in tree.transform(odd).collect()}
    assert len(out) == 4 and out[3] == 0.0 and out[4] == 1.0  # classes in alphabetical order
    assert M.ml_predict(tree, df, keep=["bill_id"]).where("predicted <> actual").isEmpty()
    one = G.ml_gain_ratio_tree(df.where("party = 'u'"), ["no_days"], ["party"])
    assert len(one.nodes) == 1 and one.transform(odd).where("prediction = 0").count() == 4
    assert len(G.grow(df, ["no_days"], [], max_nodes=1).nodes) == 1
    with pytest.raises(ValueError):
        G.grow(df.limit(0), ["no_days"], ["party"])
