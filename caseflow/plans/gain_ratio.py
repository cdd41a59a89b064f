"""Gain-ratio decision trees: multiway splits on categories, thresholds on numbers, error-based pruning.

Rows are first reduced to distinct attribute tuples with their class counts.  The
tree grows by levels: one grouped count over (node, attribute, value) serves all
nodes of a level, class counts below each threshold come from a distributed
running sum, and only the chosen split of each node reaches the driver.  Rows
move to their children through a broadcast of the level's splits.

A threshold pays the coding cost of its choice: log2(thresholds) / rows off its
gain.  Of the attributes whose gain is at least the mean of the positive ones,
the one with the largest gain ratio wins (ties: the first name).  A split
needs two children of ``min_rows`` rows.  Pruning goes bottom-up and compares the upper
limits of the binomial error at ``confidence``.

Defined cases: a null number or category, and a category that a node has not
seen, stays at its node and gets that node's majority class; a null label takes no part.
A tree has at most ``max_nodes`` nodes: later nodes are leaves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.beta import betainc_inv
from caseflow.operators.prefix import running_sums
from caseflow.plans import ml as M
from caseflow.session import shared_table

MAX_NODES = 1 << 12


@dataclass
class Node:
    counts: list[float]
    depth: int
    path: str = ""
    attribute: str | None = None
    threshold: float | None = None
    levels: list[str] = field(default_factory=list)
    gain: float = 0.0
    ratio: float = 0.0
    first: int = -1  # number of the first child; they follow each other

    @property
    def children(self) -> range:
        n = 0 if self.attribute is None else 2 if self.threshold is not None else len(self.levels)
        return range(self.first, self.first + n)


def _entropy(counts: Sequence[Column], total: Column) -> Column:
    """Bits of a distribution given as counts; none for an empty one."""
    parts = [F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0) for c in counts]
    return -sum(parts, F.lit(0.0))


def _classes(k: int, prefix: str = "c") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(k)]


def _total(cols: Sequence[Column]) -> Column:
    return sum(cols[1:], cols[0])


def _numeric_splits(values: DataFrame, k: int, min_rows: float) -> DataFrame:
    """The best threshold of each (node, attribute) of (node, attribute, v, c0...): the largest gain, then the smallest threshold."""
    stored = shared_table(values, "values")
    run = running_sums(stored, "v", [f"c{i}" for i in range(k)], by=["node", "attribute"], inclusive=True, suffix="_below", stored=True)
    whole = stored.groupBy("node", "attribute").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)], F.max("v").alias("top"), (F.count("*") - 1).alias("cuts"))
    x = run.select("node", "attribute", "v", *[F.col(f"c{i}_below").alias(f"b{i}") for i in range(k)]).join(whole, ["node", "attribute"])
    below, every = _classes(k, "b"), _classes(k, "t")
    above = [t - b for t, b in zip(every, below)]
    n, nb, na = _total(every), _total(below), _total(above)
    gain = _entropy(every, n) - nb / n * _entropy(below, nb) - na / n * _entropy(above, F.greatest(na, F.lit(1.0))) - F.log2(F.greatest("cuts", F.lit(1))) / n
    x = x.where((F.col("v") < F.col("top")) & (nb >= min_rows) & (na >= min_rows))
    x = x.select("node", "attribute", "v", gain.alias("gain"), _entropy([nb, na], n).alias("info"))
    best = x.groupBy("node", "attribute").agg(F.max_by(F.struct("gain", "info", "v"), F.struct(F.round("gain", 9), -F.col("v"))).alias("b"))
    return best.select("node", "attribute", "b.gain", "b.info", F.col("b.v").alias("threshold"), F.lit(None).cast("array<string>").alias("levels"))


def _category_splits(values: DataFrame, k: int, min_rows: float) -> DataFrame:
    """The multiway split of each (node, attribute) of (node, attribute, level, c0...)."""
    own = _total(_classes(k))
    x = values.withColumn("n", own).withColumn("h", F.col("n") * _entropy(_classes(k), own))
    g = x.groupBy("node", "attribute").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)], F.sum("h").alias("h"), F.sum("n").alias("n"),
                                           F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.sum((F.col("n") >= min_rows).cast("int")).alias("big"),
                                           F.array_sort(F.collect_list("level")).alias("levels"))  # as many as the category has
    g = g.where("big >= 2")
    return g.select("node", "attribute", (_entropy(_classes(k, "t"), F.col("n")) - F.col("h") / F.col("n")).alias("gain"),
                    (F.log2("n") - F.col("nlogn") / F.col("n")).alias("info"), F.lit(None).cast("double").alias("threshold"), "levels")


def choose_splits(data: DataFrame, nums: Sequence[str], cats: Sequence[str], k: int, min_rows: float) -> DataFrame:
    """(node, attribute, threshold, levels, gain, ratio) of every node of ``data`` that a split helps."""
    found = None
    counts = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    for cols, name, kind, best in ((nums, "v", "double", _numeric_splits), (cats, "level", "string", _category_splits)):
        if cols:
            stack = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast(kind).alias(name)) for c in cols]))
            values = data.select("node", *_classes(k), stack.alias("x")).where(F.col(f"x.{name}").isNotNull())
            got = best(values.groupBy("node", F.col("x.attribute").alias("attribute"), F.col(f"x.{name}").alias(name)).agg(*counts), k, min_rows)
            found = got if found is None else found.unionByName(got)
    found = found.where((F.col("gain") > 1e-9) & (F.col("info") > 0))
    pick = F.struct((F.col("gain") / F.col("info")).alias("ratio"), "gain", "attribute", "threshold", "levels")
    # at most one row per attribute and node
    per = found.groupBy("node").agg(F.avg("gain").alias("mean"), F.collect_list(pick).alias("s"))
    able = F.filter("s", lambda s: s["gain"] >= F.col("mean") - 1e-9)
    first = F.array_sort(F.transform(able, lambda s: F.struct((-F.round(s["ratio"], 9)).alias("r"), s["attribute"].alias("a"), s.alias("s"))))[0]["s"]
    return per.select("node", first.alias("s")).select("node", "s.*")


class GainRatioTree:
    """Nodes in breadth-first order and the classes; ``transform`` adds prediction and class shares."""

    def __init__(self, nodes: list[Node], classes: list[str], nums: Sequence[str], cats: Sequence[str]):
        self.nodes, self.classes, self.nums, self.cats = nodes, classes, list(nums), list(cats)

    def placed(self, df: DataFrame, col: str = "_node") -> DataFrame:
        """``df`` with the number of the node where each row ends: one broadcast of the splits per level."""
        out = df.withColumn(col, F.lit(0))
        schema = T.StructType.fromDDL("_at int, _attr string, _cut double, _levels array<string>, _first int")
        for depth in range(max(n.depth for n in self.nodes)):
            rows = [(i, n.attribute, n.threshold, n.levels, n.first) for i, n in enumerate(self.nodes) if n.depth == depth and n.attribute]
            if not rows:
                break
            splits = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most ``max_nodes`` rows
            number, level = (F.coalesce(*[F.when(F.col("_attr") == c, F.col(c).cast(kind)) for c in cols]) if cols else F.lit(None).cast(kind)
                             for cols, kind in ((self.nums, "double"), (self.cats, "string")))
            at = F.when(F.col("_cut").isNotNull(), F.when(number <= F.col("_cut"), 0).when(number > F.col("_cut"), 1))
            at = F.coalesce(at, F.nullif(F.array_position("_levels", level), F.lit(0)) - 1)
            move = F.when(F.col("_attr").isNotNull(), F.col("_first") + at)
            out = out.join(splits, out[col] == splits["_at"], "left").select(*df.columns, F.coalesce(move, F.col(col)).cast("int").alias(col))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        rows = [(i, float(n.counts.index(max(n.counts))), [(c + 1) / (sum(n.counts) + len(n.counts)) for c in n.counts]) for i, n in enumerate(self.nodes)]
        table = F.broadcast(df.sparkSession.createDataFrame(rows, "_node int, prediction double, _share array<double>"))
        return self.placed(df).join(table, "_node").select(*df.columns, "prediction", array_to_vector("_share").alias("probability"))


def upper_errors(wrong: float, n: float, confidence: float) -> float:
    """Rows that a leaf is taken to get wrong: ``n`` times the upper limit of its binomial error rate."""
    return n if wrong >= n else n * betainc_inv(wrong + 1, n - wrong, 1 - confidence)


def prune(nodes: list[Node], confidence: float) -> list[Node]:
    """Bottom-up: a node whose own upper error is at most that of its branch becomes a leaf; the others keep their order."""
    bound = [0.0] * len(nodes)
    for i in reversed(range(len(nodes))):
        n = nodes[i]
        total = sum(n.counts)
        own = upper_errors(total - max(n.counts), total, confidence)
        bound[i] = own
        if n.children:
            branch = sum(bound[c] for c in n.children)
            if own <= branch + 0.1:
                n.attribute, n.threshold, n.levels, n.first = None, None, [], -1
            else:
                bound[i] = branch
    keep, place = [0], {0: 0}
    for i in keep:  # grows as it is read: breadth first
        for c in nodes[i].children:
            place[c] = len(keep)
            keep.append(c)
    for i in keep:
        if nodes[i].children:
            nodes[i].first = place[nodes[i].first]
    return [nodes[i] for i in keep]


def grow(df: DataFrame, nums: Sequence[str] = M.NUM_COLS, cats: Sequence[str] = M.CAT_COLS, label: str = M.LABEL, max_depth: int = 6,
         min_rows: float = 2, max_nodes: int = MAX_NODES) -> GainRatioTree:
    """The unpruned tree."""
    classes = [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    if not classes:
        raise ValueError("no labelled row")
    k = len(classes)
    cols = [*nums, *cats]
    data = df.groupBy(*cols).agg(*[F.sum((F.col(label) == c).cast("double")).alias(f"c{i}") for i, c in enumerate(classes)])
    data = shared_table(data.where(_total([F.coalesce(c, F.lit(0.0)) for c in _classes(k)]) > 0), "tuples")
    tree = GainRatioTree([], classes, nums, cats)
    tree.nodes.append(Node(list(map(float, data.agg(*[F.sum(c) for c in _classes(k)]).first())), 0))
    active = [0]
    for depth in range(max_depth):
        active = [i for i in active if sum(c > 0 for c in tree.nodes[i].counts) > 1 and sum(tree.nodes[i].counts) >= 2 * min_rows]
        if not active:
            break
        here = tree.placed(data, "node").where(F.col("node").isin(active))
        chosen = sorted(choose_splits(here, nums, cats, k, min_rows).collect(), key=lambda r: r.node)  # one row per node
        added = []
        for s in chosen:
            n = tree.nodes[s.node]
            names = [f"{s.attribute}<={s.threshold:g}", f"{s.attribute}>{s.threshold:g}"] if s.threshold is not None else [f"{s.attribute}={v}" for v in s.levels]
            if len(tree.nodes) + len(names) > max_nodes:
                continue
            n.attribute, n.threshold, n.levels, n.gain, n.ratio, n.first = s.attribute, s.threshold, list(s.levels or []), s.gain, s.ratio, len(tree.nodes)
            for name in names:
                added.append(len(tree.nodes))
                tree.nodes.append(Node([0.0] * k, depth + 1, f"{n.path} & {name}" if n.path else name))
        if not added:
            break
        sums = tree.placed(data, "node").groupBy("node").agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(_classes(k))])
        for r in sums.where(F.col("node").isin(added)).collect():
            tree.nodes[r.node].counts = [float(r[f"c{i}"]) for i in range(k)]
        active = added
    return tree


def ml_gain_ratio_tree(train: DataFrame, nums: Sequence[str] = M.NUM_COLS, cats: Sequence[str] = M.CAT_COLS, label: str = M.LABEL,
                       max_depth: int = 6, min_rows: float = 2, confidence: float = 0.25, max_nodes: int = MAX_NODES) -> GainRatioTree:
    """Grown to ``max_depth`` and pruned at ``confidence``."""
    tree = grow(train, nums, cats, label, max_depth, min_rows, max_nodes)
    tree.nodes = prune(tree.nodes, confidence)
    return tree


def splits_table(tree: GainRatioTree, spark) -> DataFrame:
    """One row per inner node: its path from the root, split, gain and gain ratio."""
    rows = [(n.path, n.attribute, n.threshold, len(n.children), n.gain, n.ratio, int(sum(n.counts))) for n in tree.nodes if n.attribute]
    return spark.createDataFrame(rows, "path string, attribute string, threshold double, branches int, gain double, ratio double, cases long")
