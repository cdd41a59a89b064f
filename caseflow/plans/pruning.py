"""Weakest-link pruning of classification trees, and the complexity table of a tree.

A fitted tree is read as a table (node, children, rows per class).  Bottom-up sums
of errors and leaves give every inner node the complexity at which its branch is
not worth its leaves; taking the weakest links one after another yields the
nested sequence of subtrees.  The table has a row per subtree: its complexity,
splits, error on the training rows, and cross-validated error with its spread.

The tree has at most ``2 ** (max_depth + 1)`` nodes whatever the number of rows, and rows
meet it in Spark only: per fold one count by (leaf, class).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.plans import ml as M
from caseflow.session import ensure_checkpoint_dir, note_shared, shared_table


@dataclass
class Tree:
    """Nodes by number, the root first: children (-1: none) and rows per class."""

    left: list[int]
    right: list[int]
    counts: list[list[float]]

    def errors(self, t: int) -> int:
        """Rows that the node's majority class gets wrong."""
        return round(sum(self.counts[t]) - max(self.counts[t]))

    def label(self, t: int) -> int:
        return self.counts[t].index(max(self.counts[t]))

    def leaves(self) -> list[int]:
        return [t for t, x in enumerate(self.left) if x < 0]


def read_tree(spark: SparkSession, model) -> Tree:
    """The table of a fitted MLlib tree, from its saved form in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    note_shared(path)
    rows = spark.read.parquet(f"{path}/data").select("id", "leftChild", "rightChild", "impurityStats").orderBy("id").collect()
    return Tree([r.leftChild for r in rows], [r.rightChild for r in rows], [list(r.impurityStats) for r in rows])


def pruning_sequence(tree: Tree) -> tuple[list[tuple[Fraction, int, int]], list[Fraction | None]]:
    """(complexity, leaves, errors) of the nested subtrees from the largest to the root, with
    complexity in errors per leaf; and per node the complexity from which on it is a leaf
    (0 for the tree's own leaves)."""
    n = len(tree.left)
    order = sorted(range(n), key=_depths(tree).__getitem__, reverse=True)
    own = [tree.errors(t) for t in range(n)]
    leaf_from: list[Fraction | None] = [Fraction(0) if tree.left[t] < 0 else None for t in range(n)]
    out, alpha = [], Fraction(0)
    while True:
        size, errors, weakest = [1] * n, own[:], None
        for t in order:
            if leaf_from[t] is None:
                kids = (tree.left[t], tree.right[t])
                size[t], errors[t] = sum(size[k] for k in kids), sum(errors[k] for k in kids)
                link = Fraction(own[t] - errors[t], size[t] - 1)
                weakest = link if weakest is None or link < weakest else weakest
        if weakest is None or weakest > alpha:
            out.append((alpha, size[0], errors[0]))
        if weakest is None:
            return out, leaf_from
        alpha = max(alpha, weakest)
        for t in order:  # all links of that strength, inner ones of a cut branch too
            if leaf_from[t] is None and Fraction(own[t] - errors[t], size[t] - 1) <= alpha:
                leaf_from[t] = alpha
        for t in reversed(order):  # what lies below a cut is gone with it
            for k in (tree.left[t], tree.right[t]):
                if k >= 0 and leaf_from[t] is not None and leaf_from[k] is None:
                    leaf_from[k] = alpha


def _depths(tree: Tree) -> list[int]:
    depth = [0] * len(tree.left)
    for t, kids in enumerate(zip(tree.left, tree.right)):  # children have larger numbers
        for k in kids:
            if k >= 0:
                depth[k] = depth[t] + 1
    return depth


def ends(tree: Tree, leaf_from: list[Fraction | None], alpha: float) -> list[int]:
    """For each leaf of the full tree, in order, the node where its rows end in the subtree of a complexity."""
    end = list(range(len(tree.left)))
    for t, kids in enumerate(zip(tree.left, tree.right)):
        cut = end[t] != t or (leaf_from[t] is not None and leaf_from[t] <= alpha)
        for k in kids:
            if k >= 0 and cut:
                end[k] = end[t]
    return [end[t] for t in tree.leaves()]


def cp_rows(tree: Tree, cp: float) -> list[tuple[float, int, float]]:
    """(complexity, splits, relative error) from the root to the subtree of complexity ``cp``, in shares of the root's errors."""
    root = max(1, tree.errors(0))
    rows, floor = [], False
    for alpha, leaves, errors in reversed(pruning_sequence(tree)[0]):
        if not floor:
            floor = alpha / root <= cp
            rows.append((max(float(alpha / root), cp), leaves - 1, errors / root))
    return rows


class PrunedTree:
    """A fitted tree cut back to the subtree of a complexity; transforms like the tree it comes from."""

    def __init__(self, encoder: PipelineModel, model, tree: Tree, cp: float):
        self.encoder, self.model, self.tree = encoder, model.copy().setLeafCol("_leaf"), tree
        leaf_from = pruning_sequence(tree)[1]
        self.ends = ends(tree, leaf_from, cp * max(1, tree.errors(0)))

    def transform(self, df: DataFrame) -> DataFrame:
        keep = self.encoder.transform(df)
        out = self.model.transform(keep).select(*keep.columns, F.col("_leaf").cast("int").alias("_leaf"))

        def of(values):  # one entry per leaf of the full tree
            return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_leaf") + 1)

        share = [[c / sum(self.tree.counts[t]) for c in self.tree.counts[t]] for t in self.ends]
        classes = range(len(self.tree.counts[0]))
        return out.select(*keep.columns, of([self.tree.label(t) for t in self.ends]).alias("prediction"),
                          array_to_vector(F.array(*[of([s[c] for s in share]) for c in classes])).alias("probability"))


def _learner(max_depth: int) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(seed=1, maxBins=64, maxDepth=max_depth, weightCol=M.WEIGHT)


def cross_validated_errors(data: DataFrame, betas: Sequence[float], max_depth: int, k: int, parallelism: int = 4) -> list[int]:
    """Held-out errors over all folds of the subtree of each complexity (in shares of the root's errors)."""
    spark = data.sparkSession

    def fold(f: int) -> list[int]:
        model = _learner(max_depth).fit(data.where(F.col("fold") != f))
        tree = read_tree(spark, model)
        leaf_from = pruning_sequence(tree)[1]
        held = model.setLeafCol("_leaf").transform(data.where(F.col("fold") == f))
        seen = held.groupBy("_leaf", "label").agg(F.sum(M.WEIGHT).cast("long").alias("n")).collect()  # at most leaves x classes
        wrong = []
        for beta in betas:
            end = ends(tree, leaf_from, beta * max(1, tree.errors(0)))
            wrong.append(sum(r["n"] for r in seen if tree.label(end[int(r["_leaf"])]) != int(r["label"])))
        return wrong

    with ThreadPool(parallelism) as pool:
        return [sum(x) for x in zip(*pool.map(fold, range(k)))]


def _fitted(df: DataFrame, cp: float, max_depth: int, k: int, seed: int, parallelism: int):
    cols = [*M.NUM_COLS, *M.CAT_COLS, M.LABEL]
    folds = M.counted(M.ml_stratified_folds(df.select("bill_id", *cols), k, seed), [*cols, "fold"])
    enc = Pipeline(stages=M.ml_encode(one_hot=False)).fit(folds)
    data = shared_table(enc.transform(folds).select("features", "label", "fold", M.WEIGHT), "encoded")
    model = _learner(max_depth).fit(data)
    tree = read_tree(df.sparkSession, model)
    rows = cp_rows(tree, cp)
    betas = [math.inf, *[math.sqrt(a[0] * b[0]) for a, b in zip(rows, rows[1:])]]  # inside the range where each subtree is the best
    wrong = cross_validated_errors(data, betas, max_depth, k, parallelism)
    n, root = sum(tree.counts[0]), max(1, tree.errors(0))
    table = [(float(c), int(s), float(e), m / root, math.sqrt(max(0.0, m - m * m / n)) / root) for (c, s, e), m in zip(rows, wrong)]
    return enc, model, tree, table


def ml_cp_table(df: DataFrame, cp: float = 0.0, max_depth: int = 8, k: int = 10, seed: int = 11, parallelism: int = 4) -> DataFrame:
    """The complexity table of the tree: ``complexity``, ``splits``, ``rel_error``, ``xerror``, ``xstd``, from
    the root to the largest subtree worth ``cp``.  Folds are drawn within each class."""
    table = _fitted(df, cp, max_depth, k, seed, parallelism)[3]
    return df.sparkSession.createDataFrame(table, "complexity double, splits int, rel_error double, xerror double, xstd double")


def best_cp(table: Sequence[tuple], one_se: bool = True) -> float:
    """Complexity of the smallest subtree within one spread of the least cross-validated error (or of that error itself)."""
    least = min(table, key=lambda r: r[3])
    return next(r[0] for r in table if r[3] <= least[3] + (least[4] if one_se else 0.0))


def ml_pruned_tree(train: DataFrame, cp: float | None = None, max_depth: int = 8, k: int = 10, seed: int = 11,
                   one_se: bool = True, parallelism: int = 4) -> PrunedTree:
    """A tree pruned to ``cp``, by default to the value that cross-validation finds."""
    if cp is None:
        enc, model, tree, table = _fitted(train, 0.0, max_depth, k, seed, parallelism)
        return PrunedTree(enc, model, tree, best_cp(table, one_se))
    rows = M.distinct_rows(train)
    enc = Pipeline(stages=M.ml_encode(one_hot=False)).fit(rows)
    model = _learner(max_depth).fit(enc.transform(rows).select("features", "label", M.WEIGHT))
    return PrunedTree(enc, model, read_tree(train.sparkSession, model), cp)
