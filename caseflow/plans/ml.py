"""Tabular classification of bill outcomes on MLlib (survey §2.11).

The model table is ``bill_features`` (no_days, party, ac_count, state ->
status).  Splits are deterministic hashes of the bill key, so every sponsor
row of one bill lands on the same side and the split is identical in any
engine.  Learners are MLlib estimators in a ``Pipeline``; where the
reference used a learner MLlib lacks, the nearest MLlib formulation is used
and named as such (weighted-tree boosting for AdaBoost, random Fourier
features + linear SVM for the radial SVM).  Gain-ratio trees, pruning and other
learners that MLlib lacks have modules of their own beside this one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.prefix import running_sums
from caseflow.plans import shared_fits as S
from caseflow.plans.calibration import fit_sigmoid, kernel_width, sigmoid
from caseflow.plans.neighbours import ml_knn
from caseflow.session import once_per_frame, reliable_checkpoint, shared_table

NUM_COLS = ("no_days", "ac_count")
CAT_COLS = ("party", "state")
LABEL = "status"
POSITIVE = "Passed"  # first level alphabetically, the reference's positive class


#: Number of equal rows that a row of ``distinct_rows`` stands for.
WEIGHT = "_rows"
#: Rows of one task of a fit.
FIT_ROWS = 1 << 18
#: Distinct rows of one task: each is met many times, by every tree level or solver step.
DISTINCT_ROWS = 1 << 15
#: Tables up to this size, or with few distinct rows, stay as they are: small fits keep the split candidates that
#: MLlib draws from the rows, and MLlib wants more rows than levels.
COUNTED_FROM, FEW = 1 << 18, 256


# --- rows of a fit ----------------------------------------------------------------

def spread(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The written table ``rows`` in files of about ``DISTINCT_ROWS`` rows, however few bytes they take."""
    n = -(-rows.count() // DISTINCT_ROWS)
    return rows if n <= 1 else shared_table(rows.repartition(n, *cols).sortWithinPartitions(*cols), "spread")


def is_large(df: DataFrame) -> bool:
    return once_per_frame("rows", df, lambda x: x.count()) > COUNTED_FROM


def counted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` and ``WEIGHT``: rows equal in ``cols`` are one row with their number as weight, as a written
    table.  Days, counts and categories have bounded combinations, so it grows slower than the rows."""
    if is_large(df):
        rows = shared_table(df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)), "distinct-rows")
        if rows.limit(FEW).count() == FEW:
            return spread(rows, cols)
    return df.select(*cols, F.lit(1.0).alias(WEIGHT))


def distinct_rows(train: DataFrame, num_cols: Sequence[str] = NUM_COLS, cat_cols: Sequence[str] = CAT_COLS, label: str = LABEL) -> DataFrame:
    """What a learner of weighted rows needs of ``train``: ``counted`` once for all learners."""
    cols = [*num_cols, *cat_cols, label]
    return once_per_frame(f"rows {cols}", train, lambda df: counted(df, cols))


def bounded_tasks(train: DataFrame) -> DataFrame:
    """``train`` dealt to tasks of at most ``FIT_ROWS`` rows; a learner that draws rows keeps them in memory."""
    n = once_per_frame("tasks", train, lambda df: -(-df.count() // FIT_ROWS))
    return train if n <= 1 else train.repartition(n)


# --- splits --------------------------------------------------------------------

def hash_threshold(p: float) -> str:
    """Eight-hex-digit threshold t with P(md5 prefix < t) = p; ``g`` (above every digit) for p >= 1."""
    return "g" if p >= 1 else format(int(math.ceil(max(p, 0.0) * 16 ** 8)), "08x")


def hash_unit(key_cols: Sequence[str], seed: int) -> 'F.Column':
    """md5 of ``key|...|seed``: a per-key pseudo-random value, engine independent."""
    parts = []
    for c in key_cols:
        parts += [F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")]
    return F.md5(F.concat(*parts, F.lit(str(seed))))


def ml_split(df: DataFrame, p: float, seed: int = 42, key_cols: Sequence[str] = ("bill_id",),
             col: str = "split") -> DataFrame:
    """Label each row ``train`` (probability p) or ``test`` by a hash of its key."""
    h = F.substring(hash_unit(key_cols, seed), 1, 8)
    return df.withColumn(col, F.when(h < F.lit(hash_threshold(p)), F.lit("train")).otherwise(F.lit("test")))


def _class_ranks(df: DataFrame, seed: int, key: str, label: str) -> DataFrame:
    """(``_k``, ``_y``, ``_at``, ``_n``): the distinct keys of each class, their place in the order of a key hash, and their number.

    Places come from a distributed running count over (class, hash); NULL keys or classes are groups like others."""
    keys = df.select(F.col(key).alias("_k"), F.col(label).alias("_y")).distinct()
    place = F.concat(F.md5(F.concat(F.coalesce(F.col("_k").cast("string"), F.lit("")), F.lit(f"|{seed}"))),
                     F.lit("|"), F.coalesce(F.col("_k").cast("string"), F.lit("")))
    keys = shared_table(keys.select("_k", "_y", place.alias("_h"), F.lit(1).cast("long").alias("_one")), "class-keys")
    ranked = running_sums(keys, "_h", ["_one"], by=["_y"], stored=True)
    size = keys.groupBy(F.col("_y").alias("_cy")).agg(F.count("*").alias("_n"))  # one row per class
    return ranked.join(size, F.col("_y").eqNullSafe(F.col("_cy"))).select("_k", "_y", F.col("_one_before").alias("_at"), "_n")


def _key_hash(seed: int, key: str) -> tuple:
    """The hash that orders the keys, and the group of its first three digits."""
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return h, F.substring(h, 1, 3)


def _group_bases(df: DataFrame, seeds: Sequence[int], key: str, label: str) -> DataFrame:
    """(``_seed``, ``_y``, ``_group``): the distinct keys of the class in earlier groups (``_base``) and in all (``_n``);
    at most 4,096 rows for a seed and class."""
    keys = df.select(F.col(key), F.col(label)).distinct()
    of = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), _key_hash(s, key)[1].alias("g")) for s in seeds])).alias("_x")
    sizes = keys.select(F.col(label).alias("_y"), of).groupBy(
        F.col("_x.seed").alias("_seed"), "_y", F.col("_x.g").alias("_group")).agg(F.count(F.lit(1)).alias("_keys"))
    one = Window.partitionBy("_seed", "_y")
    before = F.sum("_keys").over(one.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    return shared_table(sizes.select("_seed", "_y", "_group", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_keys").over(one).alias("_n")), "class-groups")


def _ranked_rows(df: DataFrame, bases: DataFrame, seed: int, key: str, label: str) -> DataFrame:
    """``df`` with ``_at`` and ``_n`` of ``_class_ranks`` in one shuffle: rows meet in the group of their key's hash, are
    ranked there, and the groups before add what they hold."""
    h, g = _key_hash(seed, key)
    rows = df.repartition(g).select(*df.columns, h.alias("_h"), g.alias("_g"))
    place = Window.partitionBy("_g", label).orderBy("_h", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull())
    rows = rows.select(*df.columns, "_g", (F.dense_rank().over(place) - 1).alias("_r"))
    own = F.broadcast(bases.where(F.col("_seed") == seed))
    return rows.join(own, (F.col("_g") == F.col("_group")) & F.col(label).eqNullSafe(F.col("_y"))).select(
        *df.columns, (F.col("_base") + F.col("_r")).alias("_at"), "_n")


def _with_class_column(df: DataFrame, seed: int, value, key: str, label: str, col: str) -> DataFrame:
    """``df`` with a column made of its rows' class ranks: all rows of a key and class agree."""
    if is_large(df):
        return _ranked_rows(df, _group_bases(df, [seed], key, label), seed, key, label).select(*df.columns, value.alias(col))
    side = _class_ranks(df, seed, key, label).select("_k", "_y", value.alias(col))
    return df.join(side, df[key].eqNullSafe(side["_k"]) & df[label].eqNullSafe(side["_y"])).select(*df.columns, col)


def ml_stratified_labels(df: DataFrame, p: float = 0.85, seed: int = 42, key: str = "bill_id", label: str = LABEL,
                         col: str = "split") -> DataFrame:
    """Split within each class: of the n distinct keys of a class, the ceil(p n) with the
    smallest key hash are ``train``, so even a rare class has its share on both sides."""
    side = F.when(F.col("_at") < F.ceil(F.col("_n") * F.lit(float(p))), F.lit("train")).otherwise(F.lit("test"))
    return _with_class_column(df, seed, side, key, label, col)


def ml_stratified_folds(df: DataFrame, k: int = 10, seed: int = 11, key: str = "bill_id", label: str = LABEL,
                        col: str = "fold") -> DataFrame:
    """Folds drawn within each class: its distinct keys, in the order of a key hash, are dealt to
    folds 0 to k - 1 in turn, so the folds of a class differ by one key at most."""
    return _with_class_column(df, seed, (F.col("_at") % k).cast("int"), key, label, col)


def ml_stratified_split(df: DataFrame, p: float = 0.85, seed: int = 42, key: str = "bill_id",
                        label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    s = shared_table(ml_stratified_labels(df, p, seed, key, label), "split")
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def ml_bernoulli_split(df: DataFrame, p: float = 0.66, seed: int = 7,
                       key_cols: Sequence[str] = ("bill_id",)) -> tuple[DataFrame, DataFrame]:
    s = ml_split(df, p, seed, key_cols)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def fold_column(df: DataFrame, k: int, seed: int, key_cols: Sequence[str] = ("bill_id",),
                col: str = "fold") -> DataFrame:
    """Fold id in [0, k) from a hash of the key (all rows of a bill in one fold)."""
    h = F.conv(F.substring(hash_unit(key_cols, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(col, (h % F.lit(k)).cast("int"))


# --- encoding --------------------------------------------------------------------

def ml_encode(num_cols: Sequence[str] = NUM_COLS, cat_cols: Sequence[str] = CAT_COLS,
              label: str = LABEL, one_hot: bool = True) -> list:
    """``status ~ no_days + party + ac_count + state`` as pipeline stages:
    label index (alphabetical levels, so 'Passed' = 0), categorical indexes,
    one-hot vectors, assembled ``features``.  Unseen levels map to an extra slot."""
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")]
    idx = [f"{c}_idx" for c in cat_cols]
    stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=idx, stringOrderType="alphabetAsc",
                                handleInvalid="keep"))
    if one_hot:
        vec = [f"{c}_vec" for c in cat_cols]
        stages.append(OneHotEncoder(inputCols=idx, outputCols=vec, handleInvalid="keep", dropLast=False))
    else:
        vec = idx
    stages.append(VectorAssembler(inputCols=[*num_cols, *vec], outputCol="features", handleInvalid="keep"))
    return stages


def scaled_encoder(train: DataFrame) -> PipelineModel:
    """One-hot categories and numbers, centred and scaled: levels from the distinct rows, the scale from
    one pass over all rows."""
    def make(df: DataFrame) -> PipelineModel:
        stages = ml_encode()
        stages[-1].setOutputCol("raw_features")
        enc = Pipeline(stages=stages).fit(distinct_rows(df))
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        return PipelineModel(stages=[*enc.stages, scaler.fit(enc.transform(df))])
    return once_per_frame("scaled encoder", train, make)


def _fit(train: DataFrame, estimator, scale: bool = False) -> PipelineModel:
    """Encoder and learner, fitted on the distinct rows with their numbers as weights."""
    rows, estimator = distinct_rows(train), estimator.setWeightCol(WEIGHT)
    if not scale:
        return Pipeline(stages=[*ml_encode(), estimator]).fit(rows)
    enc = scaled_encoder(train)
    return PipelineModel(stages=[*enc.stages, estimator.fit(enc.transform(rows))])


# --- learners --------------------------------------------------------------------

def ml_tree(train: DataFrame, max_depth: int = 5, min_info_gain: float = 0.0,
            impurity: str = "gini", seed: int = 1) -> PipelineModel:
    """The reference's final model: a decision tree."""
    return _fit(train, DecisionTreeClassifier(maxDepth=max_depth, minInfoGain=min_info_gain,
                                              impurity=impurity, seed=seed, maxBins=64))


def ml_gbm(train: DataFrame, max_iter: int = 20, max_depth: int = 5, step: float = 0.1) -> PipelineModel:
    return _fit(train, GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=1, maxBins=64))


def ml_random_forest(train: DataFrame, trees: int = 50, max_depth: int = 8) -> PipelineModel:
    """Every tree draws from all rows, so equal rows are not counted together."""
    enc = Pipeline(stages=ml_encode()).fit(distinct_rows(train))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=1, maxBins=64)
    return PipelineModel(stages=[*enc.stages, forest.fit(enc.transform(bounded_tasks(train)).select("features", "label"))])


def ml_logit(train: DataFrame, reg: float = 0.0, elastic_net: float = 0.0) -> PipelineModel:
    """glm (reg=0) / glmnet (reg>0, alpha = elastic_net) logistic regression."""
    return _fit(train, LogisticRegression(regParam=reg, elasticNetParam=elastic_net, maxIter=100),
                scale=True)


class RandomFourierFeatures:
    """Radial-kernel approximation: z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma).

    The projection is a fixed-seed D x d matrix applied per Arrow batch with
    one numpy matrix product (a vectorised pandas UDF, no per-row Python)."""

    def __init__(self, dim_in: int, dim_out: int = 64, gamma: float = 0.5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.W = rng.normal(0.0, math.sqrt(2 * gamma), size=(dim_out, dim_in))
        self.b = rng.uniform(0, 2 * math.pi, size=dim_out)
        self.dim_out = dim_out

    def transform(self, df: DataFrame, col: str = "features", out: str = "rff") -> DataFrame:
        W, b, scale = self.W, self.b, math.sqrt(2.0 / self.dim_out)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, W.shape[1]))
            Z = scale * np.cos(X @ W.T + b)
            return pd.Series(list(Z))

        return df.withColumn(out, array_to_vector(project(vector_to_array(F.col(col)))))


class SvmRadialModel:
    """Encoder + scaler -> random Fourier features -> linear SVM -> sigmoid of the decision value."""

    def __init__(self, enc: PipelineModel, rff: RandomFourierFeatures, svm, curve: tuple[float, float]):
        self.enc, self.rff, self.svm, self.curve = enc, rff, svm, curve

    def transform(self, df: DataFrame) -> DataFrame:
        z = self.svm.transform(self.rff.transform(self.enc.transform(df), "features", "rff"))
        p = sigmoid(vector_to_array("rawPrediction")[0], *self.curve)  # of label 0, the positive class
        return z.withColumn("probability", array_to_vector(F.array(p, 1 - p)))


def ml_svm(train: DataFrame, dim_out: int = 64, gamma: float | None = None, reg: float = 0.01) -> SvmRadialModel:
    """Radial SVM re-aimed: random Fourier features + ``LinearSVC``, with class probabilities.
    The kernel width comes from sampled distances if none is given."""
    enc = scaled_encoder(train)
    encoded = enc.transform(distinct_rows(train))
    d = len(encoded.select("features").first()["features"])
    rff = RandomFourierFeatures(d, dim_out, kernel_width(encoded) if gamma is None else gamma)
    # the projected table is scanned once per solver iteration: materialise it once
    z = reliable_checkpoint(rff.transform(encoded).select("rff", "label", WEIGHT))
    svm = LinearSVC(featuresCol="rff", regParam=reg, maxIter=100, weightCol=WEIGHT).fit(z)
    values = svm.transform(z).select(vector_to_array("rawPrediction")[0].alias("t"), (F.col("label") == 0).cast("int").alias("y"), WEIGHT)
    return SvmRadialModel(enc, rff, svm, fit_sigmoid(shared_table(values, "decision-values"), "t", "y", WEIGHT))


class NearestModel:
    """Training rows to be looked up; ``score`` adds the share of the positive class."""

    def __init__(self, train: DataFrame, k: int):
        self.train, self.k = train, k

    def score(self, df: DataFrame) -> DataFrame:
        return ml_knn(self.train, df, NUM_COLS, LABEL, POSITIVE, self.k)


def ml_nearest(train: DataFrame, k: int = 5) -> NearestModel:
    return NearestModel(train, k)


def ml_adaboost(train: DataFrame, rounds: int = 10, max_depth: int = 2,
                checkpoint: bool = True) -> list[tuple[float, PipelineModel]]:
    """AdaBoost (SAMME, two classes) over weighted decision trees.

    Row weights, at first the numbers of equal rows, live in a DataFrame column and are updated
    with column arithmetic each round; the normaliser is a one-row aggregate.  The
    weighted table is checkpointed each round to cut the growing lineage."""
    rows = distinct_rows(train)
    enc = Pipeline(stages=ml_encode()).fit(rows)
    data = shared_table(enc.transform(rows).select("features", "label", F.col(WEIGHT).alias("w")), "encoded")
    models: list[tuple[float, object]] = []
    for _ in range(rounds):
        total = data.agg(F.sum("w")).first()[0]
        data = data.withColumn("w", F.col("w") / F.lit(total))
        tree = DecisionTreeClassifier(maxDepth=max_depth, weightCol="w", seed=1, maxBins=64).fit(data)
        pred = tree.transform(data).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        err = pred.agg(F.sum(F.col("w") * F.col("miss")) / F.sum("w")).first()[0]
        err = min(max(err, 1e-10), 1 - 1e-10)
        alpha = math.log((1 - err) / err)
        models.append((alpha, tree))
        if err >= 0.5:
            break
        data = pred.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("miss"))).alias("w"))
        if checkpoint:
            data = reliable_checkpoint(data)
    return [(a, PipelineModel(stages=[enc, m])) for a, m in models]


def adaboost_predict(models: list[tuple[float, PipelineModel]], df: DataFrame,
                     id_cols: Sequence[str]) -> DataFrame:
    """Weighted vote of the boosted trees: sign of sum alpha * (+1 class 1 / -1 class 0).
    The trees score one DataFrame one after another: no join."""
    cur = df.withColumn("_score", F.lit(0.0))
    keep = cur.columns
    for alpha, m in models:
        vote = F.col("_score") + F.lit(alpha) * (2 * F.col("prediction") - 1)
        cur = m.transform(cur).select(*[c for c in keep if c != "_score"], vote.alias("_score"))
    return cur.select(*id_cols, (F.col("_score") > 0).cast("double").alias("prediction"))


# --- tuning ------------------------------------------------------------------------

def ml_grid(estimator, **params) -> list:
    b = ParamGridBuilder()
    for name, values in params.items():
        b = b.addGrid(getattr(estimator, name), list(values))
    return b.build()


def ml_cv(df: DataFrame, k: int = 10, repeats: int = 5, depths: Sequence[int] = (3, 5, 8),
          seed: int = 11, parallelism: int = 4) -> DataFrame:
    """Repeated k-fold cross-validation of the decision tree over a depth grid
    (the reference's complexity-parameter table): one row per (repeat, depth)
    with mean AUC over the folds.  Folds are drawn within each class."""
    spark = df.sparkSession
    if is_large(df):
        return _shared_cv(df, k, repeats, depths, seed)
    # encoders are fitted once (as a formula interface encodes before resampling);
    # only the tree is refitted per fold, on a materialised encoded table
    # of the distinct rows of each fold
    cols = [*NUM_COLS, *CAT_COLS, LABEL]
    enc = Pipeline(stages=ml_encode()).fit(distinct_rows(df))
    tree = DecisionTreeClassifier(seed=1, maxBins=64, weightCol=WEIGHT)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label",
                                       metricName="areaUnderROC", weightCol=WEIGHT)
    rows = []
    for r in range(repeats):
        parts = counted(ml_stratified_folds(df.select("bill_id", *cols), k, seed + r), [*cols, "fold"])
        data = shared_table(enc.transform(parts).select("features", "label", "fold", WEIGHT), "folds")
        cv = CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=ev, foldCol="fold",
                            parallelism=parallelism, numFolds=k)
        model = cv.fit(data)
        for pm, m in zip(grid, model.avgMetrics):
            rows.append((r, int(pm[tree.maxDepth]), float(m)))
    return spark.createDataFrame(rows, "repeat int, max_depth int, auc double")


def _shared_cv(df: DataFrame, k: int, repeats: int, depths: Sequence[int], seed: int) -> DataFrame:
    """``ml_cv`` with all trees grown together; a smaller depth is the beginning of the deepest tree.  Held-out rows are
    ranked as MLlib's evaluator ranks them, by the rows of the second class in their leaf."""
    bases = _group_bases(df, range(seed, seed + repeats), "bill_id", LABEL)
    folds, names = df.select("bill_id", *NUM_COLS, *CAT_COLS, LABEL), [f"_f{r}" for r in range(repeats)]
    for r, name in enumerate(names):
        folds = _ranked_rows(folds, bases, seed + r, "bill_id", LABEL).select(*folds.columns, (F.col("_at") % k).cast("byte").alias(name))
    data = S.fold_rows(folds, names, k, NUM_COLS, CAT_COLS, LABEL, POSITIVE)
    own = np.eye(repeats * k)
    uses = [np.repeat(np.eye(repeats)[i // k], k) - own[i] for i in range(repeats * k)]
    trees = S.fit_together(data, {i: S.grow(data, b, max(depths)) for i, b in enumerate(S.training_bins(data, uses))})
    cut = {(i, d): t.cut_at(d) for i, t in trees.items() for d in depths}
    names = list(cut)
    held = S.one_pass(data, {j: S.LeafCounts(cut[n], own[n[0]]) for j, n in enumerate(names)})
    auc = {n: S.area(cut[n].rows[:, 1], *held[j].reshape(-1, 2).T) for j, n in enumerate(names)}
    rows = [(r, int(d), float(np.mean([auc[r * k + f, d] for f in range(k)]))) for r in range(repeats) for d in depths]
    return df.sparkSession.createDataFrame(rows, "repeat int, max_depth int, auc double")


# --- prediction ----------------------------------------------------------------------

LABELS = ("Passed", "REFERRED")  # label index order (alphabetical)


def ml_predict(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring: predicted label, P(Passed) and the UI message; the actual label too
    where ``df`` has it.  Records without a label column are scored like any others."""
    p = model.transform(df)
    lab = F.when(F.col("prediction") == 0.0, F.lit(LABELS[0])).otherwise(F.lit(LABELS[1]))
    cols = [*keep, lab.alias("predicted")]
    if LABEL in df.columns:
        cols.append(F.col(LABEL).alias("actual"))
    if "probability" in p.columns:
        cols.append(vector_to_array("probability")[0].alias("p_passed"))
    return p.select(*cols).withColumn("message", F.concat(F.lit("Bill will be "), F.col("predicted")))


def ml_predict_proba(models: dict, df: DataFrame) -> DataFrame:
    """``df`` with one P(Passed) column per model: the models transform one DataFrame one
    after another, each keeping only its own column (no row key; only models that look
    values up join, with their own tables)."""
    cur = df
    for name, m in models.items():
        keep = cur.columns
        if hasattr(m, "score"):  # adds the probability itself
            cur = m.score(cur).select(*keep, F.col("p_positive").alias(name))
        else:
            cur = m.transform(cur).select(*keep, vector_to_array("probability")[0].alias(name))
    return cur


def ml_center_scale(df: DataFrame, cols: Sequence[str] = NUM_COLS) -> DataFrame:
    """z-scores ``(x - mean) / sd`` (sample sd), stats from one aggregate (a scalar subquery)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_z", (F.col(c) - stats.select(f"m_{c}").scalar()) / stats.select(f"s_{c}").scalar())
    return out


# --- out-of-fold predictions, ensembles ----------------------------------------------

def _fit_all(fits: dict, data: DataFrame, parallelism: int = 4) -> dict:
    """All models of (name -> fit function), several at a time: their jobs are many and small."""
    with ThreadPool(max(1, min(parallelism, len(fits)))) as pool:
        return dict(zip(fits, pool.map(lambda fit: fit(data), fits.values())))


#: The learners that are fitted together for all folds of a large table, in the form ``shared_fits`` knows.
SHARED = {ml_tree: S.tree_learner(5), ml_random_forest: S.forest_learner(50, 8), ml_logit: S.logit_learner()}


def ml_oof(df: DataFrame, fits: dict, k: int = 5, seed: int = 5) -> DataFrame:
    """``df`` (written once) with ``fold`` and out-of-fold P(Passed) columns, one per entry
    (name -> fit function) of ``fits``: fit on k-1 folds, score the held-out fold, union."""
    return _oof(df, fits, k, seed)[0]


def _oof(df: DataFrame, fits: dict, k: int, seed: int, whole: bool = False) -> tuple[DataFrame, dict]:
    """``ml_oof``, and of the learners that are fitted together the models of all rows if ``whole`` says so:
    (FoldRows, name -> model)."""
    data = shared_table(ml_stratified_folds(df, k, seed), "folds")
    shared = {n: SHARED[f] for n, f in fits.items() if f in SHARED} if is_large(df) else {}
    rest = {n: f for n, f in fits.items() if n not in shared}
    models, rows = {}, None
    if shared:
        rows = S.fold_rows(data, ["fold"], k, NUM_COLS, CAT_COLS, LABEL, POSITIVE)
        models = S.fit_learners(rows, shared, [*(1 - np.eye(k)), *([np.ones(k)] if whole else [])])
    cols, out = [*data.columns, *fits], data
    if rest or not shared:
        out = None
        for f in range(k):
            part = ml_predict_proba(_fit_all(rest, data.where(F.col("fold") != f)), data.where(F.col("fold") == f))
            out = part if out is None else out.unionByName(part)
    if shared:
        out = S.scored(out, rows, {n: m[:k] for n, m in models.items()}, "fold").select(*cols)
    return out, ({n: m[k] for n, m in models.items()}, rows) if whole and shared else ({}, None)


def gram_stats(preds: DataFrame, pred_cols: Sequence[str], y: str) -> tuple:
    """One pass: PᵀP (m x m), Pᵀy, yᵀy and n for the prediction columns."""
    m = len(pred_cols)
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(pred_cols)
            for j, b in enumerate(pred_cols) if j >= i]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"py_{i}") for i, a in enumerate(pred_cols)]
    aggs += [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")]
    r = preds.agg(*aggs).first()
    G = [[0.0] * m for _ in range(m)]
    for i in range(m):
        for j in range(i, m):
            G[i][j] = G[j][i] = float(r[f"g_{i}_{j}"])
    py = [float(r[f"py_{i}"]) for i in range(m)]
    return G, py, float(r["yy"]), int(r["n"])


def ml_greedy_ensemble(preds: DataFrame, pred_cols: Sequence[str], y: str, iters: int = 1000) -> list[float]:
    """Greedy forward selection with replacement minimising RMSE of the mean
    prediction; every step works on the m x m sufficient statistics only."""
    G, py, yy, n = gram_stats(preds, pred_cols, y)
    m = len(pred_cols)
    counts = [0] * m
    best_sse = None
    for _ in range(iters):
        best = None
        for c in range(m):
            w = counts[:]
            w[c] += 1
            s = sum(w)
            quad = sum(w[i] * w[j] * G[i][j] for i in range(m) for j in range(m)) / (s * s)
            lin = sum(w[i] * py[i] for i in range(m)) / s
            sse = yy - 2 * lin + quad
            if best is None or sse < best[0] - 1e-15:
                best = (sse, c)
        counts[best[1]] += 1
        best_sse = best[0]
    total = sum(counts)
    return [c / total for c in counts] + [math.sqrt(max(best_sse, 0.0) / n)]


def ml_blend(preds: DataFrame, weights: dict, out: str = "greedy") -> DataFrame:
    """``preds`` with the weighted mean of its prediction columns."""
    total = sum(weights.values())
    return preds.withColumn(out, sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0)) / F.lit(float(total)))


def ml_stack(oof: DataFrame, pred_cols: Sequence[str], label: str = "label"):
    """Logistic stacking over out-of-fold prediction columns."""
    va = VectorAssembler(inputCols=list(pred_cols), outputCol="stack_features")
    weight = {}
    if is_large(oof):
        oof, weight = counted(oof, [*pred_cols, label]), {"weightCol": WEIGHT}
    lr = LogisticRegression(featuresCol="stack_features", labelCol=label, maxIter=100,
                            probabilityCol="stack_probability", predictionCol="stack_prediction", rawPredictionCol="stack_raw", **weight)
    return Pipeline(stages=[va, lr]).fit(oof)


def ml_ensembles(train: DataFrame, test: DataFrame, fits: dict, k: int = 5, iters: int = 1000) -> DataFrame:
    """``test`` with P(Passed) of every model and of the greedy and stacked ensembles, all fitted
    on ``train`` only (weights on its out-of-fold predictions, models on all of it)."""
    y = (F.col(LABEL) == POSITIVE).cast("double")
    oof, (models, rows) = _oof(train, fits, k, 5, whole=True)
    oof = shared_table(oof.withColumn("y", y), "oof")
    names = list(fits)
    weights = ml_greedy_ensemble(oof, names, "y", iters)[: len(names)]
    stack = ml_stack(oof, names, "y")
    scored = ml_predict_proba(_fit_all({n: f for n, f in fits.items() if n not in models}, train), test)
    if models:
        scored = S.scored(scored, rows, {n: [m] for n, m in models.items()}).select(*test.columns, *names)
    scored = ml_blend(scored, dict(zip(names, weights)))
    keep = scored.columns
    return stack.transform(scored).select(*keep, vector_to_array("stack_probability")[1].alias("stacked"))
