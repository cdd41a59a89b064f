"""Registered ML queries (survey §2.11).  Deterministic ones (splits, z-scores,
rank AUC of a feature) have oracle SQL; model fits are checked by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.session import shared_table

from caseflow.plans import bagging as BG
from caseflow.plans import evaluate as EV
from caseflow.plans import gain_ratio as G
from caseflow.plans import inference_boost as B
from caseflow.plans import linear as L
from caseflow.plans import ml as M
from caseflow.plans import pruning as P
from caseflow.plans.naive_bayes import ml_naive_bayes
from caseflow.plans.neighbours import ml_knn
from caseflow.plans.catalog import BILL_FEATURES_SQL, q_bill_features, r6, register
from caseflow.plans.catalog_relational import with_ctes

_BF = {"bf": BILL_FEATURES_SQL}
MODEL_COLS = ["bill_id", "no_days", "party", "ac_count", "state", "status"]


def model_table(spark, d):
    """The model table, written once per query (it feeds many passes)."""
    return shared_table(q_bill_features(spark, d).select(*MODEL_COLS), "model-table")


def _split_sql(p: float, seed: int) -> str:
    t = M.hash_threshold(p)
    return with_ctes(f"""
SELECT bill_id, no_days, party, ac_count, state, status,
       CASE WHEN substr(md5(coalesce(CAST(bill_id AS VARCHAR), '') || '|' || '{seed}'), 1, 8) < '{t}'
            THEN 'train' ELSE 'test' END AS split
FROM bf""", **_BF)


STRATIFIED_SQL = """
SELECT bf.bill_id, no_days, party, ac_count, state, bf.status,
       CASE WHEN r.pos <= ceil(r.n * 0.85) THEN 'train' ELSE 'test' END AS split
FROM bf JOIN (
  SELECT bill_id, status, count(*) OVER (PARTITION BY status) AS n,
         row_number() OVER (PARTITION BY status ORDER BY md5(CAST(bill_id AS VARCHAR) || '|42'), CAST(bill_id AS VARCHAR)) AS pos
  FROM (SELECT DISTINCT bill_id, status FROM bf) keys) r ON r.bill_id = bf.bill_id AND r.status = bf.status"""


@register("ml_stratified_split", with_ctes(STRATIFIED_SQL, **_BF), ctes=False)
def q_ml_stratified_split(spark, d):
    return M.ml_stratified_labels(model_table(spark, d), 0.85, 42)


@register("ml_stratified_folds", with_ctes("""
SELECT bf.bill_id, no_days, party, ac_count, state, bf.status, CAST((r.pos - 1) % 10 AS INT) AS fold
FROM bf JOIN (
  SELECT bill_id, status, row_number() OVER (PARTITION BY status ORDER BY md5(CAST(bill_id AS VARCHAR) || '|11'), CAST(bill_id AS VARCHAR)) AS pos
  FROM (SELECT DISTINCT bill_id, status FROM bf) keys) r ON r.bill_id = bf.bill_id AND r.status = bf.status""", **_BF), ctes=False)
def q_ml_stratified_folds(spark, d):
    return M.ml_stratified_folds(model_table(spark, d), 10, 11)


@register("ml_bernoulli_split", _split_sql(0.66, 7), ctes=False)
def q_ml_bernoulli_split(spark, d):
    return M.ml_split(q_bill_features(spark, d).select(*MODEL_COLS), 0.66, 7)


@register("ml_center_scale", with_ctes("""
SELECT bill_id, no_days, ac_count,
       round((no_days - (SELECT avg(no_days) FROM bf)) / (SELECT stddev_samp(no_days) FROM bf), 6) AS no_days_z,
       round((ac_count - (SELECT avg(ac_count) FROM bf)) / (SELECT stddev_samp(ac_count) FROM bf), 6) AS ac_count_z
FROM bf""", **_BF), ctes=False)
def q_ml_center_scale(spark, d):
    bf = q_bill_features(spark, d).select("bill_id", "no_days", "ac_count")
    return r6(M.ml_center_scale(bf), "no_days_z", "ac_count_z")


def _auc_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS model, round(sum(npos * (below + 0.5 * nneg)) / (sum(npos) * sum(nneg)), 6) AS auc FROM (
  SELECT s, npos, nneg, coalesce(sum(nneg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT CAST({col} AS DOUBLE) AS s, sum(CASE WHEN status = 'Passed' THEN 1 ELSE 0 END) AS npos,
               sum(CASE WHEN status = 'Passed' THEN 0 ELSE 1 END) AS nneg FROM bf GROUP BY 1) g) c"""


@register("ml_roc_auc", with_ctes(f"SELECT auc FROM ({_auc_sql('ac_count')}) a", **_BF), ctes=False)
def q_ml_roc_auc(spark, d):
    bf = q_bill_features(spark, d)
    return r6(EV.ml_roc_auc(bf, "ac_count", F.col("status") == "Passed"), "auc")


@register("ml_col_auc", with_ctes(_auc_sql("ac_count") + " UNION ALL " + _auc_sql("no_days"), **_BF), ctes=False)
def q_ml_col_auc(spark, d):
    bf = q_bill_features(spark, d)
    return r6(EV.ml_col_auc(bf, ["ac_count", "no_days"], F.col("status") == "Passed"), "auc")


# --- evaluation of a fixed score: p = ac_count / 7 (at most 1), the other q = no_days / 200 -------------

_SCORED = """SELECT *, least(1.0, ac_count / 7.0) AS p, least(1.0, no_days / 200.0) AS q,
  CASE WHEN ac_count >= 4 THEN 'Passed' ELSE 'REFERRED' END AS predicted,
  CAST('0x' || substr(md5(CAST(bill_id AS VARCHAR) || '|5'), 1, 8) AS BIGINT) % 5 AS fold FROM bf"""
_SC = {"bf": BILL_FEATURES_SQL, "sc": _SCORED}


def scored(spark, d):
    bf = q_bill_features(spark, d).select(*MODEL_COLS)
    p, q = (F.least(F.lit(1.0), F.col(c) / F.lit(n)) for c, n in (("ac_count", 7.0), ("no_days", 200.0)))
    pred = F.when(F.col("ac_count") >= 4, F.lit("Passed")).otherwise(F.lit("REFERRED"))
    return M.fold_column(bf.select("*", p.alias("p"), q.alias("q"), pred.alias("predicted"), F.col("status").alias("actual")), 5, 5)


@register("ml_confusion", with_ctes("""
SELECT predicted, count(*) FILTER (WHERE status = 'Passed') AS "Passed", count(*) FILTER (WHERE status = 'REFERRED') AS "REFERRED"
FROM sc GROUP BY predicted""", **_SC), ctes=False)
def q_ml_confusion(spark, d):
    return EV.ml_confusion(scored(spark, d))


@register("ml_confusion_stats", with_ctes("""
SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa,
       round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv,
       round(tn / (tn + fn), 6) AS npv, round((tp + fn) / n, 6) AS prevalence, round(tp / n, 6) AS detection_rate,
       round((tp + fp) / n, 6) AS detection_prevalence, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy
FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (
  SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (predicted = 'Passed' AND status = 'Passed') AS tp,
         count(*) FILTER (predicted = 'Passed' AND status <> 'Passed') AS fp, count(*) FILTER (predicted <> 'Passed' AND status = 'Passed') AS fn,
         count(*) FILTER (predicted <> 'Passed' AND status <> 'Passed') AS tn FROM sc) c) k""", **_SC), ctes=False)
def q_ml_confusion_stats(spark, d):
    out = EV.ml_confusion_stats(scored(spark, d))
    return r6(out, *out.columns[4:])


_CELLS = """SELECT CAST(count(*) FILTER ((predicted = 'Passed') = (status = 'Passed')) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS n,
  CAST(greatest(count(*) FILTER (status = 'Passed'), count(*) FILTER (status <> 'Passed')) AS DOUBLE) AS most,
  CAST(count(*) FILTER (predicted = 'Passed' AND status <> 'Passed') AS DOUBLE) AS fp, CAST(count(*) FILTER (predicted <> 'Passed' AND status = 'Passed') AS DOUBLE) AS fn FROM sc"""


def _tail_sql(p: str, first: str, last: str) -> str:
    """Probability of first to last hits in n trials, as the sum of its terms."""
    return f"""(SELECT coalesce(sum(exp(lgamma(c.n + 1) - lgamma(i + 1) - lgamma(c.n - i + 1) + i * ln({p}) + (c.n - i) * ln(1 - ({p})))), 0)
    FROM (SELECT unnest(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1)) AS i) r)"""


#: The normal tail by its series of positive terms: 1 - 2 phi(z) (z + z^3 / 3 + z^5 / 15 + ...).
_NORMAL_SQL = """CASE WHEN z > 12 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(400),
  lambda i: exp(-z * z / 2 + (2 * i + 1) * ln(greatest(z, 1e-300)) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))))) END"""


@register("ml_confusion_tests", with_ctes(f"""
SELECT round(hits / n, 6) AS accuracy, round((SELECT lo FROM bis WHERE side = 'low' AND step = 32), 6) AS accuracy_low,
       round((SELECT lo FROM bis WHERE side = 'high' AND step = 32), 6) AS accuracy_high, round(most / n, 6) AS no_information_rate,
       round({_tail_sql("c.most / c.n", "c.hits", "c.n")}, 6) AS p_above_nir, round({_NORMAL_SQL}, 6) AS p_mcnemar
FROM (SELECT *, greatest(abs(fp - fn) - 1, 0) / sqrt(nullif(fp + fn, 0)) AS z FROM cells) c""", **_SC, cells=_CELLS, **{
    "bis(side, step, lo, hi)": f"""
SELECT side, 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM (VALUES ('low'), ('high')) s(side)
UNION ALL
SELECT side, step + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
  SELECT b.*, (lo + hi) / 2 AS mid, CASE side
      WHEN 'low' THEN {_tail_sql("(b.lo + b.hi) / 2", "c.hits", "c.n")} < 0.025
      ELSE {_tail_sql("(b.lo + b.hi) / 2", "0", "c.hits")} > 0.025 END AS below
  FROM bis b, cells c WHERE step < 32) x"""}).replace("WITH", "WITH RECURSIVE", 1), ctes=False)
def q_ml_confusion_tests(spark, d):
    out = EV.ml_confusion_tests(scored(spark, d))
    return r6(out, *out.columns)


@register("ml_rmse", with_ctes("SELECT round(sqrt(avg(pow(p - CASE status WHEN 'Passed' THEN 1 ELSE 0 END, 2))), 6) AS rmse FROM sc", **_SC), ctes=False)
def q_ml_rmse(spark, d):
    return r6(EV.ml_rmse(scored(spark, d).withColumn("y", (F.col("actual") == "Passed").cast("double")), "p", "y"), "rmse")


_SUMMARY = ", ".join(f"round(quantile_cont(value, {x}), 6) AS {n}" for n, x in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)))


@register("ml_resamples", with_ctes(f"""
SELECT model, metric, {_SUMMARY}, round(avg(value), 6) AS mean FROM (
  SELECT model, fold, 'auc' AS metric, sum(npos * (below + 0.5 * nneg)) / (sum(npos) * sum(nneg)) AS value FROM (
    SELECT *, coalesce(sum(nneg) OVER (PARTITION BY model, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT model, fold, s, count(*) FILTER (status = 'Passed') AS npos, count(*) FILTER (status <> 'Passed') AS nneg FROM long GROUP BY ALL) g) c
  GROUP BY ALL
  UNION ALL
  SELECT model, fold, unnest(['accuracy', 'kappa']) AS metric, unnest([acc, (acc - pe) / (1 - pe)]) AS value FROM (
    SELECT model, fold, avg(CASE WHEN (s >= 0.5) = (status = 'Passed') THEN 1.0 ELSE 0.0 END) AS acc,
           avg(CAST(s >= 0.5 AS INT)) * avg(CAST(status = 'Passed' AS INT))
           + (1 - avg(CAST(s >= 0.5 AS INT))) * (1 - avg(CAST(status = 'Passed' AS INT))) AS pe
    FROM long GROUP BY ALL) k) m
GROUP BY model, metric""", **_SC, long="""
SELECT 'p' AS model, fold, status, CAST(p AS DOUBLE) AS s FROM sc UNION ALL SELECT 'q', fold, status, CAST(q AS DOUBLE) FROM sc"""), ctes=False)
def q_ml_resamples(spark, d):
    out = EV.ml_resamples(EV.fold_metrics(shared_table(scored(spark, d), "scored"), ["p", "q"], F.col("actual") == "Passed"))
    return r6(out, "min", "q1", "median", "mean", "q3", "max")


#: Student's quantile for five folds (four degrees of freedom, 95 %): fixed value.
_T4 = 2.7764451051977987


@register("ml_resample_intervals", with_ctes(f"""
SELECT model, metric, round(m, 6) AS mean, round(m - h, 6) AS low, round(m + h, 6) AS high FROM (
  SELECT model, metric, avg(value) AS m, {_T4} * stddev_samp(value) / sqrt(count(*)) AS h FROM (
    SELECT model, fold, unnest(['accuracy', 'kappa']) AS metric, unnest([acc, (acc - pe) / (1 - pe)]) AS value FROM (
      SELECT model, fold, avg(CASE WHEN (s >= 0.5) = (status = 'Passed') THEN 1.0 ELSE 0.0 END) AS acc,
             avg(CAST(s >= 0.5 AS INT)) * avg(CAST(status = 'Passed' AS INT))
             + (1 - avg(CAST(s >= 0.5 AS INT))) * (1 - avg(CAST(status = 'Passed' AS INT))) AS pe
      FROM (SELECT 'p' AS model, fold, status, CAST(p AS DOUBLE) AS s FROM sc UNION ALL SELECT 'q', fold, status, CAST(q AS DOUBLE) FROM sc) l GROUP BY ALL) k) v
  GROUP BY ALL) g""", **_SC), ctes=False)
def q_ml_resample_intervals(spark, d):
    """Student intervals of the fold metrics."""
    folds = EV.fold_metrics(shared_table(scored(spark, d), "scored"), ["p", "q"], F.col("actual") == "Passed").where("metric <> 'auc'")
    return r6(EV.ml_resample_intervals(folds), "mean", "low", "high")


@register("ml_rank_models", with_ctes("SELECT * FROM (" + _auc_sql("ac_count") + " UNION ALL " + _auc_sql("no_days") + ") a ORDER BY auc DESC, model", **_BF), ctes=False)
def q_ml_rank_models(spark, d):
    bf = q_bill_features(spark, d)
    return r6(EV.rank_models(EV.ml_col_auc(bf, ["ac_count", "no_days"], F.col("status") == "Passed")), "auc")


_NB_LEVEL = """ln((coalesce({c}.pos, 0) + 1) / (k.np + (SELECT count(*) FROM {c}_levels)))
  - ln((coalesce({c}.neg, 0) + 1) / (k.nn + (SELECT count(*) FROM {c}_levels)))"""
_NB_NUM = "(-0.5 * ln(k.vp_{c}) - pow(t.{c} - k.mp_{c}, 2) / (2 * k.vp_{c})) - (-0.5 * ln(k.vn_{c}) - pow(t.{c} - k.mn_{c}, 2) / (2 * k.vn_{c}))"
_NB_STATS = ", ".join(f"{fn}({c}) FILTER (status {op} 'Passed') AS {a}{side}_{c}" for c in M.NUM_COLS
                      for fn, a in (("avg", "m"), ("var_samp", "v")) for op, side in (("=", "p"), ("<>", "n")))


@register("ml_naive_bayes", with_ctes(f"""
SELECT t.bill_id, t.no_days, t.party, t.ac_count, t.state,
       round(1 / (1 + exp(-(ln(k.np) - ln(k.nn) + {' + '.join(_NB_NUM.format(c=c) for c in M.NUM_COLS)}
         + {' + '.join(_NB_LEVEL.format(c=c) for c in M.CAT_COLS)}))), 6) AS p_positive
FROM split t LEFT JOIN party_levels party ON party.party = t.party LEFT JOIN state_levels state ON state.state = t.state,
     (SELECT CAST(count(*) FILTER (status = 'Passed') AS DOUBLE) AS np, CAST(count(*) FILTER (status <> 'Passed') AS DOUBLE) AS nn, {_NB_STATS}
      FROM split WHERE split = 'train') k
WHERE t.split = 'test'""", **_BF, split=STRATIFIED_SQL, **{
    f"{c}_levels": f"SELECT {c}, count(*) FILTER (status = 'Passed') AS pos, count(*) FILTER (status <> 'Passed') AS neg FROM split WHERE split = 'train' GROUP BY {c}"
    for c in M.CAT_COLS}), ctes=False)
def q_ml_naive_bayes(spark, d):
    train, test = _train_test(spark, d)
    model = ml_naive_bayes(train, M.NUM_COLS, M.CAT_COLS, "status", "Passed")
    return r6(model.score(test.drop("status")), "p_positive")


@register("ml_knn", with_ctes("""
SELECT t.bill_id, t.no_days, t.ac_count, round(s.share, 6) AS p_positive
FROM split t JOIN (
  SELECT no_days, ac_count, sum(p) / sum(n) AS share FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY no_days, ac_count ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT a.no_days, a.ac_count, round(pow((a.no_days - b.no_days) / z.sd, 2) + pow((a.ac_count - b.ac_count) / z.sa, 2), 9) AS d, sum(b.n) AS n, sum(b.p) AS p
      FROM (SELECT DISTINCT no_days, ac_count FROM split WHERE split = 'test') a,
           (SELECT no_days, ac_count, count(*) AS n, count(*) FILTER (status = 'Passed') AS p FROM split WHERE split = 'train' GROUP BY ALL) b,
           (SELECT stddev_samp(no_days) AS sd, stddev_samp(ac_count) AS sa FROM split WHERE split = 'train') z
      GROUP BY ALL) r) c
  WHERE before < 5 GROUP BY ALL) s ON s.no_days = t.no_days AND s.ac_count = t.ac_count
WHERE t.split = 'test'""", **_BF, split=STRATIFIED_SQL), ctes=False)
def q_ml_knn(spark, d):
    train, test = _train_test(spark, d)
    return r6(ml_knn(train, test.select("bill_id", "no_days", "ac_count"), ["no_days", "ac_count"], "status", "Passed", 5), "p_positive")


# --- model fits: rows-only checks ----------------------------------------------------

def _train_test(spark, d):
    return M.ml_stratified_split(model_table(spark, d), 0.85, 42)


def _predictions(spark, d, fit):
    train, test = _train_test(spark, d)
    return M.ml_predict(fit(train), test, keep=["bill_id"])


@register("ml_tree")
def q_ml_tree(spark, d):
    return _predictions(spark, d, M.ml_tree)


@register("ml_predict")
def q_ml_predict(spark, d):
    """Batch scoring of records without an outcome (label, P(Passed), message)."""
    train, test = _train_test(spark, d)
    return M.ml_predict(M.ml_tree(train), test.drop("status"), keep=["bill_id"])


@register("ml_entropy_tree")
def q_ml_entropy_tree(spark, d):
    """Hold-out predictions of the gain-ratio tree, pruned."""
    return _predictions(spark, d, G.ml_gain_ratio_tree)


def _bits(*counts: str) -> str:
    n = " + ".join(counts)
    return "-(" + " + ".join(f"CASE WHEN {c} > 0 THEN ({c}) / ({n}) * log2(({c}) / ({n})) ELSE 0 END" for c in counts) + ")"


def _gain_ratio_ctes(k: int, rows: str) -> dict[str, str]:
    """CTEs up to ``s{k}``: the chosen split of every path of ``rows`` (path and the columns of the model table)."""
    counts = "CAST(count(*) FILTER (status = 'Passed') AS DOUBLE) AS c0, CAST(count(*) FILTER (status <> 'Passed') AS DOUBLE) AS c1"
    nums = " UNION ALL ".join(f"SELECT path, '{c}' AS attribute, CAST({c} AS DOUBLE) AS v, {counts} FROM nd{k} GROUP BY path, {c}" for c in M.NUM_COLS)
    cats = " UNION ALL ".join(f"SELECT path, '{c}' AS attribute, {c} AS level, {counts} FROM nd{k} GROUP BY path, {c}" for c in M.CAT_COLS)
    return {
        f"nd{k}": rows,
        f"num{k}": f"""
SELECT *, t0 - b0 AS a0, t1 - b1 AS a1, t0 + t1 AS n FROM (
  SELECT *, sum(c0) OVER w AS b0, sum(c1) OVER w AS b1, sum(c0) OVER p AS t0, sum(c1) OVER p AS t1, max(v) OVER p AS top, count(*) OVER p - 1 AS cuts
  FROM ({nums}) u WHERE v IS NOT NULL WINDOW p AS (PARTITION BY path, attribute), w AS (PARTITION BY path, attribute ORDER BY v)) x""",
        f"cut{k}": f"""
SELECT *, row_number() OVER (PARTITION BY path, attribute ORDER BY round(gain, 9) DESC, v) AS pos FROM (
  SELECT path, attribute, v, {_bits("b0 + b1", "a0 + a1")} AS info,
         {_bits("t0", "t1")} - (b0 + b1) / n * ({_bits("b0", "b1")}) - (a0 + a1) / n * ({_bits("a0", "a1")}) - log2(greatest(cuts, 1)) / n AS gain
  FROM num{k} WHERE v < top AND b0 + b1 >= 2 AND a0 + a1 >= 2) y""",
        f"cat{k}": f"""
SELECT path, attribute, count(*) AS branches, {_bits("sum(c0)", "sum(c1)")} - sum((c0 + c1) * ({_bits("c0", "c1")})) / sum(c0 + c1) AS gain,
       log2(sum(c0 + c1)) - sum((c0 + c1) * log2(c0 + c1)) / sum(c0 + c1) AS info
FROM ({cats}) u WHERE level IS NOT NULL GROUP BY path, attribute HAVING count(*) FILTER (c0 + c1 >= 2) >= 2""",
        f"s{k}": f"""
SELECT path, attribute, threshold, CAST(branches AS INT) AS branches, gain, gain / info AS ratio, (SELECT count(*) FROM nd{k} r WHERE r.path = z.path) AS cases FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain >= mean - 1e-9 DESC, round(gain / info, 9) DESC, attribute) AS pos FROM (
    SELECT *, avg(gain) OVER (PARTITION BY path) AS mean FROM (
      SELECT path, attribute, v AS threshold, 2 AS branches, gain, info FROM cut{k} WHERE pos = 1
      UNION ALL SELECT path, attribute, NULL, branches, gain, info FROM cat{k}) o
    WHERE gain > 1e-9 AND info > 0) m) z
WHERE pos = 1"""}


_CHILD = "CASE s.attribute " + " ".join(
    f"WHEN '{c}' THEN '{c}' || CASE WHEN {c} <= s.threshold THEN '<=' ELSE '>' END || CAST(CAST(s.threshold AS BIGINT) AS VARCHAR)" for c in M.NUM_COLS) + " " + " ".join(
    f"WHEN '{c}' THEN '{c}=' || {c}" for c in M.CAT_COLS) + " END"


@register("ml_gain_ratio_splits", with_ctes("""
SELECT path, attribute, threshold, branches, round(gain, 6) AS gain, round(ratio, 6) AS ratio, cases FROM s0
UNION ALL SELECT path, attribute, threshold, branches, round(gain, 6), round(ratio, 6), cases FROM s1""", **_BF,
    **_gain_ratio_ctes(0, "SELECT '' AS path, * FROM bf"), **_gain_ratio_ctes(1, f"SELECT {_CHILD} AS path, bf.* FROM bf, s0 s")), ctes=False)
def q_ml_gain_ratio_splits(spark, d):
    """The splits of the first two levels, unpruned."""
    return r6(G.splits_table(G.grow(model_table(spark, d), max_depth=2), spark), "gain", "ratio")


@register("ml_gbm")
def q_ml_gbm(spark, d):
    return _predictions(spark, d, M.ml_gbm)


@register("ml_random_forest")
def q_ml_random_forest(spark, d):
    return _predictions(spark, d, M.ml_random_forest)


def _copies_sql(tree: int) -> str:
    h = f"substr(md5(coalesce(CAST(bill_id AS VARCHAR), '') || '|{tree}|1'), 1, 8)"
    return "(" + " + ".join(f"CAST({h} >= '{b}' AS INT)" for b in BG.POISSON) + ")"


@register("ml_bags", with_ctes("SELECT bill_id, " + " + ".join(f"CAST({_copies_sql(t)} > 0 AS INT)" for t in range(10)) + " AS in_bag, "
                               + " + ".join(_copies_sql(t) for t in range(10)) + " AS copies FROM (SELECT DISTINCT bill_id FROM bf) k", **_BF), ctes=False)
def q_ml_bags(spark, d):
    """Bag membership of every bill in ten trees."""
    return BG.ml_bags(q_bill_features(spark, d), 10)


@register("ml_oob_error")
def q_ml_oob_error(spark, d):
    """Out-of-bag error by number of trees."""
    train, _ = _train_test(spark, d)
    return BG.ml_oob_error(BG.ml_bagging(train), train)


@register("ml_permutation_importance")
def q_ml_permutation_importance(spark, d):
    train, _ = _train_test(spark, d)
    return BG.ml_permutation_importance(BG.ml_bagging(train), train)


@register("ml_logit")
def q_ml_logit(spark, d):
    return _predictions(spark, d, M.ml_logit)


@register("ml_elastic_net")
def q_ml_elastic_net(spark, d):
    return _predictions(spark, d, L.ml_elastic_net)


@register("ml_elastic_net_path")
def q_ml_elastic_net_path(spark, d):
    """Penalties of the path with the features in and the deviance explained."""
    train, _ = _train_test(spark, d)
    return L.ml_elastic_net_path(train).table(spark)


@register("ml_mlp")
def q_ml_mlp(spark, d):
    """Hold-out predictions of the network with weight decay."""
    return _predictions(spark, d, L.ml_network)


@register("ml_svm")
def q_ml_svm(spark, d):
    """Hold-out predictions with probabilities."""
    return _predictions(spark, d, M.ml_svm)


@register("ml_adaboost")
def q_ml_adaboost(spark, d):
    train, test = _train_test(spark, d)
    return M.adaboost_predict(M.ml_adaboost(train), test, ["bill_id", "status"])


def _eta_sql(col: str) -> str:
    """Sum-of-squares form of the association of a category with the class."""
    return f"""
SELECT '{col}' AS variable, CAST(greatest(count(DISTINCT {col}) - 1, 0) AS INT) AS df,
       coalesce(round((count(*) - 1) * sum(pow(level_mean - total_mean, 2)) / nullif(sum(pow(y - total_mean, 2)), 0), 6), 0.0) AS statistic
FROM (SELECT {col}, y, avg(y) OVER (PARTITION BY {col}) AS level_mean, avg(y) OVER () AS total_mean FROM lab WHERE {col} IS NOT NULL) v"""


def _correlation_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS variable, 1 AS df, round((count({col}) - 1) * pow(corr(CAST({col} AS DOUBLE), y), 2), 6) AS statistic FROM lab"""


@register("ml_association", with_ctes(" UNION ALL ".join(
    [_correlation_sql(c) for c in M.NUM_COLS] + [_eta_sql(c) for c in M.CAT_COLS]),
    bf=BILL_FEATURES_SQL, lab="SELECT *, CASE WHEN status = 'Passed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM bf WHERE status IS NOT NULL"), ctes=False)
def q_ml_association(spark, d):
    """How strongly every variable is associated with the outcome: the first test of the boosted stumps."""
    return r6(B.ml_association(model_table(spark, d)), "statistic")


@register("ml_inference_boost")
def q_ml_inference_boost(spark, d):
    return _predictions(spark, d, B.ml_inference_boost)


@register("ml_cv")
def q_ml_cv(spark, d):
    train, _ = _train_test(spark, d)
    return M.ml_cv(train, k=10, repeats=5)


@register("ml_cp_table")
def q_ml_cp_table(spark, d):
    train, _ = _train_test(spark, d)
    return P.ml_cp_table(train)


@register("ml_pruned_tree")
def q_ml_pruned_tree(spark, d):
    """Hold-out predictions of the tree pruned to the cross-validated complexity."""
    return _predictions(spark, d, P.ml_pruned_tree)


def _naive_bayes(train):
    return ml_naive_bayes(train, M.NUM_COLS, M.CAT_COLS, M.LABEL, M.POSITIVE)


#: The learners whose probabilities are compared and combined.
FITS = {"tree": M.ml_tree, "logit": M.ml_logit, "forest": M.ml_random_forest, "boosted": M.ml_gbm, "svm": M.ml_svm,
        "naive_bayes": _naive_bayes, "nearest": M.ml_nearest, "network": L.ml_network, "elastic_net": L.ml_elastic_net,
        "inference_boost": lambda train: B.ml_inference_boost(train, steps=30, rate=0.3)}  # six fits in one query


#: The learners of the queries that fit every fold but do not rank all: the three quickest.
QUICK = {n: FITS[n] for n in ("tree", "logit", "forest")}


@register("ml_oof")
def q_ml_oof(spark, d):
    train, _ = _train_test(spark, d)
    return M.ml_oof(train, QUICK)


@register("ml_predict_proba")
def q_ml_predict_proba(spark, d):
    train, test = _train_test(spark, d)
    return M.ml_predict_proba({n: fit(train) for n, fit in FITS.items()}, test)


def _mean_sse(a: str, b: str) -> str:
    """Squared error of (a p + b q) / (a + b) from the sums of products."""
    return f"(yy - 2 * ({a} * py + {b} * qy) / ({a} + {b}) + ({a} * {a} * pp + 2 * {a} * {b} * pq + {b} * {b} * qq) / (({a} + {b}) * ({a} + {b})))"


@register("ml_greedy_ensemble", with_ctes(f"""
SELECT m.model, round(CASE m.model WHEN 'p' THEN a / (a + b) WHEN 'q' THEN b / (a + b) ELSE sqrt(greatest({_mean_sse('a', 'b')}, 0) / n) END, 6) AS value
FROM (WITH RECURSIVE steps(i, a, b) AS (
        SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
        UNION ALL
        SELECT i + 1, CASE WHEN takes_q THEN a ELSE a + 1 END, CASE WHEN takes_q THEN b + 1 ELSE b END
        FROM (SELECT i, a, b, {_mean_sse('a', '(b + 1)')} < {_mean_sse('(a + 1)', 'b')} - 1e-15 AS takes_q FROM steps, products WHERE i < 1000) o)
      SELECT a, b FROM steps WHERE i = 1000) last_step, products, (VALUES ('p'), ('q'), ('rmse')) m(model)""", **_SC, products="""
SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, sum(y * y) AS yy, count(*) AS n
FROM (SELECT p, q, CASE status WHEN 'Passed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM sc) v"""), ctes=False)
def q_ml_greedy_ensemble(spark, d):
    """Greedy weights over the two fixed scores of the evaluation queries."""
    y = scored(spark, d).withColumn("y", (F.col("actual") == "Passed").cast("double"))
    w = M.ml_greedy_ensemble(y, ["p", "q"], "y", iters=1000)
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip(["p", "q", "rmse"], w)], "model string, value double")


@register("ml_stack")
def q_ml_stack(spark, d):
    """Hold-out rows with every model's P(Passed) and the greedy and stacked ensembles, fitted on the training rows."""
    train, test = _train_test(spark, d)
    return M.ml_ensembles(train, test, QUICK)


@register("ml_holdout_auc")
def q_ml_holdout_auc(spark, d):
    """AUC of every single model and ensemble on the hold-out rows."""
    train, test = _train_test(spark, d)
    out = shared_table(M.ml_ensembles(train, test, FITS), "holdout")
    return EV.rank_models(EV.ml_col_auc(out, [*FITS, "greedy", "stacked"], F.col("status") == "Passed"))


@register("ml_nb_counts", with_ctes("""
SELECT status, 'party' AS feature, party AS level, count(*) AS cnt FROM bf GROUP BY status, party
UNION ALL
SELECT status, 'state' AS feature, state AS level, count(*) AS cnt FROM bf GROUP BY status, state
""", **_BF), ctes=False)
def q_ml_nb_counts(spark, d):
    """The categorical naive-Bayes count table: rows per (class, feature, level)."""
    return EV.nb_counts(q_bill_features(spark, d), ["party", "state"], "status")
