"""Registered queries for the relational, aggregate, window, sort, scalar and
statistics operators (survey §2.1–2.8), each with its oracle SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import exprs as X
from caseflow.operators import aggregates as A
from caseflow.operators import relational as R
from caseflow.operators import stats as S
from caseflow.operators import windows as W
from caseflow.plans import process as P
from caseflow.plans.catalog import (BILL_FEATURES_SQL, BINDING_CTES, CHAMBER, M_HI, M_LO, PARTY,
                                    REJECT, STATE, TIE_SQL, TIMELINE_BILL, YEAR, T,
                                    TRANSITIONS_FILTERED_SQL, _lead_sql, _topk_sql, best_sql, monthly_sql,
                                    outcome_sql, q_bill_features, q_topk_monthly, r6, register)
from caseflow.session import shared_table
from caseflow.sources.tables import scan_all, TEST_PASS_MARKERS, TEST_REFERRAL_TYPE, TEST_TIEBREAK, TEST_TYPES

TB = list(TEST_TIEBREAK)


def with_ctes(body: str, **ctes: str) -> str:
    """Binding CTEs plus extra named CTEs, then ``body``."""
    extra = "".join(f", {k} AS ({v})" for k, v in ctes.items())
    return BINDING_CTES + extra + "\n" + body


# --- 2.1 sources ---------------------------------------------------------------

@register("scan_all", "SELECT * FROM bills")
def q_scan_all(spark, d):
    T(spark, d).bills.createOrReplaceTempView("caseflow_scan_all_bills")
    return scan_all(spark, "caseflow_scan_all_bills")


@register("sql_params", TRANSITIONS_FILTERED_SQL)
def q_sql_params(spark, d):
    """Parameterised SQL with typed named parameters and DataFrame arguments (no
    temp views, no pasted strings); the steps come from the operator that splits heavy bills."""
    t = T(spark, d)
    picked = spark.sql("""
SELECT b.id, count(*) AS w
FROM {bills} b JOIN {sponsors} s ON s.bill_id = b.id JOIN {members} m ON m.bioguideid = s.sponsor_id
WHERE m.party = :party AND m.state = :state AND b.originchamber = :chamber
GROUP BY b.id""", args={"party": PARTY, "state": STATE, "chamber": CHAMBER}, bills=t.bills, sponsors=t.sponsors, members=t.members)
    # written: rows joined to a plain table are split where a bill is heavy, rows joined to an aggregate are not
    picked = shared_table(picked, "picked-bills")
    steps = W.lead_step(t.actions_lean.select("bill_id", "action_date", "type", *TB), tiebreak=TB)
    return spark.sql("""
WITH gaps AS (
  SELECT type, next_type, w, datediff(next_row, action_date) AS days
  FROM {steps} JOIN {picked} ON id = bill_id WHERE next_type IS NOT NULL)
SELECT type, next_type, round(sum(days * w) / sum(if(days IS NULL, NULL, w)), 6) AS no_days
FROM gaps GROUP BY type, next_type""", steps=steps, picked=picked)


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
          ctes=False)
def q_json_props(spark, d):
    from caseflow.sources.tables import raw_table
    e = raw_table(spark, d, "events")
    return e.select("event_id", X.f_from_json("props", "k INT").getField("k").alias("k"))


# --- 2.2 projections and filters ---------------------------------------------------

@register("project", "SELECT id, bill_type, originchamber FROM bills")
def q_project(spark, d):
    return R.project(T(spark, d).bills, ["id", "bill_type", "originchamber"])


@register("select_by_name", f"SELECT no_days, party, ac_count, state, status FROM ({BILL_FEATURES_SQL}) bf")
def q_select_by_name(spark, d):
    return R.select_by_name(q_bill_features(spark, d))


@register("drop_col", f"SELECT no_days, party, ac_count, state FROM ({BILL_FEATURES_SQL}) bf")
def q_drop_col(spark, d):
    return R.drop_col(q_select_by_name(spark, d), "status")


@register("rename_cols", f"SELECT no_days AS days, party, ac_count AS actions, state, status FROM ({BILL_FEATURES_SQL}) bf")
def q_rename_cols(spark, d):
    return R.rename_cols(q_select_by_name(spark, d), {"no_days": "days", "ac_count": "actions"})


@register("reorder_cols", f"SELECT dt, name, cnt FROM ({_topk_sql()}) tk")
def q_reorder_cols(spark, d):
    return R.reorder_cols(q_topk_monthly(spark, d), [2, 1, 3])


@register("filter_eq", f"SELECT * FROM actions WHERE bill_id = {TIMELINE_BILL} ORDER BY action_code")
def q_filter_eq(spark, d):
    return R.filter_eq(T(spark, d).actions, "bill_id", TIMELINE_BILL).orderBy("action_code")


@register("filter_contains_ci", f"SELECT text FROM actions WHERE upper(text) LIKE '%{REJECT}%'")
def q_filter_contains_ci(spark, d):
    return R.filter_contains_ci(T(spark, d).actions, "text", REJECT).select("text")


@register("filter_like_empty", "SELECT bill_id, line_no, part_id FROM actions WHERE line_no = 7 OR text LIKE ''")
def q_filter_like_empty(spark, d):
    a = T(spark, d).actions
    blank = a.withColumn("text", F.when(F.col("line_no") == 7, F.lit("")).otherwise(F.col("text")))
    return R.filter_like_empty(blank, "text").select("bill_id", "line_no", "part_id")


@register("filter_conj", f"""
SELECT bills.id AS bill_id, sponsors.sponsor_id, members.party, members.state, bills.originchamber
FROM bills JOIN sponsors ON sponsors.bill_id = bills.id
JOIN members ON members.bioguideid = sponsors.sponsor_id
WHERE members.party = '{PARTY}' AND members.state = '{STATE}' AND bills.originchamber = '{CHAMBER}'
""")
def q_filter_conj(spark, d):
    t = T(spark, d)
    j = R.join_star(t.bills, t.sponsors, t.members)
    return R.filter_conj(j, party=PARTY, state=STATE, originchamber=CHAMBER).select(
        "bill_id", "sponsor_id", "party", "state", "originchamber")


@register("filter_year_months", f"""
SELECT bill_id, action_date, type FROM actions
WHERE strftime(action_date, '%Y') = '{YEAR}' AND strftime(action_date, '%m') >= lpad('{M_LO}', 2, '0')
  AND strftime(action_date, '%m') <= lpad('{M_HI}', 2, '0')
""")
def q_filter_year_months(spark, d):
    a = T(spark, d).actions_lean
    return R.filter_year_months(a, "action_date", YEAR, M_LO, M_HI).select("bill_id", "action_date", "type")


@register("filter_type_eq", f"SELECT bill_id, action_date, type, committee FROM actions WHERE type = '{TEST_REFERRAL_TYPE}'")
def q_filter_type_eq(spark, d):
    return R.filter_type_eq(T(spark, d).actions_lean, TEST_REFERRAL_TYPE).select(
        "bill_id", "action_date", "type", "committee")


@register("string_agg_by", f"SELECT bill_id, last_types AS joined FROM ({outcome_sql()}) o")
def q_string_agg_by(spark, d):
    a = T(spark, d).actions_lean
    at_max = W.filter_eq_window_max(a, "bill_id", "action_date")
    return A.string_agg_by(at_max, "bill_id", "type", alias="joined")


@register("case_label", f"SELECT bill_id, status FROM ({outcome_sql()}) o")
def q_case_label(spark, d):
    return P.bill_outcomes(T(spark, d).actions_lean, TEST_PASS_MARKERS).select("bill_id", "status")


# markers that span types, are anchored, or hold wildcards: matched against the joined string
HARD_MARKERS = ("%RO%AF%", "NF", "A_ _F%", "%no no")


@register("case_label_markers", f"SELECT bill_id, status FROM ({outcome_sql(HARD_MARKERS)}) o")
def q_case_label_markers(spark, d):
    return P.bill_outcomes(T(spark, d).actions_lean, HARD_MARKERS).select("bill_id", "status")


@register("filter_eq_window_max", """
SELECT a.bill_id, a.action_date, a.type
FROM actions a JOIN (SELECT bill_id, max(action_date) AS action_date FROM actions GROUP BY bill_id) latest
  ON latest.bill_id IS NOT DISTINCT FROM a.bill_id AND latest.action_date = a.action_date
""")
def q_filter_eq_window_max(spark, d):
    a = T(spark, d).actions_lean.select("bill_id", "action_date", "type")
    return W.filter_eq_window_max(a, "bill_id", "action_date")


@register("distinct_col", "SELECT DISTINCT action_code FROM actions")
def q_distinct_col(spark, d):
    return R.distinct_col(T(spark, d).actions_lean, "action_code")


@register("distinct_expr", "SELECT DISTINCT substr(action_code, 1, 1) AS code_initial FROM actions")
def q_distinct_expr(spark, d):
    return R.distinct_col(T(spark, d).actions_lean, X.f_substr("action_code", 1, 1).alias("code_initial"))


@register("unique_sorted", "SELECT DISTINCT state FROM members WHERE state IS NOT NULL ORDER BY state")
def q_unique_sorted(spark, d):
    return R.unique_sorted(T(spark, d).members, "state")


# --- 2.3 joins -----------------------------------------------------------------------

@register("join_inner", "SELECT a.bill_id, a.action_date, a.type, b.bill_type FROM actions a INNER JOIN bills b ON b.id = a.bill_id")
def q_join_inner(spark, d):
    t = T(spark, d)
    b = t.bills.select(F.col("id").alias("bill_id"), "bill_type")
    return R.join_inner(t.actions_lean.select("bill_id", "action_date", "type"), b, "bill_id")


@register("join_comma", f"""
SELECT name, bill_id, action_date FROM committees JOIN actions ON committee = id WHERE type = '{TEST_REFERRAL_TYPE}'
""")
def q_join_comma(spark, d):
    t = T(spark, d)
    a = R.filter_type_eq(t.actions_lean, TEST_REFERRAL_TYPE)
    c = t.committees.select(F.col("id").alias("committee"), "name")
    return a.join(c, "committee").select("name", "bill_id", "action_date")


@register("join_star", """
SELECT bills.id AS bill_id, sponsors.sponsor_id, members.party, members.state
FROM bills JOIN sponsors ON sponsors.bill_id = bills.id JOIN members ON members.bioguideid = sponsors.sponsor_id
""")
def q_join_star(spark, d):
    t = T(spark, d)
    return R.join_star(t.bills, t.sponsors, t.members).select("bill_id", "sponsor_id", "party", "state")


@register("join_agg_subquery", """
SELECT bills.id AS bill_id, bills.bill_type, bills.originchamber, c.ac_count
FROM bills JOIN (SELECT count(*) AS ac_count, bill_id FROM actions GROUP BY bill_id) c ON c.bill_id = bills.id
""")
def q_join_agg_subquery(spark, d):
    t = T(spark, d)
    return R.join_agg_subquery(t.bills, t.actions_lean).select("bill_id", "bill_type", "originchamber", "ac_count")


@register("anti_not_exists", """
SELECT * FROM actions ANTI JOIN (SELECT bill_id FROM actions WHERE text ILIKE '%RED%') red USING (bill_id)
WHERE text ILIKE '%GEAR%'
""")
def q_anti_not_exists(spark, d):
    a = T(spark, d).actions
    return R.anti_not_exists(a, X.f_contains_ci("text", "GEAR"), X.f_contains_ci("text", "RED"))


@register("semi_in_topk", f"""
SELECT c.name, a.bill_id, a.action_date
FROM actions a JOIN committees c ON c.id = a.committee SEMI JOIN ({best_sql()}) best ON best.name = c.name
WHERE a.type = '{TEST_REFERRAL_TYPE}'
""")
def q_semi_in_topk(spark, d):
    rows = q_join_comma(spark, d)
    top = P.top_names(P._named_monthly(T(spark, d).actions_lean, T(spark, d).committees,
                                       TEST_REFERRAL_TYPE), 5)
    return R.semi_in(rows, top, "name")


@register("corr_scalar_max", """
SELECT a.action_code, a.text FROM actions a
JOIN (SELECT action_code, max(action_date) AS last_day FROM actions GROUP BY action_code) m
  ON m.action_code = a.action_code AND m.last_day = a.action_date
""")
def q_corr_scalar_max(spark, d):
    return R.corr_scalar_max(T(spark, d).actions, "action_code", "action_date").select("action_code", "text")


# --- 2.4 aggregates --------------------------------------------------------------------

@register("count_by", "SELECT type, count(*) AS cnt FROM actions GROUP BY type")
def q_count_by(spark, d):
    return A.count_by(T(spark, d).actions_lean, "type")


@register("count_distinct", "SELECT count(DISTINCT text) AS n_distinct FROM actions")
def q_count_distinct(spark, d):
    return A.count_distinct(T(spark, d).actions, "text")


@register("count_distinct_bills", "SELECT count(DISTINCT bill_id) AS n_distinct FROM actions")
def q_count_distinct_bills(spark, d):
    return A.count_distinct(T(spark, d).actions_lean, "bill_id")


@register("count_distinct_cosponsors", "SELECT count(DISTINCT sponsor_id) AS n_distinct FROM cosponsors")
def q_count_distinct_cosponsors(spark, d):
    return A.count_distinct(T(spark, d).cosponsors, "sponsor_id")


@register("count_distinct_sub", "SELECT count(*) AS n_distinct FROM (SELECT bill_id FROM actions WHERE bill_id IS NOT NULL GROUP BY bill_id) b")
def q_count_distinct_sub(spark, d):
    return A.count_distinct(P.latest_status(T(spark, d).actions, TB), "bill_id")


@register("count_distinct_split", """
SELECT count(DISTINCT bill_id) AS n_distinct FROM (
  SELECT bill_id, action_date, split_part(text, ' ', 1) AS status FROM actions) tb
""")
def q_count_distinct_split(spark, d):
    a = T(spark, d).actions.select("bill_id", "action_date", X.f_split_part("text").alias("status"))
    return A.count_distinct(a, "bill_id")


_FIRST_VALUE_SQL = f"""
SELECT status FROM (
  SELECT text AS status FROM actions
  QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY action_date DESC NULLS LAST, {TIE_SQL}) = 1) latest
GROUP BY status
"""


@register("first_value_latest", _FIRST_VALUE_SQL)
def q_first_value_latest(spark, d):
    return W.first_value_latest(T(spark, d).actions, tiebreak=TB)


@register("count_of_distinct", f"SELECT count(*) AS cnt FROM ({_FIRST_VALUE_SQL}) tb")
def q_count_of_distinct(spark, d):
    return A.count_of_distinct(q_first_value_latest(spark, d), ["status"])


@register("max_by_group", "SELECT action_code, max(action_date) AS max_date FROM actions GROUP BY action_code")
def q_max_by_group(spark, d):
    return A.max_by_group(T(spark, d).actions_lean, "action_code", "action_date", "max_date")


@register("month_counts", f"SELECT name, dt, cnt FROM ({monthly_sql()}) mon")
def q_month_counts(spark, d):
    t = T(spark, d)
    return P._named_monthly(t.actions_lean, t.committees, TEST_REFERRAL_TYPE).select("name", "dt", "cnt")


@register("top_k", f"SELECT * FROM ({best_sql()}) best")
def q_top_k(spark, d):
    counts = q_month_counts(spark, d).groupBy("name").agg(F.sum("cnt").cast("bigint").alias("cnt"))
    return R.top_k(counts, "cnt", 5, ["name"])


@register("head_n", "SELECT * FROM bills ORDER BY id LIMIT 6")
def q_head_n(spark, d):
    return R.head_n(T(spark, d).bills, 6, ["id"])


@register("sort_one", f"SELECT * FROM actions WHERE upper(text) LIKE '%{REJECT}%' ORDER BY action_date")
def q_sort_one(spark, d):
    return R.sort_by(R.filter_contains_ci(T(spark, d).actions, "text", REJECT), ["action_date", *TB])


@register("sort_multi", "SELECT bill_id, type, action_date FROM actions ORDER BY bill_id, type")
def q_sort_multi(spark, d):
    return R.sort_by(T(spark, d).actions_lean.select("bill_id", "type", "action_date"), ["bill_id", "type"])


# --- 2.5 windows -----------------------------------------------------------------------

@register("lead_step", f"SELECT bill_id, action_date, type, next_row, next_type FROM ({_lead_sql()}) l")
def q_lead_step(spark, d):
    a = T(spark, d).actions_lean.select("bill_id", "action_date", "type", *TB)
    return W.lead_step(a, tiebreak=TB).select("bill_id", "action_date", "type", "next_row", "next_type")


@register("filter_not_null", "SELECT id, bill_type, updatedate FROM bills WHERE updatedate IS NOT NULL")
def q_filter_not_null(spark, d):
    return R.filter_not_null(T(spark, d).bills.select("id", "bill_type", "updatedate"), "updatedate")


@register("max_over", "SELECT bill_id, action_date, type, max(action_date) OVER (PARTITION BY bill_id) AS group_max FROM actions")
def q_max_over(spark, d):
    a = T(spark, d).actions_lean.select("bill_id", "action_date", "type")
    return W.max_over(a, "bill_id", "action_date").select("bill_id", "action_date", "type", "group_max")


@register("latest_per_date", f"""
SELECT DISTINCT status FROM (
  SELECT text AS status FROM actions QUALIFY row_number() OVER (PARTITION BY action_date ORDER BY {TIE_SQL}) = 1) first_of_day
""")
def q_latest_per_date(spark, d):
    return W.latest_per_date(T(spark, d).actions, "action_date", TB)


# --- 2.8 scalar functions ----------------------------------------------------------------

@register("f_upper_lower", "SELECT id, upper(title) AS title_upper, lower(title) AS title_lower FROM titles")
def q_f_upper_lower(spark, d):
    t = T(spark, d).titles
    return t.select("id", X.f_upper("title").alias("title_upper"), X.f_lower("title").alias("title_lower"))


@register("f_split_part", "SELECT bill_id, action_date, split_part(text, ' ', 1) AS first_word FROM actions")
def q_f_split_part(spark, d):
    a = T(spark, d).actions
    return a.select("bill_id", "action_date", X.f_split_part("text").alias("first_word"))


@register("f_length", "SELECT title, CAST(length(title) AS BIGINT) AS title_length FROM titles")
def q_f_length(spark, d):
    return T(spark, d).titles.select("title", X.f_length("title").alias("title_length"))


@register("f_token_count", "SELECT id, CAST(len(string_split_regex(title, '\\s')) AS BIGINT) AS n_tokens FROM titles")
def q_f_token_count(spark, d):
    return T(spark, d).titles.select("id", X.f_token_count("title").alias("n_tokens"))


@register("f_lpad", "SELECT DISTINCT lpad(CAST(month(action_date) AS VARCHAR), 2, '0') AS mm FROM actions")
def q_f_lpad(spark, d):
    a = T(spark, d).actions_lean
    return a.select(X.f_lpad(F.month("action_date")).alias("mm")).distinct()


@register("f_date_format", """
SELECT id, strftime(createdate, '%d/%m/%Y') AS dmy, strftime(createdate, '%Y-%m') AS ym,
       strftime(createdate, '%Y') AS yyyy, strftime(createdate, '%m') AS mm FROM bills
""")
def q_f_date_format(spark, d):
    b = T(spark, d).bills
    return b.select("id", *[X.f_date_format("createdate", f).alias(n) for n, f in
                            (("dmy", "DD/MM/YYYY"), ("ym", "YYYY-MM"), ("yyyy", "YYYY"), ("mm", "MM"))])


@register("f_date_diff", "SELECT id, CAST(updatedate AS DATE) - CAST(createdate AS DATE) AS days FROM bills")
def q_f_date_diff(spark, d):
    b = T(spark, d).bills
    return b.select("id", X.f_date_diff(F.col("updatedate").cast("date"), F.col("createdate").cast("date")).alias("days"))


@register("f_extract_day", "SELECT id, CAST(EXTRACT(DAY FROM updatedate - createdate) AS BIGINT) AS no_days FROM bills")
def q_f_extract_day(spark, d):
    b = T(spark, d).bills
    return b.select("id", X.f_extract_day("updatedate", "createdate").alias("no_days"))


@register("f_concat", f"SELECT bill_id, 'Bill will be ' || status AS message FROM ({BILL_FEATURES_SQL}) bf")
def q_f_concat(spark, d):
    bf = q_bill_features(spark, d)
    return bf.select("bill_id", X.f_concat("Bill will be ", F.col("status")).alias("message"))


@register("f_recode", f"SELECT bioguideid, CASE WHEN party = '{PARTY}' THEN 'R' ELSE 'D' END AS party_code FROM members")
def q_f_recode(spark, d):
    m = T(spark, d).members
    return m.select("bioguideid", X.f_recode("party", PARTY, "R", "D").alias("party_code"))


# --- statistics ----------------------------------------------------------------------------

_BF = {"bf": BILL_FEATURES_SQL}


@register("row_count", with_ctes("SELECT count(*) AS n_rows FROM bf", **_BF), ctes=False)
def q_row_count(spark, d):
    return S.row_count(q_bill_features(spark, d))


@register("factor_levels", with_ctes("""
SELECT state, CAST(row_number() OVER (ORDER BY state) - 1 AS BIGINT) AS level_index
FROM (SELECT DISTINCT state FROM bf WHERE state IS NOT NULL) s""", **_BF), ctes=False)
def q_factor_levels(spark, d):
    return S.factor_levels(q_bill_features(spark, d), "state")


@register("kpis", with_ctes("SELECT CAST(max(ac_count) AS BIGINT) AS max_actions, CAST(max(no_days) AS BIGINT) AS max_days FROM bf", **_BF),
          ctes=False)
def q_kpis(spark, d):
    return S.kpis(q_bill_features(spark, d))


def _summary_sql(col: str) -> str:
    qs = ", ".join(f"round(quantile_cont({col}, {p}), 6) AS {n}" for n, p in
                   (("min", 0.0), ("q1", 0.25), ("median", 0.5)))
    return (f"SELECT '{col}' AS variable, {qs}, round(avg({col}), 6) AS mean, "
            f"round(quantile_cont({col}, 0.75), 6) AS q3, round(quantile_cont({col}, 1.0), 6) AS max FROM bf")


@register("summary_stats", with_ctes(_summary_sql("no_days") + " UNION ALL " + _summary_sql("ac_count"), **_BF),
          ctes=False)
def q_summary_stats(spark, d):
    df = S.summary_stats(q_bill_features(spark, d), ["no_days", "ac_count"])
    return r6(df, "min", "q1", "median", "mean", "q3", "max")


HIST_LO, HIST_W, HIST_N = 0.0, 25.0, 32


@register("histogram", with_ctes(f"""
SELECT bins.bin, CAST({HIST_LO} + (bins.bin - 1) * {HIST_W} AS DOUBLE) AS lower,
       CAST({HIST_LO} + bins.bin * {HIST_W} AS DOUBLE) AS upper, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt
FROM (SELECT CAST(b AS INTEGER) AS bin FROM range(1, {HIST_N + 1}) t(b)) bins
LEFT JOIN (SELECT CAST(greatest(ceil((CAST(no_days AS DOUBLE) - {HIST_LO}) / {HIST_W}), 1) AS INTEGER) AS bin,
                  count(*) AS cnt FROM bf
           WHERE no_days >= {HIST_LO} AND no_days <= {HIST_LO + HIST_W * HIST_N} GROUP BY 1) c
  ON c.bin = bins.bin""", **_BF), ctes=False)
def q_histogram(spark, d):
    return S.histogram(q_bill_features(spark, d), "no_days", HIST_LO, HIST_W, HIST_N)


# --- inventory ids with queries of their own ----------------------------------------------


@register("avg_by_pair", """
SELECT originchamber, bill_type, round(avg(updatedate::DATE - createdate::DATE), 6) AS avg_days FROM bills GROUP BY ALL""")
def q_avg_by_pair(spark, d):
    b = T(spark, d).bills
    days = X.f_date_diff(F.col("updatedate").cast("date"), F.col("createdate").cast("date"))
    return r6(A.avg_expr(b.groupBy("originchamber", "bill_type"), avg_days=days), "avg_days")


def _case_avg_sql(group: str) -> str:
    return ("SELECT " + group + ", " + ", ".join(
        f"round(sum(if(originchamber = '{c}', 1, 0) * (updatedate::DATE - createdate::DATE)) / count(updatedate::DATE - createdate::DATE), 6) AS {c.lower()}"
        for c in ("F", "O", "P")) + f" FROM bills WHERE updatedate IS NOT NULL GROUP BY {group}")


def _case_avg(spark, d, group):
    b = T(spark, d).bills.where(F.col("updatedate").isNotNull())
    days = X.f_date_diff(F.col("updatedate").cast("date"), F.col("createdate").cast("date"))
    out = A.avg_expr(b.groupBy(*group), **{c.lower(): X.f_case((F.col("originchamber") == c, days), default=F.lit(0))
                                           for c in ("F", "O", "P")})
    return r6(out, "f", "o", "p")


@register("case_avg_crosstab", _case_avg_sql("bill_type, introduceddate"))
def q_case_avg_crosstab(spark, d):
    return _case_avg(spark, d, ["bill_type", "introduceddate"])


@register("case_avg_crosstab_by_type", _case_avg_sql("bill_type"))
def q_case_avg_crosstab_by_type(spark, d):
    return _case_avg(spark, d, ["bill_type"])


@register("count_by_pair_text", "SELECT bill_id, text, count(*) AS cnt FROM actions GROUP BY ALL")
def q_count_by_pair_text(spark, d):
    return A.count_by(T(spark, d).actions, "bill_id", "text")


@register("outcome_counts", f"SELECT party, status, count(*) AS cnt FROM ({BILL_FEATURES_SQL}) bf GROUP BY ALL")
def q_outcome_counts(spark, d):
    return A.count_by(q_bill_features(spark, d), "party", "status")


@register("latest_per_key", f"""
SELECT committee, type AS status FROM actions
QUALIFY row_number() OVER (PARTITION BY committee ORDER BY action_date DESC NULLS LAST, bill_id, {TIE_SQL}) = 1""")
def q_latest_per_key(spark, d):
    return W.latest_per_key(T(spark, d).actions_lean, "committee", "action_date", ["bill_id", *TB], "type")


@register("sort_mixed", "SELECT type, action_date, count(*) AS cnt FROM actions GROUP BY ALL ORDER BY action_date, cnt DESC, type")
def q_sort_mixed(spark, d):
    counts = A.count_by(T(spark, d).actions_lean, "type", "action_date")
    return counts.orderBy(F.col("action_date").asc_nulls_last(), F.col("cnt").desc(), F.col("type").asc_nulls_last())


_XTABS_COLS = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE type = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in TEST_TYPES)


@register("xtabs", f"""
SELECT code, {_XTABS_COLS} FROM (SELECT action_code AS code, type, count(*) AS n FROM actions GROUP BY ALL) g GROUP BY code""")
def q_xtabs(spark, d):
    long = T(spark, d).actions_lean.groupBy(F.col("action_code").alias("code"), "type").agg(F.count(F.lit(1)).alias("n"))
    return S.xtabs(long, "code", "type", "n", TEST_TYPES)


@register("f_row_label", f"""
SELECT 'month ' || mm AS label, {_XTABS_COLS} FROM (
  SELECT strftime(action_date, '%m') AS mm, type, count(*) AS n FROM actions GROUP BY ALL) g GROUP BY mm""")
def q_f_row_label(spark, d):
    """The row label of a cross-tab as an ordinary column."""
    a = T(spark, d).actions_lean
    long = a.groupBy(X.f_concat("month ", X.f_date_format("action_date", "MM")).alias("label"), "type").agg(F.count(F.lit(1)).alias("n"))
    return S.xtabs(long, "label", "type", "n", TEST_TYPES)


@register("avg_expr", "SELECT type, round(avg(part_id * 2 + line_no), 6) AS mean FROM actions GROUP BY type")
def q_avg_expr(spark, d):
    a = T(spark, d).actions_lean
    return r6(A.avg_expr(a.groupBy("type"), mean=F.col("part_id") * 2 + F.col("line_no")), "mean")


@register("f_substr", "SELECT id, substr(name, 3, 5) AS part FROM committees")
def q_f_substr(spark, d):
    return T(spark, d).committees.select("id", X.f_substr("name", 3, 5).alias("part"))


@register("f_case", "SELECT bioguideid, CASE WHEN party = 'BUILDING' THEN 'B' WHEN state LIKE '%1' THEN 'one' ELSE 'other' END AS kind FROM members")
def q_f_case(spark, d):
    m = T(spark, d).members
    kind = X.f_case((F.col("party") == "BUILDING", F.lit("B")), (F.col("state").like("%1"), F.lit("one")), default=F.lit("other"))
    return m.select("bioguideid", kind.alias("kind"))


@register("f_upper", "SELECT id, upper(name) AS upper_name FROM committees")
def q_f_upper(spark, d):
    return T(spark, d).committees.select("id", X.f_upper("name").alias("upper_name"))


@register("f_lower", "SELECT DISTINCT lower(party) AS party FROM members")
def q_f_lower(spark, d):
    return T(spark, d).members.select(X.f_lower("party").alias("party")).distinct()


@register("kpi_max_actions", f"SELECT max(ac_count) AS max_actions FROM ({outcome_sql()}) o")
def q_kpi_max_actions(spark, d):
    return P.bill_outcomes(T(spark, d).actions_lean, TEST_PASS_MARKERS).agg(F.max("ac_count").alias("max_actions"))


@register("kpi_max_days", """
SELECT CAST(max(trunc(epoch(updatedate - createdate) / 86400)) AS BIGINT) AS max_days FROM bills""")
def q_kpi_max_days(spark, d):
    return T(spark, d).bills.agg(F.max(X.f_extract_day("updatedate", "createdate")).alias("max_days"))


# a third of all rows without a key, a third under one key: both groups are split into ranges
_HEAVY = "CASE bill_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE bill_id END"


@register("lead_step_heavy", f"""
SELECT k, bill_id, action_date, line_no, part_id,
       lead(bill_id) OVER w AS next_bill, lead(type) OVER w AS next_type
FROM (SELECT *, {_HEAVY} AS k FROM actions) keyed
WINDOW w AS (PARTITION BY k ORDER BY action_date NULLS LAST, bill_id, {TIE_SQL})
""")
def q_lead_step_heavy(spark, d):
    a = T(spark, d).actions_lean.select(F.expr(_HEAVY).alias("k"), "bill_id", "action_date", "type", *TB)
    out = W.lead_step(a, "k", ["action_date"], ["bill_id", *TB], ["bill_id", "type"], ["next_bill", "next_type"], max_rows=2000)
    return out.select("k", "bill_id", "action_date", "line_no", "part_id", "next_bill", "next_type")


@register("event_transitions", """
SELECT event_type AS activity, next_activity, count(*) AS cnt,
       round(avg((epoch_us(next_ts) - epoch_us(ts)) / 1e6), 6) AS avg_seconds
FROM (SELECT ts, event_type,
             lead(ts, 1) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST) AS next_ts,
             lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST) AS next_activity
      FROM events) e
WHERE next_activity IS NOT NULL GROUP BY event_type, next_activity
""", ctes=False)
def q_event_transitions(spark, d):
    from caseflow.sources.tables import raw_table
    ev = raw_table(spark, d, "events")
    return r6(P.directly_follows(ev, "user_id", "ts", "event_type"), "avg_seconds")
