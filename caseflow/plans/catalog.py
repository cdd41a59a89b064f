"""Registry of the runnable queries: one Spark builder and (where SQL can say
it) one oracle SQL text per operator of the survey inventory.

Every builder takes ``(spark, sf_dir)``, binds the process tables to the
test tables of ``sf_dir`` and returns a lazy DataFrame.  Every oracle text is
plain SQL over the raw test tables (the bindings are repeated as CTEs), run
by an independent engine; column names and types are aliased identically on
both sides, and averages are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.sources.tables import (BINDING_CTES, TEST_PASS_MARKERS, TEST_REFERRAL_TYPE,
                                     TEST_TIEBREAK, TEST_TYPES, bind_test_tables)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# fixed parameters of the registered queries on the test binding
PARTY, STATE, CHAMBER = "BUILDING", "NATION_3", "F"
REJECT, PUBLIC = "RING", "HOT"
TIMELINE_BILL = 7
TIE_SQL = "line_no, part_id, committee"


def register(name: str, sql: str | None = None, ctes: bool = True):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (BINDING_CTES + sql) if ctes else sql
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the listed double columns to 6 digits (same on the oracle side)."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def T(spark: SparkSession, sf_dir: str):
    return bind_test_tables(spark, sf_dir)


# --- 2.9 process composites ----------------------------------------------------

from caseflow.plans import process as P  # noqa: E402



def outcome_sql(markers=TEST_PASS_MARKERS) -> str:
    """Per bill: its number of actions, the types on its latest day joined by blanks, and the label."""
    hit = " OR ".join(f"last_types ILIKE '{m}'" for m in markers)
    return f"""
SELECT bill_id, ac_count, last_types, CASE WHEN {hit} THEN 'Passed' ELSE 'REFERRED' END AS status
FROM (SELECT a.bill_id, count(*) AS ac_count,
             array_to_string(list(a.type ORDER BY a.type) FILTER (WHERE a.action_date = d.last_day), ' ') AS last_types
      FROM actions a JOIN (SELECT bill_id, max(action_date) AS last_day FROM actions GROUP BY bill_id) d USING (bill_id)
      WHERE d.last_day IS NOT NULL GROUP BY a.bill_id) per_bill"""


BILL_FEATURES_SQL = f"""
SELECT o.bill_id, b.bill_type, b.originchamber, strftime(b.createdate, '%d/%m/%Y') AS createdate,
       strftime(b.updatedate, '%d/%m/%Y') AS updatedate, strftime(b.introduceddate, '%d/%m/%Y') AS introduceddate,
       CAST(trunc(epoch(b.updatedate - b.createdate) / 86400) AS BIGINT) AS no_days,
       m.party, m.state, o.ac_count, o.status
FROM ({outcome_sql()}) o, bills b, sponsors s, members m
WHERE b.id = o.bill_id AND s.bill_id = b.id AND m.bioguideid = s.sponsor_id
"""


@register("bill_features", BILL_FEATURES_SQL)
def q_bill_features(spark, d):
    t = T(spark, d)
    return P.bill_features(t.actions_lean, t.bills, t.sponsors, t.members, TEST_PASS_MARKERS)


@register("pass_referred", f"SELECT count(*) AS cnt, status FROM ({BILL_FEATURES_SQL}) tbl GROUP BY status")
def q_pass_referred(spark, d):
    return P.pass_referred(q_bill_features(spark, d))


def _lead_sql() -> str:
    """Each action with the next one of its bill: numbered rows joined to their successors."""
    return f"""
WITH numbered AS (
  SELECT bill_id, action_date, type,
         row_number() OVER (PARTITION BY bill_id ORDER BY action_date NULLS LAST, {TIE_SQL}) AS pos
  FROM actions)
SELECT cur.bill_id, cur.action_date, cur.type, nxt.action_date AS next_row, nxt.type AS next_type
FROM numbered cur LEFT JOIN numbered nxt ON nxt.bill_id IS NOT DISTINCT FROM cur.bill_id AND nxt.pos = cur.pos + 1"""


# how many (bill, sponsor, member) rows of a chosen kind each bill has
PICKED_SQL = f"""
SELECT b.id, count(*) AS w FROM bills b, sponsors s, members m
WHERE s.bill_id = b.id AND m.bioguideid = s.sponsor_id
  AND m.party = '{PARTY}' AND m.state = '{STATE}' AND b.originchamber = '{CHAMBER}' GROUP BY b.id"""

TRANSITIONS_SQL = f"""
SELECT type, next_type, round(avg(next_row - action_date), 6) AS no_days
FROM ({_lead_sql()}) step JOIN bills ON id = bill_id
WHERE next_type IS NOT NULL GROUP BY ALL
"""

TRANSITIONS_FILTERED_SQL = f"""
SELECT type, next_type,
       round(sum((next_row - action_date) * w) / nullif(sum(w) FILTER (WHERE next_row - action_date IS NOT NULL), 0), 6) AS no_days
FROM ({_lead_sql()}) step JOIN ({PICKED_SQL}) picked ON id = bill_id
WHERE next_type IS NOT NULL GROUP BY ALL
"""


@register("transitions", TRANSITIONS_SQL)
def q_transitions(spark, d):
    t = T(spark, d)
    return r6(P.transitions(t.actions_lean, t.bills, TEST_TIEBREAK), "no_days")


@register("transitions_filtered", TRANSITIONS_FILTERED_SQL)
def q_transitions_filtered(spark, d):
    t = T(spark, d)
    return r6(P.transitions_filtered(t.actions_lean, t.bills, t.sponsors, t.members,
                                     PARTY, STATE, CHAMBER, TEST_TIEBREAK), "no_days")


def _crosstab_sql(group: str) -> str:
    # the mean of "days if the type is X, else 0": X's days over all rows that have a value
    cols = ", ".join(
        f"round(coalesce(sum(days) FILTER (WHERE type = '{x}'), 0) / nullif(count(*) FILTER "
        f"(WHERE type IS DISTINCT FROM '{x}' OR days IS NOT NULL), 0), 6) AS \"{x.lower()}\"" for x in TEST_TYPES)
    return f"""
SELECT type, {cols}
FROM (SELECT type, next_type, next_row - action_date AS days FROM ({_lead_sql()}) step JOIN bills ON id = bill_id
      WHERE next_type IS NOT NULL) kept
GROUP BY {group}
"""


@register("dwell_crosstab", _crosstab_sql("type, next_type"))
def q_dwell_crosstab(spark, d):
    t = T(spark, d)
    df = P.dwell_crosstab(t.actions_lean, t.bills, TEST_TYPES, TEST_TIEBREAK)
    return r6(df, *[x.lower() for x in TEST_TYPES])


@register("dwell_crosstab_by_type", _crosstab_sql("type"))
def q_dwell_crosstab_by_type(spark, d):
    t = T(spark, d)
    df = P.dwell_crosstab(t.actions_lean, t.bills, TEST_TYPES, TEST_TIEBREAK, by_next=False)
    return r6(df, *[x.lower() for x in TEST_TYPES])


@register("transition_matrix", "SELECT type, " + ", ".join(
    f"max(CASE WHEN next_type = '{x}' THEN no_days END) AS \"{x}\"" for x in TEST_TYPES)
    + f" FROM ({TRANSITIONS_SQL}) tr GROUP BY type")
def q_transition_matrix(spark, d):
    return P.transition_matrix(q_transitions(spark, d), TEST_TYPES)


from caseflow.operators.graph import graph_edges, graph_nodes  # noqa: E402


@register("graph_edges", f"SELECT type AS src, next_type AS dst FROM ({TRANSITIONS_SQL}) tr")
def q_graph_edges(spark, d):
    return graph_edges(q_transitions(spark, d))


@register("graph_nodes", f"""
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT type AS node, 1 AS o, 0 AS i FROM ({TRANSITIONS_SQL}) a
  UNION ALL SELECT next_type AS node, 0 AS o, 1 AS i FROM ({TRANSITIONS_SQL}) b) e
GROUP BY node
""")
def q_graph_nodes(spark, d):
    return graph_nodes(q_graph_edges(spark, d))


def monthly_sql() -> str:
    """Referrals per committee name and month."""
    return f"""
SELECT s.name, strftime(a.action_date, '%Y-%m') AS dt, count(*) AS cnt
FROM committees s JOIN actions a ON a.committee = s.id AND a.type = '{TEST_REFERRAL_TYPE}' GROUP BY ALL"""


def best_sql(k: int = 5) -> str:
    return f"SELECT name, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({monthly_sql()}) mon GROUP BY name ORDER BY 2 DESC, name LIMIT {k}"


def _topk_sql(months: tuple[str, str] | None = None) -> str:
    when = f"WHERE dt BETWEEN '{months[0]}' AND '{months[1]}'" if months else ""
    return f"""
SELECT name, dt, cnt FROM ({monthly_sql()}) mon SEMI JOIN ({best_sql()}) best USING (name)
{when} ORDER BY dt, cnt DESC
"""


@register("topk_monthly", _topk_sql())
def q_topk_monthly(spark, d):
    t = T(spark, d)
    return P.topk_monthly(t.actions_lean, t.committees, 5, TEST_REFERRAL_TYPE)


YEAR, M_LO, M_HI = 1997, 0, 6


@register("topk_monthly_range", _topk_sql((f"{YEAR}-{M_LO:02d}", f"{YEAR}-{M_HI:02d}")))
def q_topk_monthly_range(spark, d):
    t = T(spark, d)
    return P.topk_monthly(t.actions_lean, t.committees, 5, TEST_REFERRAL_TYPE, YEAR, M_LO, M_HI)


def wide_sql() -> str:
    """One row per month: counts c1..c5 of the top names in name order, and the names n1..n5."""
    counts = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (WHERE place = {i}), 0) AS BIGINT) AS c{i}" for i in range(1, 6))
    names = ", ".join(f"(SELECT name FROM best WHERE place = {i}) AS n{i}" for i in range(1, 6))
    return f"""
WITH best AS (SELECT name, row_number() OVER (ORDER BY name) AS place FROM ({best_sql()}) b WHERE name IS NOT NULL)
SELECT dt, {counts}, {names} FROM ({monthly_sql()}) mon JOIN best USING (name) GROUP BY dt"""


@register("topk_monthly_wide", f"SELECT * FROM ({wide_sql()}) wide")
def q_topk_monthly_wide(spark, d):
    t = T(spark, d)
    return P.topk_monthly_wide(t.actions_lean, t.committees, 5, TEST_REFERRAL_TYPE, ranked=True)


@register("bill_timeline", f"""
SELECT text FROM actions WHERE bill_id = {TIMELINE_BILL} ORDER BY action_date, {TIE_SQL}
""")
def q_bill_timeline(spark, d):
    t = T(spark, d)
    return P.bill_timeline(t.actions, TIMELINE_BILL, TEST_TIEBREAK)


@register("latest_status", f"""
SELECT bill_id, text AS status FROM actions
QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY action_date DESC NULLS LAST, {TIE_SQL}) = 1
""")
def q_latest_status(spark, d):
    t = T(spark, d)
    return P.latest_status(t.actions, TEST_TIEBREAK)


@register("rejected_not_public", f"""
SELECT * FROM actions ANTI JOIN (SELECT bill_id FROM actions WHERE text ILIKE '%{PUBLIC}%') public USING (bill_id)
WHERE text ILIKE '%{REJECT}%'
""")
def q_rejected_not_public(spark, d):
    t = T(spark, d)
    return P.rejected_not_public(t.actions, REJECT, PUBLIC)


@register("last_by_code", """
SELECT bill_id, text, count(*) AS cnt
FROM (SELECT bill_id, text FROM actions
      QUALIFY rank() OVER (PARTITION BY action_code ORDER BY action_date DESC NULLS LAST) = 1 AND action_date IS NOT NULL
          AND action_code IS NOT NULL) latest
GROUP BY ALL
""")
def q_last_by_code(spark, d):
    t = T(spark, d)
    return P.last_by_code(t.actions)


@register("title_stats", """
SELECT round(avg(length(title)), 6) AS avg_length,
       round(avg(len(string_split_regex(title, '\\s'))), 6) AS avg_tokens FROM titles
""")
def q_title_stats(spark, d):
    t = T(spark, d)
    return r6(P.title_stats(t.titles), "avg_length", "avg_tokens")
