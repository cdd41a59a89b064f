"""Process-analytics composites: outcome features, transitions, dwell cross-tabs,
top-k monthly series, timelines and latest states.

Each function takes the process tables as DataFrames (canonical column names
by default) and returns a lazy DataFrame.  The plans are written so that the
big table (actions) is shuffled once, on the bill key, and everything keyed
by a few values (action type, committee) is reduced by partial aggregation
before it moves.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.exprs import (f_date_format, f_extract_day, f_micros, like_any)
from caseflow.operators.prefix import ROWS_PER_RANGE
from caseflow.operators.windows import heavy_keys, lead_step, order_struct, sort_exprs
from caseflow.session import shared_table

# Fixed values of the reference: the outcome markers and the ten action types.
DEFAULT_PASS_MARKERS = ("%status%", "%BecameLaw%")
DEFAULT_REFERRAL_TYPE = "IntroReferral"
ACTION_TYPES = ("BecameLaw", "Calendars", "Committee", "Discharge", "Floor",
                "IntroReferral", "NotUsed", "President", "ResolvingDifferences", "Veto")


_PLAIN_MARKER = re.compile(r"%[^%_\\ ]+%")


def _markers_token_safe(markers: Sequence[str]) -> bool:
    """True when every marker is ``%literal%`` without a blank, wildcard or escape in
    the literal: it can then match only inside one type, so "the joined string
    matches" equals "some type matches"."""
    return all(_PLAIN_MARKER.fullmatch(m) for m in markers)


def bill_outcomes(actions: DataFrame, markers: Sequence[str] = DEFAULT_PASS_MARKERS,
                  bill: str = "bill_id", date: str = "action_date", type_col: str = "type",
                  yes: str = "Passed", no: str = "REFERRED") -> DataFrame:
    """Per bill: number of actions and the outcome label decided by the actions
    on the bill's latest date.

    The reference joins the types of the latest-date actions with blanks and
    matches the markers against that string.  When no marker can span the
    blank, that equals "some latest-date type matches", which one aggregate
    computes: the max of ``2 * day + matched`` is the latest date together
    with whether any action on it matched.  One hash-aggregated shuffle with
    partial aggregation, whatever the number of actions per bill.
    Bills without any dated action drop out, as in the reference.
    """
    if _markers_token_safe(markers):
        matched = F.coalesce(like_any(type_col, markers), F.lit(False)).cast("long")
        # (date, matched) packed into one long, 2 * day + flag: its max is the
        # latest date with "any match on that date" in the low bit.  A numeric
        # max keeps the aggregate hash-based (a struct max would sort).
        dtype = dict(actions.dtypes).get(date, "date")
        day = f_micros(date, dtype) if dtype.startswith("timestamp") else F.unix_date(F.col(date))
        agg = actions.groupBy(bill).agg(
            F.count(F.lit(1)).alias("ac_count"),
            F.max(day.cast("long") * F.lit(2) + matched).alias("_last"))
        return agg.where(F.col("_last").isNotNull()).select(
            bill, "ac_count",
            F.when(F.pmod(F.col("_last"), F.lit(2)) == 1, F.lit(yes)).otherwise(F.lit(no)).alias("status"))
    # general markers: the joined string of the latest-date types.  Equal types follow each other in it, and
    # of a run only as many copies can matter as the longest marker has characters, plus one that only a
    # wildcard covers; so types are counted first and a bill's string is as short as its distinct types.
    counts = shared_table(actions.groupBy(bill).agg(F.count(F.lit(1)).alias("ac_count"), F.max(date).alias("_max")), "latest-dates")
    most = max((len(m.upper()) for m in markers), default=0) + 1
    runs = (actions.join(counts.select(bill, "_max"), bill)
            .where((F.col(date) == F.col("_max")) & F.col(type_col).isNotNull())
            .groupBy(bill, type_col).agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("_copies")))
    last = runs.groupBy(bill).agg(F.array_sort(F.collect_list(F.struct(F.col(type_col).alias("t"), "_copies"))).alias("_runs")).select(
        bill, F.array_join(F.flatten(F.transform("_runs", lambda r: F.array_repeat(r["t"], r["_copies"]))), " ").alias("_joined"))
    return counts.where(F.col("_max").isNotNull()).join(last, bill, "left").select(
        bill, "ac_count",
        F.when(F.coalesce(like_any("_joined", markers), F.lit(False)), F.lit(yes))
        .otherwise(F.lit(no)).alias("status"))


def bill_features(actions: DataFrame, bills: DataFrame, sponsors: DataFrame, members: DataFrame,
                  markers: Sequence[str] = DEFAULT_PASS_MARKERS) -> DataFrame:
    """One row per (bill, sponsor): bill attributes, formatted dates, day count,
    sponsor party/state, action count and outcome label.

    Several sponsors of one bill give several rows (the reference's join
    fans out the same way).  Bills, action aggregates and sponsors all join
    on the bill key, so they share one hash partitioning; members join on the
    sponsor key (AQE broadcasts it when its measured size is small, and splits
    a heavy sponsor with the skew-join rule otherwise).
    """
    out = bill_outcomes(actions, markers)
    b = bills.withColumnRenamed("id", "bill_id")
    m = members.withColumnRenamed("bioguideid", "sponsor_id")
    j = (out.join(b, "bill_id").join(sponsors.select("bill_id", "sponsor_id"), "bill_id")
         .join(m.select("sponsor_id", "party", "state"), "sponsor_id"))
    return j.select(
        "bill_id", "bill_type", "originchamber",
        f_date_format("createdate").alias("createdate"),
        f_date_format("updatedate").alias("updatedate"),
        f_date_format("introduceddate").alias("introduceddate"),
        f_extract_day("updatedate", "createdate").alias("no_days"),
        "party", "state", "ac_count", "status")


def pass_referred(features: DataFrame) -> DataFrame:
    """Count of (bill, sponsor) rows per outcome label."""
    return features.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def outcome_counts(features: DataFrame, label: str = "status") -> DataFrame:
    return features.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))


# --- transitions -------------------------------------------------------------

def _bill_weights(bills: DataFrame) -> DataFrame:
    """How many rows the inner join with ``bills`` gives each bill key (1 when ids are unique)."""
    return bills.groupBy(F.col("id").alias("bill_id")).agg(F.count(F.lit(1)).alias("_w"))


def _steps(actions: DataFrame, weights: DataFrame, tiebreak: Sequence[str], skew: str, max_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Directly-follows steps of the bills in ``weights``: (type, next_type, days, w).

    Bills are pruned before the window (whole bills pass or fail), the window
    runs on the same bill partitioning as that join, and ``w`` carries how many
    times the reference's inner join would repeat each step.
    """
    cols = ["bill_id", "action_date", "type", *tiebreak]
    # heavy bills are counted on the bill key column alone, before any join
    hot = heavy_keys(actions, "bill_id", max_rows) if skew == "auto" else None
    if hot is not None and not hot.isEmpty():
        # a join with an aggregate would hold a heavy bill in one task; with a written table both
        # sides are plain shuffles, which the skew join splits
        weights = shared_table(weights, "bill-weights")
    a = actions.select(*cols).join(weights, "bill_id")
    s = lead_step(a, "bill_id", ["action_date"], tiebreak, ["action_date", "type"],
                  ["next_row", "next_type"], skew=skew, max_rows=max_rows, hot_keys=hot)
    return s.where(F.col("next_type").isNotNull()).select(
        "type", "next_type", F.datediff("next_row", "action_date").cast("bigint").alias("days"), "_w")


def _wavg(v, w="_w"):
    """Weighted mean equal to ``avg`` over the fanned-out rows (NULL values skipped)."""
    v = F.col(v) if isinstance(v, str) else v
    return (F.sum(v * F.col(w)) / F.sum(F.when(v.isNotNull(), F.col(w)))).cast("double")


def transitions(actions: DataFrame, bills: DataFrame, tiebreak: Sequence[str] = (),
                skew: str = "auto", max_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Mean days from one action to the next, per (type, next_type).  Bills of more than
    ``max_rows`` actions are split over tasks."""
    st = _steps(actions, _bill_weights(bills), tiebreak, skew, max_rows)
    return st.groupBy("type", "next_type").agg(_wavg("days").alias("no_days"))


def selected_bill_weights(bills: DataFrame, sponsors: DataFrame, members: DataFrame,
                          party: str | None = None, state: str | None = None,
                          chamber: str | None = None) -> DataFrame:
    """Bills with at least one sponsor matching the filter, weighted by the
    number of matching (bill, sponsor, member) rows."""
    m = members
    if party is not None:
        m = m.where(F.col("party") == F.lit(party))
    if state is not None:
        m = m.where(F.col("state") == F.lit(state))
    b = bills
    if chamber is not None:
        b = b.where(F.col("originchamber") == F.lit(chamber))
    sp = sponsors.join(m.select(F.col("bioguideid").alias("sponsor_id")), "sponsor_id")
    return (b.select(F.col("id").alias("bill_id")).join(sp.select("bill_id"), "bill_id")
            .groupBy("bill_id").agg(F.count(F.lit(1)).alias("_w")))


def transitions_filtered(actions: DataFrame, bills: DataFrame, sponsors: DataFrame,
                         members: DataFrame, party: str | None = None, state: str | None = None,
                         chamber: str | None = None, tiebreak: Sequence[str] = (),
                         skew: str = "auto") -> DataFrame:
    """``transitions`` over the bills whose sponsors match party/state and whose
    chamber matches; each step counts once per matching sponsor row (the
    reference's join fan-out) without materialising the fan-out."""
    wts = selected_bill_weights(bills, sponsors, members, party, state, chamber)
    st = _steps(actions, wts, tiebreak, skew)
    return st.groupBy("type", "next_type").agg(_wavg("days").alias("no_days"))


def _type_col_name(t: str) -> str:
    return "became_law" if t == "BecameLaw" else t.lower()


def dwell_crosstab(actions: DataFrame, bills: DataFrame, types: Sequence[str] = ACTION_TYPES,
                   tiebreak: Sequence[str] = (), by_next: bool = True,
                   skew: str = "auto") -> DataFrame:
    """The conditional-average cross-tab: for every listed type X, the mean of
    ``days if type = X else 0`` per (type, next_type) group (next_type is a
    grouping key but not output; ``by_next=False`` groups by type only)."""
    st = _steps(actions, _bill_weights(bills), tiebreak, skew)
    keys = ["type", "next_type"] if by_next else ["type"]
    aggs = [_wavg(F.when(F.col("type") == F.lit(t), F.col("days")).otherwise(F.lit(0)))
            .alias(_type_col_name(t)) for t in types]
    return st.groupBy(*keys).agg(*aggs).drop("next_type")


def transition_matrix(trans: DataFrame, types: Sequence[str]) -> DataFrame:
    """Wide form of ``transitions``: one row per type, one column per next type.
    Pivots the already aggregated (type, next_type) table (at most |types|² rows)."""
    return (trans.groupBy("type").pivot("next_type", list(types))
            .agg(F.first("no_days")))


# --- top-k monthly series ----------------------------------------------------

def _named_monthly(actions: DataFrame, committees: DataFrame, referral_type: str) -> DataFrame:
    """Referral actions counted per (committee name, month).

    Counted per committee id first (partial aggregation makes a heavy committee
    cheap), joined to names only then, and re-summed per name because a name
    need not be unique.
    """
    per_id = (actions.where(F.col("type") == F.lit(referral_type))
              .groupBy("committee", f_date_format("action_date", "YYYY-MM").alias("dt"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    c = committees.select(F.col("id").alias("committee"), "name")
    return (per_id.join(c, "committee").groupBy("name", "dt")
            .agg(F.sum("cnt").cast("bigint").alias("cnt")))


def top_names(named: DataFrame, k: int = 5) -> DataFrame:
    """The k names with most referrals (ties by name), as a k-row DataFrame."""
    return (named.groupBy("name").agg(F.sum("cnt").alias("_total"))
            .orderBy(F.col("_total").desc(), F.col("name").asc_nulls_last()).limit(k)
            .select("name"))


def topk_monthly(actions: DataFrame, committees: DataFrame, k: int = 5,
                 referral_type: str = DEFAULT_REFERRAL_TYPE, year: int | None = None,
                 month_lo: int | None = None, month_hi: int | None = None) -> DataFrame:
    """Monthly referral counts of the top-k committees, ordered by month, count desc.

    The top-k is always global; an optional year/month window filters only the
    series (months are whole, so filtering the monthly aggregate is exact).
    """
    named = _named_monthly(actions, committees, referral_type)
    top = top_names(named, k)
    out = named.join(F.broadcast(top), "name", "left_semi")  # k rows: bounded
    if year is not None:
        lo = max(int(month_lo if month_lo is not None else 1), 1)
        hi = int(month_hi if month_hi is not None else 12)
        out = out.where((F.col("dt") >= F.lit(f"{int(year):04d}-{lo:02d}"))
                        & (F.col("dt") <= F.lit(f"{int(year):04d}-{hi:02d}")))
    return out.select("name", "dt", "cnt").orderBy(
        F.col("dt").asc_nulls_last(), F.col("cnt").desc(), F.col("name").asc_nulls_last())


def topk_monthly_wide(actions: DataFrame, committees: DataFrame, k: int = 5,
                      referral_type: str = DEFAULT_REFERRAL_TYPE, ranked: bool = False) -> DataFrame:
    """``xtabs(cnt ~ dt + name)`` of the top-k series: one row per month, one
    column per top committee, 0 where a committee has no referral that month.

    ``ranked``: fixed column names instead, c1..ck for the counts of the first
    to k-th name in name order and n1..nk for those names.  A NULL name may take
    a place among the top k but matches no row, as with SQL's IN."""
    from caseflow.operators.stats import xtabs
    named = shared_table(_named_monthly(actions, committees, referral_type), "named-monthly")
    # the pivot needs its k column values; k strings is a bounded collect
    names = sorted(r["name"] for r in top_names(named, k).collect() if r["name"] is not None)
    wide = xtabs(named.where(F.col("name").isin(names)), "dt", "name", "cnt", names)
    if not ranked:
        return wide
    count = [F.col(f"`{n}`").alias(f"c{i + 1}") for i, n in enumerate(names)]
    count += [F.lit(None).cast("bigint").alias(f"c{i + 1}") for i in range(len(names), k)]
    label = [F.lit(names[i] if i < len(names) else None).cast("string").alias(f"n{i + 1}") for i in range(k)]
    return wide.select("dt", *count, *label)


# --- single-bill and latest-state views --------------------------------------

def bill_timeline(actions: DataFrame, bill_id, tiebreak: Sequence[str] = (),
                  cols: Sequence[str] = ("text",)) -> DataFrame:
    """The actions of one bill in date order (equality filter pushed to the scan)."""
    return (actions.where(F.col("bill_id") == F.lit(bill_id))
            .orderBy(*sort_exprs(["action_date", *tiebreak])).select(*cols))


def latest_status(actions: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Latest action text per bill (``DISTINCT ON (bill_id) ... ORDER BY action_date DESC``)."""
    ok = order_struct(actions, ["action_date"], tiebreak, desc=True)
    return actions.groupBy("bill_id").agg(F.min_by("text", ok).alias("status"))


def rejected_not_public(actions: DataFrame, reject: str = "REJECT",
                        public: str = "Became Public") -> DataFrame:
    """Actions whose text contains ``reject`` on bills where no action text
    contains ``public`` (case-insensitive).  NOT EXISTS as a left anti join."""
    hit = actions.where(F.upper("text").like(f"%{reject.upper()}%"))
    pub = actions.where(F.upper("text").like(f"%{public.upper()}%")).select("bill_id")
    return hit.join(pub, "bill_id", "left_anti")


def last_by_code(actions: DataFrame) -> DataFrame:
    """Rows at the latest date of their action code, counted per (bill, text).

    The correlated ``max`` becomes an aggregate per code joined on (code, date):
    the composite key spreads well even though there are few codes."""
    m = actions.groupBy("action_code").agg(F.max("action_date").alias("action_date"))
    return (actions.join(m, ["action_code", "action_date"])
            .groupBy("bill_id", "text").agg(F.count(F.lit(1)).alias("cnt")))


def title_stats(titles: DataFrame, col: str = "title") -> DataFrame:
    """Mean characters and mean whitespace-split tokens of the titles."""
    from caseflow.functions.exprs import f_length, f_token_count
    return titles.agg(F.avg(f_length(col)).alias("avg_length"),
                      F.avg(f_token_count(col)).alias("avg_tokens"))


# --- generic event logs ------------------------------------------------------

def directly_follows(log: DataFrame, case: str, time: str, activity: str,
                     tiebreak: Sequence[str] = (), skew: str = "auto") -> DataFrame:
    """Directly-follows graph of any event log: per (activity, next activity),
    how often one follows the other within a case and the mean gap in seconds.
    Same plan as ``transitions``: one shuffle on the case key (heavy cases
    split), then a partial aggregate on the activity pair."""
    ev = log.select(case, time, activity, *tiebreak)
    hot = heavy_keys(log, case) if skew == "auto" else None
    s = lead_step(ev, case, [time], tiebreak, [time, activity], ["_next_t", "next_activity"], skew=skew,
                  hot_keys=hot)
    # timestampdiff works on wall-clock (NTZ) values directly: no session time zone involved
    gap = F.expr(f"timestampdiff(MICROSECOND, `{time}`, `_next_t`)") / F.lit(1e6)
    return (s.where(F.col("next_activity").isNotNull())
            .groupBy(F.col(activity).alias("activity"), "next_activity")
            .agg(F.count(F.lit(1)).alias("cnt"), F.avg(gap).alias("avg_seconds")))
