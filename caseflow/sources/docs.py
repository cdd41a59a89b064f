"""Nested bill documents (JSON feed) and plain-text corpora.

The feed is ``{"objects": [bill, ...]}``; each bill carries nested arrays
(major actions, titles, related bills) and structs (sponsor, sponsor role).
The schema is declared, never inferred (several fields are always null, and
inference over them is unstable).  ``json_bills`` reads a file with one task; for
big files use ``feed.json_feed`` or JSON lines (``json_bill_lines``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators.prefix import running_sums

S = T.StringType()
L = T.LongType()

SPONSOR = T.StructType([
    T.StructField("bioguideid", S), T.StructField("id", L), T.StructField("name", S),
    T.StructField("firstname", S), T.StructField("lastname", S), T.StructField("birthday", S),
    T.StructField("gender", S),
])

ROLE_EXTRA = T.StructType([
    T.StructField("address", S), T.StructField("office", S), T.StructField("phone", S),
    T.StructField("fax", S), T.StructField("contact_form", S), T.StructField("rss_url", S),
])

SPONSOR_ROLE = T.StructType([
    T.StructField("party", S), T.StructField("state", S), T.StructField("role_type", S),
    T.StructField("district", L), T.StructField("startdate", S), T.StructField("enddate", S),
    T.StructField("congress_numbers", T.ArrayType(L)), T.StructField("extra", ROLE_EXTRA),
])

BILL = T.StructType([
    T.StructField("id", L), T.StructField("congress", L), T.StructField("number", L),
    T.StructField("bill_type", S), T.StructField("display_number", S),
    T.StructField("introduced_date", S), T.StructField("current_status", S),
    T.StructField("current_status_date", S), T.StructField("current_chamber", S),
    T.StructField("is_alive", T.BooleanType()), T.StructField("is_current", T.BooleanType()),
    T.StructField("title", S), T.StructField("title_without_number", S),
    T.StructField("major_actions", T.ArrayType(T.ArrayType(S))),
    T.StructField("titles", T.ArrayType(T.ArrayType(S))),
    T.StructField("related_bills", T.ArrayType(T.StructType([
        T.StructField("bill", L), T.StructField("relation", S)]))),
    T.StructField("committee_reports", T.ArrayType(S)),
    T.StructField("text_incorporation", T.ArrayType(T.StructType([
        T.StructField("my_ratio", T.DoubleType()), T.StructField("my_version", S),
        T.StructField("other", S), T.StructField("other_ratio", T.DoubleType()),
        T.StructField("other_version", S), T.StructField("text", S)]))),
    T.StructField("sponsor", SPONSOR),
    T.StructField("sponsor_role", SPONSOR_ROLE),
])

FEED = T.StructType([T.StructField("objects", T.ArrayType(BILL))])


def json_bills(spark: SparkSession, path: str) -> DataFrame:
    """One row per bill from feed files ``{"objects": [...]}`` (one task per file)."""
    feed = spark.read.schema(FEED).option("multiLine", True).json(path)
    return feed.select(F.explode("objects").alias("o")).select("o.*")


def json_bill_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per bill from JSON lines (one bill object per line): splittable."""
    return spark.read.schema(BILL).json(path)


def bill_key(display_number: str = "display_number"):
    """'H.R. 5821' -> 'HR5821': the relational bill id."""
    return F.regexp_replace(F.upper(F.col(display_number)), r"[. ]", "")


def _action_date(c):
    """Date of a major action: ``datetime.datetime(Y, M, D, ...)`` text or an ISO date; NULL if it is neither."""
    nums = F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    from_repr = F.concat_ws("-", F.get(nums, F.lit(0)), F.get(nums, F.lit(1)), F.get(nums, F.lit(2))).try_cast("date")
    return F.when(c.startswith("datetime"), from_repr).otherwise(F.substring(c, 1, 10).try_cast("date"))


def json_actions(bills: DataFrame) -> DataFrame:
    """``major_actions`` -> (bill_id, seq, action_date, code, text, state); entries may be short."""
    a = bills.select(bill_key().alias("bill_id"), F.posexplode("major_actions").alias("seq", "a"))
    at = lambda i: F.get("a", F.lit(i))
    return a.select(
        "bill_id", "seq", _action_date(at(0)).alias("action_date"), at(1).alias("code"), at(2).alias("text"),
        F.nullif(F.regexp_extract(at(3), r'state="([^"]*)"', 1), F.lit("")).alias("state"))


def json_titles(bills: DataFrame) -> DataFrame:
    """``titles`` -> (bill_id, seq, kind, stage, title)."""
    t = bills.select(bill_key().alias("bill_id"), F.posexplode("titles").alias("seq", "t"))
    return t.select("bill_id", "seq", F.get("t", F.lit(0)).alias("kind"), F.get("t", F.lit(1)).alias("stage"),
                    F.get("t", F.lit(2)).alias("title"))


def json_related(bills: DataFrame) -> DataFrame:
    """``related_bills`` -> edge rows (bill_id, related_id, relation); bills without any keep one NULL row."""
    r = bills.select(bill_key().alias("bill_id"), F.explode_outer("related_bills").alias("r"))
    return r.select("bill_id", F.col("r.bill").alias("related_id"), F.col("r.relation").alias("relation"))


def json_members(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sponsor`` + ``sponsor_role`` -> (members, sponsors).

    A member appears in many bills; the member row kept is the one of the
    latest role start date (``max_by``: an aggregate, no group is buffered).
    Party is reduced to its initial (Democrat -> D)."""
    s = bills.select(bill_key().alias("bill_id"), "sponsor", "sponsor_role").where(
        F.col("sponsor.bioguideid").isNotNull())
    sponsors = s.select("bill_id", F.col("sponsor.bioguideid").alias("sponsor_id")).distinct()
    rec = F.struct(F.substring("sponsor_role.party", 1, 1).alias("party"),
                   F.col("sponsor_role.state").alias("state"),
                   F.col("sponsor.name").alias("name"),
                   F.col("sponsor.birthday").try_cast("date").alias("birthday"))
    members = (s.groupBy(F.col("sponsor.bioguideid").alias("bioguideid"))
               .agg(F.max_by(rec, F.col("sponsor_role.startdate")).alias("m"))
               .select("bioguideid", "m.*"))
    return members, sponsors


def src_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one title per line, with the line's number over all files: files in
    path order, a file's blocks by offset, lines as they stand."""
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("n")).alias("place"), F.lit(1).cast("long").alias("one"))
    return running_sums(lines, "place", ["one"]).select(F.col("one_before").alias("id"), F.col("value").alias("text"))
