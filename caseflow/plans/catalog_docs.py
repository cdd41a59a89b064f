"""Registered queries of the nested JSON source: bill documents are built from the
test tables, written as JSON text, parsed with the declared schema and flattened;
the SQL twins read the flat tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.plans.catalog import register
from caseflow.session import ensure_checkpoint_dir, note_shared
from caseflow.sources import docs, feed
from caseflow.sources.tables import raw_table

#: Documents of one feed file of ``json_feed``.
FEED_BILLS = 4096


def bill_texts(spark, d) -> DataFrame:
    """One JSON document per order: its lines are the actions (dates as text in two forms, the
    seventh line's unreadable), its priority and status the titles, its customer the sponsor."""
    o, c, n = (raw_table(spark, d, t) for t in ("orders", "customer", "nation"))
    line = raw_table(spark, d, "lineitem")
    def entry(x):
        day, number = x["l_shipdate"].cast("date"), x["l_linenumber"]
        text = (F.when(number == 7, F.lit("unknown day"))
                .when(number % 2 == 1, F.concat(F.lit("datetime.datetime("), F.year(day), F.lit(", "), F.month(day), F.lit(", "),
                                                F.dayofmonth(day), F.lit(", 0, 0)")))
                .otherwise(day.cast("string")))
        flag = x["l_returnflag"]
        state = F.when(flag == "N", F.lit("<action/>")).otherwise(F.concat(F.lit('<action state="'), flag, F.lit('"/>')))
        return F.array(text, number.cast("string"), x["l_linestatus"], state)

    # lines travel as columns and become text when an order has them all; the sponsor joins the short rows first
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")))
    actions = line.groupBy("l_orderkey").agg(lines.alias("lines"))
    doc = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    doc = doc.join(actions, F.col("o_orderkey") == actions.l_orderkey, "left").withColumn("major_actions", F.transform("lines", entry))
    key = F.col("o_orderkey")
    return doc.select(F.to_json(F.struct(
        key.alias("id"), F.concat(F.lit("H.R. "), key).alias("display_number"), F.col("o_orderstatus").alias("current_status"),
        F.col("o_orderdate").cast("date").cast("string").alias("introduced_date"), F.col("major_actions"),
        F.array(F.array(F.lit("short"), F.lit(None), F.col("o_orderpriority")), F.array(F.lit("official"), F.lit("introduced"), F.col("o_orderstatus"))).alias("titles"),
        F.when(key % 3 == 0, F.array(F.struct((key + 1).alias("bill"), F.lit("next").alias("relation")))).alias("related_bills"),
        F.struct(F.concat(F.lit("C"), "o_custkey").alias("bioguideid"), F.col("c_name").alias("name"),
                 F.when(F.col("c_custkey") % 2 == 0, F.lit("1960-02-03")).otherwise(F.lit("not known")).alias("birthday")).alias("sponsor"),
        F.struct(F.col("c_mktsegment").alias("party"), F.col("n_name").alias("state"),
                 F.col("o_orderdate").cast("date").cast("string").alias("startdate")).alias("sponsor_role"))).alias("j"))


def nested_bills(spark, d) -> DataFrame:
    return bill_texts(spark, d).select(F.from_json("j", docs.BILL).alias("o")).select("o.*")


def written_feeds(spark, d) -> str:
    """The folder of feed files ``{"meta": ..., "objects": [...]}`` with about ``FEED_BILLS`` documents each."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feeds-{uuid.uuid4().hex}"
    n = -(-raw_table(spark, d, "orders").count() // FEED_BILLS) or 1
    feeds = bill_texts(spark, d).groupBy(F.pmod(F.xxhash64("j"), F.lit(n)).alias("f")).agg(F.concat(
        F.lit('{"meta": {"number": '), F.count("j"), F.lit('},\n"objects": ['), F.array_join(F.collect_list("j"), ",\n"), F.lit("]}")).alias("value"))
    feeds.select("value").write.text(path)
    note_shared(path)
    return path


@register("json_bills", """
SELECT o_orderkey AS id, 'HR' || o_orderkey AS bill_id, o_orderstatus AS current_status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS introduced_date,
       CAST(count(l_linenumber) AS INTEGER) AS n_actions
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""", ctes=False)
def q_json_bills(spark, d):
    return nested_bills(spark, d).select("id", docs.bill_key().alias("bill_id"), "current_status", "introduced_date",
                                         F.size(F.coalesce("major_actions", F.array().cast("array<array<string>>"))).alias("n_actions"))


@register("json_feed", """
SELECT o_orderkey AS id, 'HR' || o_orderkey AS bill_id, o_orderstatus AS current_status, c_name AS sponsor, c_mktsegment AS party,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS related_id, CAST(count(l_linenumber) AS INTEGER) AS n_actions
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""", ctes=False)
def q_json_feed(spark, d):
    """Feed files read back in pieces, each file by many tasks."""
    b = feed.json_feed(spark, written_feeds(spark, d))
    return b.select("id", docs.bill_key().alias("bill_id"), "current_status", F.col("sponsor.name").alias("sponsor"),
                    F.col("sponsor_role.party").alias("party"), F.get("related_bills", F.lit(0))["bill"].alias("related_id"),
                    F.size(F.coalesce("major_actions", F.array().cast("array<array<string>>"))).alias("n_actions"))


@register("json_actions", """
SELECT 'HR' || l_orderkey AS bill_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS seq,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS action_date, CAST(l_linenumber AS VARCHAR) AS code,
       l_linestatus AS text, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS state
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""", ctes=False)
def q_json_actions(spark, d):
    return docs.json_actions(nested_bills(spark, d))


@register("json_titles", """
SELECT 'HR' || o_orderkey AS bill_id, CAST(seq AS INTEGER) AS seq, CASE seq WHEN 0 THEN 'short' ELSE 'official' END AS kind,
       CASE seq WHEN 1 THEN 'introduced' END AS stage, CASE seq WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS title
FROM orders JOIN customer ON c_custkey = o_custkey, range(2) r(seq)""", ctes=False)
def q_json_titles(spark, d):
    return docs.json_titles(nested_bills(spark, d))


@register("json_related", """
SELECT 'HR' || o_orderkey AS bill_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS related_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'next' END AS relation
FROM orders JOIN customer ON c_custkey = o_custkey""", ctes=False)
def q_json_related(spark, d):
    return docs.json_related(nested_bills(spark, d))


@register("json_members", """
SELECT DISTINCT 'C' || c_custkey AS bioguideid, substr(c_mktsegment, 1, 1) AS party, n_name AS state, c_name AS name,
       CASE WHEN c_custkey % 2 = 0 THEN DATE '1960-02-03' END AS birthday
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""", ctes=False)
def q_json_members(spark, d):
    return docs.json_members(nested_bills(spark, d))[0]


@register("json_sponsors", """
SELECT DISTINCT 'HR' || o_orderkey AS bill_id, 'C' || c_custkey AS sponsor_id FROM orders JOIN customer ON c_custkey = o_custkey""", ctes=False)
def q_json_sponsors(spark, d):
    return docs.json_members(nested_bills(spark, d))[1]
