"""Table sources: canonical schemas, file/JDBC readers and the test-table bindings.

The process tables (``bills``, ``actions``, ``sponsors``, ``members``,
``committees``, ``cosponsors``) are plain DataFrames.  On a real deployment
they come from files or a JDBC database; in the tests they are views over the
driver's TPC-H-like tables (``bind_test_tables``), and the same views exist as
SQL text (``BINDING_CTES``) so an independent SQL engine can run the oracle
queries on the same inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- canonical schemas (reconstructed from how the queries use the tables) ---

BILLS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("bill_type", T.StringType()),
    T.StructField("originchamber", T.StringType()),
    T.StructField("createdate", T.TimestampType()),
    T.StructField("updatedate", T.TimestampType()),
    T.StructField("introduceddate", T.DateType()),
    T.StructField("title", T.StringType()),
])

ACTIONS = T.StructType([
    T.StructField("bill_id", T.StringType()),
    T.StructField("action_date", T.DateType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("action_code", T.StringType()),
    T.StructField("committee", T.StringType()),
])

COMMITTEES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
])

SPONSORS = T.StructType([
    T.StructField("bill_id", T.StringType()),
    T.StructField("sponsor_id", T.StringType()),
])

COSPONSORS = T.StructType([
    T.StructField("bill_id", T.StringType()),
    T.StructField("sponsor_id", T.StringType()),
])

MEMBERS = T.StructType([
    T.StructField("bioguideid", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("state", T.StringType()),
])

SCHEMAS = {
    "bills": BILLS, "actions": ACTIONS, "committees": COMMITTEES,
    "sponsors": SPONSORS, "cosponsors": COSPONSORS, "members": MEMBERS,
}


def read_table(spark: SparkSession, path: str, name: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read one table; with a known ``name`` the schema is declared, not inferred."""
    reader = spark.read.format(fmt)
    if name in SCHEMAS and fmt != "parquet":
        reader = reader.schema(SCHEMAS[name])
    return reader.load(path)


def src_jdbc(spark: SparkSession, url: str, table: str, *, properties: dict | None = None,
             partition_column: str | None = None, lower_bound: int | None = None,
             upper_bound: int | None = None, num_partitions: int | None = None,
             fetchsize: int = 10000) -> DataFrame:
    """Read a database table in parallel ranges (the reference's only data source).

    Connection options come from the caller; nothing is stored here.  With a
    ``partition_column`` Spark issues ``num_partitions`` range queries, so the
    read is spread over the executors instead of one connection.  Filters and
    projections applied afterwards are pushed into the generated SQL.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("fetchsize", str(fetchsize))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC read needs bounds and num_partitions")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    return reader.load()


def table_exists(spark: SparkSession, name: str) -> bool:
    """``dbExistsTable`` counterpart: is a table or view registered under ``name``?"""
    return spark.catalog.tableExists(name)


def scan_all(spark: SparkSession, name: str) -> DataFrame:
    """``SELECT * FROM name`` for a registered table or view."""
    return spark.table(name)


# --- bindings of the process tables to the driver's test tables ---------------

# Fixed values of the test binding: which action type marks a passed bill and
# which one marks a referral (the real data uses BecameLaw / IntroReferral).
TEST_PASS_MARKERS = ("%status%", "%RF%")
TEST_REFERRAL_TYPE = "NO"
# ordering columns that make the action order total on the test binding
TEST_TIEBREAK = ("line_no", "part_id", "committee")
TEST_TYPES = ("AF", "AO", "NF", "NO", "RF", "RO")

# The same views as SQL text, for the oracle (DuckDB dialect, plain ANSI).
BINDING_CTES = """
WITH actions AS (
  SELECT l.l_orderkey AS bill_id, CAST(l.l_shipdate AS DATE) AS action_date,
         l.l_returnflag || l.l_linestatus AS type, p.p_name AS text,
         CAST(l.l_linenumber AS VARCHAR) AS action_code, l.l_suppkey AS committee,
         l.l_linenumber AS line_no, l.l_partkey AS part_id
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
), bills AS (
  SELECT o.o_orderkey AS id, o.o_orderpriority AS bill_type, o.o_orderstatus AS originchamber,
         o.o_orderdate AS createdate, m.updatedate AS updatedate,
         CAST(o.o_orderdate AS DATE) AS introduceddate
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS updatedate
                           FROM lineitem GROUP BY l_orderkey) m
    ON m.l_orderkey = o.o_orderkey
), sponsors AS (
  SELECT o_orderkey AS bill_id, o_custkey AS sponsor_id FROM orders
  UNION ALL
  SELECT o_orderkey AS bill_id, (o_custkey + 7) % (SELECT count(*) FROM customer) AS sponsor_id
  FROM orders WHERE o_orderkey % 2 = 0
), members AS (
  SELECT c.c_custkey AS bioguideid, c.c_mktsegment AS party, n.n_name AS state
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
), committees AS (
  SELECT s_suppkey AS id, s_name AS name FROM supplier
), cosponsors AS (
  SELECT DISTINCT l_orderkey AS bill_id, l_suppkey AS sponsor_id FROM lineitem
), titles AS (
  SELECT p_partkey AS id, p_name AS title FROM part
)
"""


@dataclass
class ProcessTables:
    """The process tables as DataFrames.  Build with ``bind_test_tables`` or directly."""

    bills: DataFrame
    actions: DataFrame
    sponsors: DataFrame
    members: DataFrame
    committees: DataFrame
    cosponsors: DataFrame | None = None
    titles: DataFrame | None = None
    actions_core: DataFrame | None = None  # actions without the text column (no join)

    @property
    def actions_lean(self) -> DataFrame:
        return self.actions_core if self.actions_core is not None else self.actions


class _TestBinding:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def actions_core(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("bill_id"),
            F.col("l_shipdate").cast("date").alias("action_date"),
            F.concat("l_returnflag", "l_linestatus").alias("type"),
            F.col("l_linenumber").cast("string").alias("action_code"),
            F.col("l_suppkey").alias("committee"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_id"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        # part grows with the data: no broadcast hint, AQE decides from sizes
        part = self.raw("part").select(F.col("p_partkey").alias("part_id"),
                                       F.col("p_name").alias("text"))
        return self.actions_core.join(part, "part_id", "left").select(
            "bill_id", "action_date", "type", "text", "action_code", "committee",
            "line_no", "part_id")

    @cached_property
    def bills(self) -> DataFrame:
        li = self.raw("lineitem")
        upd = li.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.max("l_shipdate").alias("updatedate"))
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("bill_type"),
            F.col("o_orderstatus").alias("originchamber"),
            F.col("o_orderdate").alias("createdate"),
            F.col("o_orderdate").cast("date").alias("introduceddate"),
        )
        return o.join(upd, "id", "left").select(
            "id", "bill_type", "originchamber", "createdate", "updatedate", "introduceddate")

    @cached_property
    def sponsors(self) -> DataFrame:
        o = self.raw("orders")
        # the modulus is a scalar subquery (one value), not a join
        n_cust = self.raw("customer").select(F.count(F.lit(1))).scalar()
        first = o.select(F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("sponsor_id"))
        # second sponsor on even bills so the fan-out is exercised
        second = o.where(F.col("o_orderkey") % 2 == 0).select(
            F.col("o_orderkey").alias("bill_id"),
            ((F.col("o_custkey") + 7) % n_cust).alias("sponsor_id"))
        return first.unionByName(second)

    @cached_property
    def members(self) -> DataFrame:
        c = self.raw("customer")
        # nation is a fixed 25-row dimension: broadcasting it is bounded
        n = self.raw("nation").select("n_nationkey", "n_name")
        return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("bioguideid"), F.col("c_mktsegment").alias("party"),
            F.col("n_name").alias("state"))

    @cached_property
    def committees(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def cosponsors(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("bill_id"),
                                           F.col("l_suppkey").alias("sponsor_id")).distinct()

    @cached_property
    def titles(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


def bind_test_tables(spark: SparkSession, sf_dir: str) -> ProcessTables:
    """Process tables as views over the driver's test tables (see FIXTURES.md §5)."""
    b = _TestBinding(spark, sf_dir)
    return ProcessTables(bills=b.bills, actions=b.actions, sponsors=b.sponsors,
                         members=b.members, committees=b.committees,
                         cosponsors=b.cosponsors, titles=b.titles,
                         actions_core=b.actions_core)


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, tables: ProcessTables) -> None:
    """Register the process tables as temp views (for ``spark.sql`` callers)."""
    for name in ("bills", "actions", "sponsors", "members", "committees", "cosponsors", "titles"):
        df = getattr(tables, name)
        if df is not None:
            df.createOrReplaceTempView(name)
