"""Step-transition graph: edge list and node list derived from ``transitions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_edges(trans: DataFrame, src: str = "type", dst: str = "next_type") -> DataFrame:
    """Directed edges (from, to): the transition table without its measure."""
    return trans.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Node set = distinct edge endpoints, with out- and in-degree.

    One aggregate over the endpoints of each edge (two rows per edge through
    ``explode``), so the edge list is read once."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.sum("e.o").cast("bigint").alias("out_degree"),
        F.sum("e.i").cast("bigint").alias("in_degree"))
