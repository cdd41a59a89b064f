"""One big JSON feed read by many tasks.

A multi-line JSON file is parsed by a single task.  Here a feed
``{"objects": [bill, ...]}`` is read in pieces that end at every ``}``, which
Spark's text reader splits by bytes like lines.  Whether a piece starts inside a
string, at which bracket depth, and inside the ``objects`` array or not follows
from running sums over the pieces: a window inside each file block, and a table
of one row per block for what the blocks before it add up to.  A bill is the run
of pieces from one closing at depth 2 to the next, and is parsed on its own.

A piece never starts behind half an escape (``\\}`` is no JSON escape), so of all
that lies before it only the parity of the quotes, the depth and the last change
of the array matter.

Defined cases: files may hold several feeds after one another, other keys beside
``objects`` at any depth, and any white space; an empty file has no bills;
elements of ``objects`` that are no JSON objects are left out; a feed that is cut
off gives the bills up to the cut.  Files are UTF-8.  A compressed file is one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseflow.session import shared_table
from caseflow.sources.docs import BILL

#: Stands for ``"objects": [`` in a skeleton: the one opening bracket that is told from the others.
ARRAY = "@"


def _skeleton(marked):
    """The brackets of a piece that starts outside strings, without what strings hold."""
    return F.regexp_replace(F.regexp_replace(marked, r'"[^"]*+(?:"|\z)', ""), rf"[^\[\]{{}}{ARRAY}]+", "")


def _depth(skeleton):
    """Openings minus closings; a piece holds no ``}`` before its end."""
    opened = F.length(F.translate(skeleton, "]", ""))
    return 2 * opened - F.length(skeleton)


def _pieces(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, block, n, text, quotes, and for a start outside or inside a string: skeleton and change of depth)."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes every quote opens or closes
    p = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"), bare.alias("bare"))
    quotes = (F.length("bare") - F.length(F.translate("bare", '"', ""))) % 2
    marked = F.regexp_replace("bare", rf'"{key}"\s*+:\s*+\[', ARRAY)
    p = p.select("file", "block", "n", "text", quotes.alias("q"), _skeleton(marked).alias("k0"),
                 _skeleton(F.concat(F.lit('"'), marked)).alias("k1"))
    # the closing bracket at the end counts if the piece ends outside strings
    return p.select("*", (_depth(F.col("k0")) - (F.col("q") == 0).cast("int")).alias("d0"),
                    (_depth(F.col("k1")) - (F.col("q") == 1).cast("int")).alias("d1"))


def _before(*order):
    return Window.partitionBy("file", *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(col, window):
    return F.coalesce(F.sum(col).over(window), F.lit(0))


def _with_blocks(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    return pieces.join(blocks, ["file", "block"])


def json_objects(spark: SparkSession, path: str, key: str = "objects") -> DataFrame:
    """The text of every object in the root array ``key`` of the feeds under ``path``:
    (file, place, text), ``place`` counting the objects that end at depth 2 before it in its file."""
    pieces = shared_table(_pieces(spark, path, key), "feed-pieces")
    inside, over_blocks = _before("block", "n"), _before("block")

    # is a block entered inside a string, and at which depth
    flip = pieces.withColumn("p", _sum_before("q", inside) % 2)
    blocks = flip.groupBy("file", "block").agg(
        F.sum("q").alias("q"), F.sum(F.when(F.col("p") == 0, F.col("d0")).otherwise(F.col("d1"))).alias("d0"),
        F.sum(F.when(F.col("p") == 0, F.col("d1")).otherwise(F.col("d0"))).alias("d1"))
    blocks = blocks.withColumn("s", _sum_before("q", over_blocks) % 2)
    blocks = shared_table(blocks.select("file", "block", F.col("s").alias("block_s"), _sum_before(
        F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")), over_blocks).alias("block_d")), "feed-blocks")

    known = _with_blocks(flip, blocks)
    known = known.withColumn("s", (F.col("p") + F.col("block_s")) % 2)
    known = known.select("file", "block", "n", "text", ((F.col("s") + F.col("q")) % 2 == 0).alias("outside"),
                         F.when(F.col("s") == 0, F.col("k0")).otherwise(F.col("k1")).alias("k"),
                         F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")).alias("d"), "block_d")
    known = known.withColumn("depth", F.col("block_d") + _sum_before("d", inside))
    # the array opens where its key stands in the root object, which can only be the first mark of a
    # piece (leaving a deeper object takes a closing bracket), and ends where its depth is left
    at = F.instr("k", ARRAY)
    opens = (at > 0) & (F.col("depth") + _depth(F.substring_index("k", ARRAY, 1)) == 1)
    change = (F.when(opens, F.col("k").substr(at + 1, F.lit(1)) != "]")
              .when((F.col("depth") == 2) & F.col("k").startswith("]"), F.lit(False)))
    known = known.select("file", "block", "n", "text", opens.alias("opens"), change.alias("change"),
                         (F.col("outside") & (F.col("depth") + F.col("d") == 2)).alias("ends"))

    # how many ends lie before a block, and is it entered inside the array
    ends = F.col("ends").cast("long")
    totals = known.groupBy("file", "block").agg(
        F.sum(ends).alias("e"), F.max_by("change", F.when(F.col("change").isNotNull(), F.col("n"))).alias("c"))
    totals = shared_table(totals.select(
        "file", "block", _sum_before("e", over_blocks).alias("block_e"),
        F.coalesce(F.last("c", ignorenulls=True).over(over_blocks), F.lit(False)).alias("block_c")), "feed-totals")
    so_far = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_blocks(known, totals).select(
        "file", "block", "n", "text", "opens", "ends", (F.col("block_e") + _sum_before(ends, inside)).alias("place"),
        ((F.col("block") > 0) & (_sum_before(ends, inside) == 0)).alias("first"),
        F.coalesce(F.last("change", ignorenulls=True).over(so_far), F.col("block_c")).alias("in_array"))
    own = F.when(F.col("opens"), F.regexp_replace("text", rf'(?s)\A.*?(?<!\\)"{key}"\s*:\s*\[', "")).otherwise(F.col("text"))
    # the group is one object's text. All but the objects that cross a block border come together
    # where the windows have left their pieces, so the texts are shuffled once more for those only
    rows = rows.where("in_array")

    def joined(parts):
        return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["t"]), "}")

    runs = rows.groupBy("file", "block", "place").agg(
        F.max("ends").alias("ends"), F.min("first").alias("first"), joined(F.struct("n", own.alias("t"))).alias("t"))
    # a run may go on from the block before if it starts its block, or into the next if it has no end
    crosses = F.col("first") | ~F.col("ends")
    border = runs.where(crosses).groupBy("file", "place").agg(
        F.max("ends").alias("ends"), joined(F.struct("block", "t")).alias("t"))
    whole = runs.where(~crosses).select("file", "place", "t").unionByName(border.where("ends").select("file", "place", "t"))
    text = F.regexp_replace(F.concat("t", F.lit("}")), r"\A[^{]*+", "")
    return whole.select("file", "place", text.alias("text"))


def json_feed(spark: SparkSession, path: str, schema: StructType = BILL) -> DataFrame:
    """One row per bill, as ``docs.json_bills``, with a big file read by many tasks."""
    return json_objects(spark, path).select(F.from_json("text", schema).alias("o")).select("o.*")
