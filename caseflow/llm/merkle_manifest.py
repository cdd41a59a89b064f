"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Every row is a leaf (hash of its fields).  Per group (source) the leaves in the
order of their id are hashed in runs of ``ARITY`` up to a subroot; the subroots in
the order of their groups likewise give the root.

Proofs: a node holds the segment of siblings from itself up to an ancestor, and a
pointer to that ancestor; it starts at its parent.  In each round the nodes are
joined with themselves on the pointer, so every node appends the segment of its
ancestor and points twice as far, until all point past the root.  Leaves, of
which there are sixteen to each run, take part in the last join only: one row for
a run of leaves fetches the finished segment of the run's node.

No group is ever in one task: leaves are cut into ranges of the order (group, id),
places in a group are counted per range, and runs of leaves and nodes are small
groups of their own.  At a distance of d levels at most ``ARITY`` ** d nodes
point to one ancestor; pointers to the root itself are finished, not joined.

Defined cases: fields are hashed as ``-`` if null, else byte count, ``:`` and value;
a null group or id comes first; rows with the same group and id are separate
leaves in the order of their hash, so equal rows have equal leaves and proofs of
their own; a lone leaf is its own subroot, a lone subroot the root; an empty table
gives no rows.  Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import common as C

ARITY = 16
#: Rows that one task orders at most, and those worth a task of their own.
RANGE_ROWS, LEAST_ROWS = 1 << 20, 1 << 12
#: Number of the tree above the subroots.
TOP = -1


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def _ordered(leaves: DataFrame) -> DataFrame:
    """Written leaves with ``_range``: consecutive ranges of bounded size in the order of the manifest."""
    whole = C.written(leaves.withColumn("tie", F.monotonically_increasing_id()), "manifest-leaves")
    rows = whole.count()
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-rows // RANGE_ROWS), min(tasks, -(-rows // LEAST_ROWS)))
    if n <= 1:
        return whole.withColumn("_range", F.lit(0))
    order = [F.col(c).asc_nulls_first() for c in ("tree_key", "id", "leaf", "tie")]
    return C.written(whole.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "manifest-ranges")


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves with ``tree`` (number of their group in order), ``pos`` (place in it) and ``n`` (leaves
    of the group); also the number of groups and the leaves of the largest."""
    rows = _ordered(leaves)
    per = C.written(rows.groupBy("_range", "tree_key").agg(F.count("*").alias("here")), "manifest-counts")
    # one row per range and group: what earlier ranges hold of the group
    w = Window.partitionBy("tree_key").orderBy("_range")
    before = F.coalesce(F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_range", "tree_key", before.alias("base"), F.sum("here").over(Window.partitionBy("tree_key")).alias("n"))
    # number of a group: groups that begin in earlier ranges, and earlier in its own
    begin = per.where("base = 0")
    starts = begin.groupBy("_range").agg(F.count("*").alias("starts"))
    starts = starts.select("_range", F.coalesce(F.sum("starts").over(  # one row per range
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("tree_key").asc_nulls_first()))
    tree = begin.select("tree_key", "_range", (nth - 1).alias("nth")).join(starts, "_range")
    tree = tree.select("tree_key", (F.col("first") + F.col("nth")).cast("long").alias("tree"))
    per = C.written(_null_safe(per, tree, ["tree_key"]), "manifest-bases")
    trees, largest = per.agg(F.max("tree") + 1, F.max("n")).first()
    at = F.row_number().over(Window.partitionBy("_range", "tree_key").orderBy(*[F.col(c).asc_nulls_first() for c in ("id", "leaf", "tie")]))
    rows = rows.select("_range", "tree_key", "row", "leaf", "other", (at - 1).alias("at"))
    rows = _null_safe(rows, per, ["_range", "tree_key"])
    return rows.select("tree", (F.col("base") + F.col("at")).alias("pos"), "n", "row", "leaf", "other"), trees or 0, largest or 0


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_k{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_k{k}"]) for k in keys]
    return left.join(right, on).drop(*[f"_k{k}" for k in keys])


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _siblings(kids: Column, slot: Column) -> Column:
    """Segment of one step: the hashes left and right of a place in its run."""
    return F.struct(_joined(F.slice(kids, 1, slot)).alias("l"), _joined(F.slice(kids, slot + 2, ARITY)).alias("r"))


def fold(start: Column, segments: Column) -> Column:
    """The hash that a leaf and the segments above it lead to."""
    return F.aggregate(segments, start, lambda h, s: digest(s["l"], h, s["r"]))


def proof_text(segments: Column) -> Column:
    return _joined(F.transform(segments, lambda s: F.concat(s["l"], s["r"])))


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of consecutive nodes (tree, pos, n, digest) as the nodes of the next level, which is ``level``."""
    run = nodes.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("idx"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("m"))
    kids = F.col("m.digest")
    return run.select("tree", F.lit(level).alias("level"), "idx", F.ceil(F.col("n") / ARITY).alias("n"), kids.alias("kids"),
                      digest(_joined(kids)).alias("digest"))


def _forest(base: DataFrame, trees: int, largest: int) -> DataFrame:
    """All nodes above the leaves: key (tree, level, idx), ``kids``, ``digest``, key of the parent
    (null at the root), ``slot`` (place in the parent's run) and ``sub`` (own hash, if a subroot)."""
    levels, tree = [], base
    while True:
        levels.append(tree)
        if -(-largest // ARITY) <= 1:
            break
        largest = -(-largest // ARITY)
        nodes = tree.where("n > 1").withColumnRenamed("idx", "pos")
        tree = C.written(_runs(nodes, len(levels)), "manifest-level")
    forest = levels[0]
    for x in levels[1:]:
        forest = forest.unionByName(x)
    roots = forest.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest")
    level = 0
    while trees > 1:
        top = C.written(_runs(roots, level), "manifest-top")
        forest = forest.unionByName(top)
        roots = top.withColumnRenamed("idx", "pos").drop("level", "kids")
        trees, level = -(-trees // ARITY), level + 1
    in_tree = F.col("tree") != TOP
    sub = in_tree & (F.col("n") == 1)
    at = F.when(sub, F.col("tree")).otherwise(F.col("idx"))
    up = ~((F.col("n") == 1) & ~in_tree) if level else ~sub
    return forest.select(
        "tree", "level", "idx", "kids", "digest",
        F.when(up, F.when(sub, F.lit(TOP)).otherwise(F.col("tree"))).cast("long").alias("ptree"),
        F.when(up, F.when(sub, F.lit(0)).otherwise(F.col("level") + 1)).cast("int").alias("plevel"),
        F.when(up, F.floor(at / ARITY)).cast("long").alias("pidx"), (at % ARITY).cast("int").alias("slot"),
        F.when(sub, F.col("digest")).alias("sub"))


KEY = ["tree", "level", "idx"]


def _segments(forest: DataFrame) -> tuple[DataFrame, str]:
    """(key, ``segments`` up to the root, ``sub``) of every node, and the root's hash."""
    root = forest.where("ptree is null").first()["digest"]
    parent = forest.select(*[F.col(k).alias(f"p{k}") for k in KEY], F.col("kids").alias("pkids"), F.col("sub").alias("psub"),
                           *[F.col(f"p{k}").alias(f"a{k}") for k in KEY])
    one = forest.where("ptree is not null").join(parent, [f"p{k}" for k in KEY])
    one = one.select(*KEY, F.array(_siblings(F.col("pkids"), F.col("slot"))).alias("segments"), F.coalesce("sub", "psub").alias("sub"),
                     # a pointer to the root is finished
                     *[F.when(F.col("atree").isNotNull(), F.col(f"p{k}")).alias(f"a{k}") for k in KEY])
    top = forest.where("ptree is null").select(*KEY, F.array().cast(one.schema["segments"].dataType).alias("segments"), "sub",
                                               *[F.lit(None).cast(one.schema[f"a{k}"].dataType).alias(f"a{k}") for k in KEY])
    nodes, distance = C.written(one.unionByName(top), "manifest-pointers"), 1
    while not nodes.where("atree is not null").isEmpty():
        far = nodes.where((F.col("tree") == TOP) | (F.col("level") >= distance))  # all that can be pointed to
        far = C.small(far.select(*[F.col(k).alias(f"a{k}") for k in KEY], F.col("segments").alias("more"), F.col("sub").alias("asub"),
                                 *[F.col(f"a{k}").alias(f"b{k}") for k in KEY]),
                      F.size("more") * 64 * ARITY + 128)
        jump = nodes.where("atree is not null").join(far, [f"a{k}" for k in KEY])
        jump = jump.select(*KEY, F.concat("segments", "more").alias("segments"), F.coalesce("sub", "asub").alias("sub"),
                           *[F.col(f"b{k}").alias(f"a{k}") for k in KEY])
        nodes = C.written(nodes.where("atree is null").unionByName(jump), "manifest-pointers")
        distance *= 2
    return nodes, root


def manifest(docs: DataFrame, fields: Sequence[str], tree_col: str = "source", id_col: str = "doc_id",
             tampered: dict[str, Column] | None = None, where: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row's ``row`` (kept columns; by default the id), ``leaf``, ``subroot``, ``root``, ``segments``
    (siblings left and right, level by level), ``folded`` and ``verified``.

    ``tampered`` and ``where`` stand for a copy to check: in rows where the condition
    holds, the named fields have other values there.  ``folded`` is the root that a
    row's copy and the manifest's proof lead to; ``verified`` tells whether it is the root."""
    spark = docs.sparkSession
    value = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_hash([value[f] for f in fields])
    other = F.lit(None).cast("string")
    if tampered:
        other = F.when(where if where is not None else F.lit(True), leaf_hash([tampered.get(f, value[f]) for f in fields]))
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or [id_col])])
    leaves = docs.select(F.col(f"`{tree_col}`").cast("string").alias("tree_key"), F.col(f"`{id_col}`").alias("id"),
                         row.alias("row"), leaf.alias("leaf"), other.alias("other"))
    rows, trees, largest = _numbered(leaves)
    run = rows.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("idx"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "leaf", "other", "row"))).alias("m"))
    runs = C.written(run, "manifest-runs")
    lone = F.col("n") == 1  # a lone leaf is the node itself
    base = runs.select("tree", F.lit(0).alias("level"), "idx", F.ceil(F.col("n") / ARITY).alias("n"), F.col("m.leaf").alias("kids"),
                       F.when(lone, F.col("m.leaf")[0]).otherwise(digest(_joined(F.col("m.leaf")))).alias("digest"))
    if not trees:
        none = runs.select(F.lit(None).cast(leaves.schema["row"].dataType).alias("row"))
        return none.select("row", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], F.array(F.struct(F.lit("").alias("l"), F.lit("").alias("r"))).alias("segments"),
                           F.lit("").alias("folded"), F.lit(True).alias("verified"))
    nodes, root = _segments(_forest(base, trees, largest))
    mine = nodes.where(f"level = 0 and tree <> {TOP}").select("tree", "idx", "segments", "sub")
    out = runs.join(mine, ["tree", "idx"])
    kids = F.col("m.leaf")
    out = out.select("n", "sub", "segments", kids.alias("kids"), F.posexplode("m").alias("slot", "x"))
    own = F.when(F.col("n") == 1, F.col("segments")).otherwise(F.concat(F.array(_siblings(F.col("kids"), F.col("slot"))), "segments"))
    out = out.select("x.row", "x.leaf", F.col("sub").alias("subroot"), F.lit(root).alias("root"), own.alias("segments"), "x.other")
    out = out.withColumn("folded", fold(F.coalesce("other", "leaf"), F.col("segments")))
    return out.select("row", "leaf", "subroot", "root", "segments", "folded", (F.col("folded") == F.col("root")).alias("verified"))
