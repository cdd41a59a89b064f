"""SimHash near-dedup with pigeonhole blocks.

Each text gets a 64-bit fingerprint from its word shingles.  Copies collapse to
one row per distinct fingerprint.  Two fingerprints at ``bits`` or fewer
differing bits agree on at least d - ``bits`` of any d blocks, so each
fingerprint is filed under every choice of d - ``bits`` blocks (mask and masked
value); pairs are verified by Hamming distance only within such a bucket.  A
bucket of more than ``MAX_BUCKET`` fingerprints is never paired: its fingerprints
go on to a division into more blocks, and so to longer keys, until at the last
one a bucket has at most 2^12 possible members.  A bucket yields a spanning
forest of its links, not all its pairs; connected components come from
alternating star contractions on the forest.

Defined cases: null, empty and blank texts have no words and fingerprint zero,
linked like any other; rows are fingerprinted one by one; a component's id is
its smallest non-null document id (null if it has none).  Extra columns are
kept in ``row``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

SHINGLE = 3
BITS = 3
SEED = 42
MAX_BUCKET = 512
#: Blocks at each level, and the most distinct fingerprints that a first level is meant for.
LEVELS = [(4, 1 << 20), (6, 1 << 34), (9, 1 << 43), (16, 1 << 62)]
_STEP = 1 << 16


def _shingle_spans(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one blank, start and end of every shingle in them, shingles per text."""
    starts, ends, woffs = C.word_spans(buf, offs, C.NONSPACE)
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = C.LOWER[buf[C.NONSPACE[buf]]]
    words = woffs[1:] - woffs[:-1]
    count = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    first = np.repeat(woffs[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(first + k, np.repeat(woffs[1:], count)) - 1
    return joined.tobytes(), at[first], at[last] + size[last], count


def fingerprints(texts: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is set if over half the shingle hashes have it."""
    buf, offs = C.text_buffer(texts)
    raw, start, end, count = _shingle_spans(buf, offs, k)
    doc = np.repeat(np.arange(len(count)), count)
    sums = np.zeros((len(count), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), _STEP):  # a very long text takes several steps
        h = np.array([digest(raw[a:b], seed) for a, b in zip(start[i:i + _STEP].tolist(), end[i:i + _STEP].tolist())], np.uint64)
        bit = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[i:i + _STEP]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums[of[at]] += np.add.reduceat(bit, at, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, k: int = SHINGLE) -> DataFrame:
    """Written table: ``rid`` (unique), ``row``, ``fp`` (the fingerprint as a signed long)."""
    out = C.annotate(C.packed(docs, text_col, keep), "fp long", lambda texts: [C.signed(fingerprints(texts, k))])
    return C.written(out.select(F.monotonically_increasing_id().alias("rid"), "row", "fp"), "fingerprints")


def _masks(blocks: int, bits: int) -> np.ndarray:
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(cut[i], cut[i + 1])) for i in range(blocks)]
    return np.array([sum(part[i] for i in c) for c in combinations(range(blocks), blocks - bits)], np.uint64)


def _filed(fps: DataFrame, masks: np.ndarray) -> DataFrame:
    """(choice of blocks, masked value, fp) for every choice."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 1 << 12):
                part = fp[i:i + (1 << 12)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(masks), dtype=np.int32), len(part))),
                     C.signed((masks[:, None] & part[None, :]).ravel()), C.signed(np.tile(part, len(masks)))],
                    names=["c", "v", "fp"])

    return fps.select("fp").mapInArrow(run, "c int, v long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _links(bits: int):
    """Buckets (lists of fingerprints) to the links of a spanning forest of their pairs within ``bits`` bits."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.column(0).slice(lo, 2048)
                fp = part.flatten().to_numpy().view(np.uint64)
                size = np.diff(part.offsets.to_numpy())
                end = np.repeat(np.cumsum(size), size)
                at, left, right = np.arange(len(fp)), [], []
                for d in range(1, int(size.max(initial=1))):
                    at = at[at + d < end[at]]
                    near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
                    left.append(near)
                    right.append(near + d)
                if not left:
                    continue
                root = _roots(len(fp), np.concatenate(left), np.concatenate(right))
                x = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([C.signed(fp[x]), C.signed(fp[root[x]])], names=["a", "b"])

    return run


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (distinct column fp) within ``bits`` bits."""
    n = fps.count()
    level = next(i for i, (_, most) in enumerate(LEVELS) if n <= most)
    found = None
    for i in range(level, len(LEVELS)):
        filed = _filed(fps, _masks(LEVELS[i][0], bits))
        size = C.written(filed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        last = i + 1 == len(LEVELS)
        fit = size if last else size.where(F.col("n") <= MAX_BUCKET)
        bucket = filed.join(fit.select("c", "v"), ["c", "v"], "left_semi").groupBy("c", "v").agg(F.collect_list("fp").alias("fps"))
        got = bucket.select("fps").mapInArrow(_links(bits), "a long, b long").distinct()
        found = got if found is None else found.unionByName(got)
        if last:
            break
        full = size.where(F.col("n") > MAX_BUCKET)
        if full.isEmpty():
            break
        fps = C.written(filed.join(full.select("c", "v"), ["c", "v"], "left_semi").select("fp").distinct(), "full-buckets")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: alternating large-star and small-star steps until nothing changes."""
    e = C.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark[0] == 0 or mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain shuffles, and that of a node with very many links is split
        low = C.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = C.written(e, "large-star")  # every u now hangs under a v < u
        low = C.written(e.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        down = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = C.written(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def _components_of(rows: DataFrame, id_col: str, bits: int) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of a ``scan`` table, as a written table."""
    fps = C.written(rows.groupBy("fp").agg(F.min(F.col(f"row.`{id_col}`")).alias("low")), "distinct-fingerprints")
    comp = components(links(fps, bits))
    labelled = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    labelled = C.written(labelled, "labelled-fingerprints")
    ids = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return C.written(labelled.select("fp", "root").join(ids, "root"), "component-ids")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                    k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` as ``row`` with ``rid``, ``fp``, ``root`` (the component's
    fingerprint) and ``component_id`` (its smallest document id)."""
    rows = scan(docs, text_col, keep, k)
    return rows.join(_components_of(rows, id_col, bits), "fp").select("rid", "row", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE,
                bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (a null id
    comes last; among rows that share the id, the first read)."""
    rows = scan(docs, text_col, None, k)
    narrow = rows.select("rid", "fp", F.col(f"row.`{id_col}`").alias("id"))
    narrow = narrow.join(_components_of(rows, id_col, bits), "fp").select("rid", "root", "id")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    first = narrow.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.rid").alias("rid"))
    gone = C.written(narrow.select("rid").join(first, "rid", "left_anti"), "near-copies")
    return rows.join(C.small(gone), "rid", "left_anti").select("row.*")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
