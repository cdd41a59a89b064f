"""Approximate nearest neighbours by multi-index hashing.

A rotation is learned on a bounded sample (iterative quantisation: alternate
the sign code and the rotation nearest to it); the signs of the rotated vector
are its binary code, cut into substrings.  All rows are indexed: they are dealt
into blocks, and a block keeps a table per substring from each occurring value
to its rows.  A code within Hamming radius r = ``TABLES`` * s + t of the query's
agrees within s in one of the first t + 1 substrings or within s - 1 in another,
so probing every occurring value at those distances retrieves every code within
the radius.  Those are checked by their whole code and reranked by the cosine of
the original vectors; each block gives its best k per query, which are merged.

The radius is the smallest that finds ``SAMPLE_RECALL`` of the true neighbours of
sampled queries within the sample; neighbours in the whole data are nearer.

Queries are a stated set, handled in blocks of ``QUERY_BLOCK`` (one broadcast
each), so nothing that grows with the data is broadcast at once.

Defined cases: vectors that are null, zero, not of the most frequent length (the
longer of two equally frequent ones), or hold a null or non-finite component
take no part; a row with a null id takes no part; rows that repeat an id are
separate candidates, except that a query's own id is never its candidate; ties
go to the smaller id; a query with fewer than k candidates within the radius
takes all candidates instead.  Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import common as C

TABLES = 4
MAX_BITS = 64
SAMPLE_ROWS = 6000
SAMPLE_QUERIES = 300
SAMPLE_RECALL = 0.98
BLOCK = 8192
QUERY_BLOCK = 2048
_STEP = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns id and vec (array of double) of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(fine & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (size.n if size else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors, each times the power of two that brings its largest component to 0.5 to 1: no
    angle and no digit of a cosine changes, and no square leaves the range of a double."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


class Codes:
    """Rotation, substrings and probing radii."""

    def __init__(self, rotation: np.ndarray, radius: int):
        self.rotation, self.bits = rotation, rotation.shape[1]
        self.cut = [self.bits * i // TABLES for i in range(TABLES + 1)]
        self.radius = radius

    def encode(self, x: np.ndarray) -> np.ndarray:
        bit = (x @ self.rotation) >= 0
        return (bit.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def part(self, code: np.ndarray, j: int) -> np.ndarray:
        return (code >> np.uint64(self.cut[j])) & np.uint64((1 << (self.cut[j + 1] - self.cut[j])) - 1)

    def reach(self, j: int) -> int:
        """Distance to probe at in substring j (-1: none)."""
        s, t = divmod(self.radius, TABLES)
        return s if j <= t else s - 1


def learn(sample: np.ndarray, k: int = 5, rounds: int = 40, seed: int = 1) -> Codes:
    """Rotation and radius from a bounded sample of vectors."""
    d = sample.shape[1]
    bits = min(MAX_BITS, d)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    base = axes[:, ::-1][:, :bits]
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    low = unit @ base
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ vt).T
    codes = Codes(base @ turn, bits)
    code = codes.encode(sample)
    at = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
    far = []
    for i in at:
        near = unit @ unit[i]
        near[i] = -2
        if len(near) > 1:
            top = np.argsort(-near, kind="stable")[: min(k, len(near) - 1)]
            far += np.bitwise_count(code[top] ^ code[i]).tolist()
    codes.radius = int(np.quantile(far, SAMPLE_RECALL, method="higher")) if far else bits
    return codes


def _best(score: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((ids, -score, of))
    at = np.searchsorted(of[order], np.arange(n + 1))
    return [(ids[order[a:min(b, a + k)]], score[order[a:min(b, a + k)]]) for a, b in zip(at, at[1:])]


class Block:
    """A block of rows with its substring tables."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, codes: Codes):
        self.ids, self.vecs, self.codes = ids, vecs, codes
        self.norm = np.sqrt((vecs * vecs).sum(1))
        self.code = codes.encode(vecs)
        self.tables = [np.unique(codes.part(self.code, j), return_inverse=True) for j in range(TABLES)]

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) within the radius, for the codes of some queries."""
        mask = np.zeros((len(code), len(self.ids)), bool)
        for j, (values, row) in enumerate(self.tables):
            reach = self.codes.reach(j)
            if reach >= 0:
                mask |= (np.bitwise_count(self.codes.part(code, j)[:, None] ^ values[None, :]) <= reach)[:, row]
        q, r = np.nonzero(mask)
        near = np.bitwise_count(code[q] ^ self.code[r]) <= self.codes.radius
        return q[near], r[near]

    def search(self, qid: np.ndarray, qvec: np.ndarray, k: int, everything: bool = False) -> list:
        """Per query: ids and cosines of the block's best k rows, and the number of candidates."""
        qnorm = np.sqrt((qvec * qvec).sum(1))
        code = self.codes.encode(qvec)
        out = []
        for i in range(0, len(qid), _STEP):
            part = slice(i, i + _STEP)
            n = len(qid[part])
            if everything:
                q, r = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(len(self.ids)), indexing="ij"))
            else:
                q, r = self.candidates(code[part])
            other = self.ids[r] != qid[part][q]
            q, r = q[other], r[other]
            dot = (qvec[part][q] * self.vecs[r]).sum(1)
            score = dot / (qnorm[part][q] * self.norm[r])
            out += _best(score, self.ids[r], q, n, k)
        return out


def _searched(rows: DataFrame, qid: np.ndarray, qvec: np.ndarray, codes: Codes, k: int, everything: bool = False) -> DataFrame:
    bc = rows.sparkSession.sparkContext.broadcast((qid, qvec, codes))

    def run(batches):
        qid, qvec, codes = bc.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                block = Block(part.column(0).to_numpy(), _matrix(part.column(1)), codes)
                got = block.search(qid, qvec, k, everything)
                count = [len(x) for x, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, count)), pa.array(np.concatenate([x for x, _ in got])),
                     pa.array(np.concatenate([s for _, s in got]))], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k nearest found."""
    rows = C.written(usable(vectors, id_col, vec_col), "vectors")
    # the smallest hashes first (eight bytes a row), then only those rows
    keyed = rows.withColumn("h", F.xxhash64("id", "vec"))
    first = [r.h for r in keyed.select("h").distinct().orderBy("h").limit(sample_rows).collect()]
    if not first:
        return _none(rows.sparkSession)
    sample = keyed.where(F.col("h") <= first[-1]).groupBy("h").agg(F.min("vec").alias("vec")).orderBy("h").toArrow()
    codes = learn(_matrix(sample.column("vec").combine_chunks()), k)
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == codes.rotation.shape[0])
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec"))  # a repeated query id asks once, with its smallest vector
    asked = C.written(asked, "queries")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))  # a block is what one broadcast holds
    out = None
    for i in range(parts):
        got = C.written(_block(rows, asked.where(F.col("block") == i).toArrow(), codes, k), "nearest")
        out = got if out is None else out.unionByName(got)
    return out


def _block(rows: DataFrame, asked: pa.Table, codes: Codes, k: int) -> DataFrame:
    """Best k rows of one block of queries."""
    if not len(asked):
        return _none(rows.sparkSession)
    qid, qvec = asked.column("id").to_numpy(), _matrix(asked.column("vec").combine_chunks())
    best = C.written(_merged(_searched(rows, qid, qvec, codes, k), k), "in-radius")
    full = best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id").toArrow().column(0).to_numpy()
    few = ~np.isin(qid, full)
    if not few.any():
        return best
    # the exact way for queries with fewer than k candidates in the radius: all rows
    rest = _merged(_searched(rows, qid[few], qvec[few], codes, k, True), k)
    return best.where(F.col("query_id").isin(full.tolist())).unionByName(rest)


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
