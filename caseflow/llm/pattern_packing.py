"""Best-fit packing by length patterns fitted with non-negative least squares.

Texts are tokenised and ended by one id; only those longer than a sequence are
cut (whole pieces, the first may be shorter).  The histogram of piece lengths
(at most ``size`` entries) reaches the driver, where patterns of two and three
lengths that fill a sequence are enumerated, their repeat counts are fitted to
the histogram by projected gradient steps, rounded, and the residual is packed
best-fit over counts of equal bins.  The plan (length, range of ranks) ->
(sequence, offset) is then looked up by every piece through its rank among the
pieces of its length: per-task counters, summed over tasks by a window of one
row per task and length.

Defined cases: a null or empty text is the end id alone; an empty table gives no
rows; rows are packed one by one (repeated ids are separate documents).  Extra
columns are kept in ``row``.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import common as C

SIZE = 1024
END_ID = 2
#: The added token of byte_bpe_50k.json, which ``tokenizers`` matches inside a text.
ADDED = {"<|endoftext|>": 50256}
_loaded = {}


def encoder(path: str | None = None):
    """Byte-level BPE encoder over a rank file.  The default file holds the vocabulary of
    byte_bpe_50k.json, whose added token goes with it; its ids are those of ``tokenizers``
    with that file (tested), got at a third of the time."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={} if path else ADDED)
    return _loaded[path]


def token_ids(enc, text: str) -> list[int]:
    """Ids of a text; an added token is one id wherever it stands, and the text around it is split there."""
    if any(t in text for t in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def pieces(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = SIZE,
           end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Written table, one row per piece: ``row``, ``piece``, ``start``, ``length``, ``crc``,
    ``part`` (task) and ``nth`` (number among the task's pieces of that length)."""

    def task():
        enc = encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)

        def run(texts):
            count, rows = np.zeros(len(texts), np.int64), []
            for i, t in enumerate(texts.to_pylist()):
                ids = np.array([*token_ids(enc, t or ""), end_id], "<u4")
                first = len(ids) % size or size
                cut = [0, *range(first, len(ids) + 1, size)]
                count[i] = len(cut) - 1
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                    seen[b - a] += 1
            names = ["piece", "start", "length", "crc", "part", "nth"]
            flat = np.array(rows, np.int64).reshape(-1, 6)
            return [C.lists(pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(6)], names), count)]

        return run

    fields = "p array<struct<piece:long,start:long,length:long,crc:long,part:long,nth:long>>"
    out = C.annotate(C.packed(docs, text_col, keep), fields, task, per_task=True)
    return C.written(out.select("row", F.explode("p").alias("p")).select("row", "p.*"), "pieces")


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All pairs and triples of the given lengths that fill a sequence, as rows (a, b, c) with a >= b >= c >= 0."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    have[0] = True
    x = np.flatnonzero(have[1:size]) + 1
    a, b = (v.ravel() for v in np.meshgrid(x, x, indexing="ij"))
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    ok[ok] &= have[c[ok]]
    return np.column_stack([a[ok], b[ok], c[ok]])


#: Gradient cost of a triple's use, in shares of a length's count: pairs come first, so that short pieces stay for the residual.
TRIPLE_COST = 0.3


def nnls(pats: np.ndarray, hist: np.ndarray, steps: int = 300, cost: float = TRIPLE_COST) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns near ``hist``: least
    squares by accelerated projected gradient steps, each length scaled by the root of its
    count and weighted by its size (long pieces are the hard ones to place)."""
    scale = np.arange(len(hist)) / len(hist) / np.sqrt(np.maximum(hist, 1.0))  # the empty third place of a pair weighs 0
    extra = cost * (pats[:, 2] > 0)

    def use(x):
        return scale * sum(np.bincount(pats[:, j], x, len(hist)) for j in range(3))

    def back(r):
        return sum((scale * r)[pats[:, j]] for j in range(3))

    goal = scale * hist
    v = np.ones(len(pats))
    for _ in range(20):  # largest eigenvalue, for the step size
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - (back(use(y) - goal) + extra) / (1.05 * norm), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def rounded(pats: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the patterns by length, and whole counts whose running sums are those of x, rounded."""
    order = np.lexsort((-pats[:, 1], -pats[:, 0]))
    return order, np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0).astype(np.int64)


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths in a bin, number of such bins)."""
    open_bins = [[] for _ in range(size + 1)]  # by free room
    for n in range(size, 0, -1):
        c = int(left[n])
        while c:
            room = next((r for r in range(n, size + 1) if open_bins[r]), None)
            if room is None:
                per = size // n
                full, rest = divmod(c, per)
                if full:
                    open_bins[size - per * n].append(((n,) * per, full))
                if rest:
                    open_bins[size - rest * n].append(((n,) * rest, 1))
                break
            held, k = open_bins[room].pop()
            take = min(c, k)
            if k > take:
                open_bins[room].append((held, k - take))
            open_bins[room - n].append((held + (n,), take))
            c -= take
    return [b for bins in open_bins for b in bins]


def plan(hist: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Bins (lengths, how many) that hold exactly the lengths of ``hist`` (count per length, 0..size)."""
    left = hist.astype(np.int64).copy()
    bins = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    pats = patterns(np.flatnonzero(left), size)
    if len(pats):
        x = nnls(pats, left.astype(float))
        order, count = rounded(pats, x)
        for i, k in zip(order[count > 0], count[count > 0].tolist()):
            held = tuple(int(v) for v in pats[i] if v)
            need = {v: held.count(v) for v in held}
            k = min(k, *(int(left[v]) // m for v, m in need.items()))
            if k:
                bins.append((held, k))
                for v, m in need.items():
                    left[v] -= k * m
    return bins + best_fit(left, size)


def slots(bins: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence and offset of every run of equal places."""
    out = [([], [], []) for _ in range(size + 1)]
    used, seq = np.zeros(size + 1, np.int64), 0
    for held, k in bins:
        at = 0
        for v in held:
            for x, y in zip(out[v], (int(used[v]), seq, at)):
                x.append(y)
            used[v] += k
            at += v
        seq += k
    return [tuple(np.array(x, np.int64) for x in o) for o in out]


def pack(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = SIZE,
         end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: ``row``, ``piece``, ``start``, ``length``, ``crc``, ``sequence_id``, ``offset``."""
    cut = pieces(docs, text_col, keep, size, end_id, path)
    per = C.written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(size + 1, np.int64)
    for n, c in per.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        hist[n] = c
    # one row per task and length; a task's base is what earlier tasks have of that length
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    place = cut.sparkSession.sparkContext.broadcast(slots(plan(hist, size), size))  # bounded by the patterns of ``size``
    src = ranked.select("row", "piece", "start", "length", "crc", "rank")

    def look_up(batches):
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for v in np.unique(n):
                rows = np.flatnonzero(n == v)
                first, s, o = place.value[v]
                i = np.searchsorted(first, r[rows], "right") - 1
                seq[rows], at[rows] = s[i] + r[rows] - first[i], o[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(at)],
                                             names=[*b.schema.names[:5], "sequence_id", "offset"])

    schema = src.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("rank").schema
    return src.mapInArrow(look_up, schema)
