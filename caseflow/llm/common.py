"""Shared helpers: row-preserving Arrow scans, shared scratch tables, held-out split.

Rows are carried through a scan as one nested struct column ``row``, so extra
columns with any name (also the operator's own output names) cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import shared_table

#: Text bytes that a scan turns into numpy arrays at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of texts that Spark sends to Python at a time; one longer text is a batch of its own.
BATCH_BYTES = 1 << 23
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts the lineage and
    fixes every value, so readers on other machines and retried tasks agree.

    The result read from it is lazy, so it cannot go at once: it is removed with
    the run's ``spark.checkpoint.dir``, or by ``session.drop_shared_tables`` when
    the results have been written."""
    return shared_table(df, name)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def packed(df: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and ``text`` (string; null stays null)."""
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return df.select(F.struct(*cols).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` instead of Spark's 64 MB, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def annotate(src: DataFrame, fields: str, fn: Callable, per_task: bool = False) -> DataFrame:
    """Scan ``packed`` rows in Arrow batches; ``fn(texts)`` gets the text array of
    a chunk and returns one array per field of the DDL string ``fields``.  With
    ``per_task`` each task calls ``fn()`` once for the function to use (state of
    the task).  The result has ``row`` and the fields.

    Only the texts go to Python, in batches bounded by bytes, and only the fields
    come back; ``row`` stays with Spark.  The scan counts as nondeterministic, so that
    it runs once per row whatever filters follow."""
    bound_batches(src.sparkSession)
    extra = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = fn() if per_task else fn
        for texts in batches:
            for lo, hi in chunk_bounds(texts):
                yield pa.StructArray.from_arrays(judge(texts.slice(lo, hi - lo)), extra.names)

    found = F.arrow_udf(run, extra).asNondeterministic()
    return src.select("row", found("text").alias("found")).select("row", "found.*")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them (null: empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    arr = texts.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    if data is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunk_bounds(texts: pa.Array, limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes each (a longer text is alone in its range)."""
    _, offs = text_buffer(texts)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: letters, digits and every byte of a non-ASCII character
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: anything but blank and \t \n \v \f \r
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False
#: anything but a line end
INLINE = np.ones(256, bool)
INLINE[10] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: one 64-bit value per byte, the same for A-Z and a-z
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)[LOWER]
_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word of a chunk, and the n + 1 word offsets of its texts.

    A word is a longest run of bytes that are in the table ``member``; words
    never cross texts."""
    m = member[buf]
    before = np.empty_like(m)
    before[:1] = False
    before[1:] = m[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before[first] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1:] = False
    after[:-1] = m[1:]
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z folded; equal words have equal hashes anywhere."""
    up, down = _power_tables(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[:-1], out=c[1:])
    return mix64((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a long column."""
    return pa.array(x.astype(np.uint64).view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values per row."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, text_col: str = "text",
                  id_col: str = "doc_id", max_chars: int | None = None) -> DataFrame:
    """Columns id, text, label of at most ``bound`` labelled documents that are not
    held out: those with the smallest id hash, so the sample does not depend on
    partitioning.  Null or contradicting labels are left out, repeated ones count
    once; documents longer than ``max_chars`` are left out of the sample if given."""
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    lab = lab.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    lab = lab.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
    lab = lab.where(F.col("label") == F.col("top")).select("id", "label")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    if max_chars is not None:
        rows = rows.where(F.length("text") <= max_chars)
    # a document id that occurs twice may give two rows here; the bound holds for ids
    picked = lab.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(bound)
    # repeated ids: the smallest text stands for all
    return rows.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


#: A table of at most so many bytes (counted, before hashing) is sent to every executor.
BROADCAST_BYTES = 1 << 24
#: Bytes of a row without its arrays and strings.
ROW_BYTES = 16


def small(df: DataFrame, variable: Column | None = None) -> DataFrame:
    """``df`` (narrow rows, read from a written table) with a broadcast hint if its
    counted size allows; a larger one is left to a shuffle join.  ``variable``: bytes
    of a row's arrays and strings."""
    size = F.lit(ROW_BYTES) if variable is None else F.lit(ROW_BYTES) + variable
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
