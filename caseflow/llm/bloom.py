"""Bloom filters as numpy bit arrays, built by Spark and probed in Arrow scans.

A key is one or two 64-bit hashes; the bits of a filter are set by a grouped
``bit_or``, so only the words of the bit array reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

MIN_BITS = 1 << 10
MAX_BITS = 1 << 28
HASHES = 3


def bits_for(keys: int, per_key: int) -> int:
    """Power of two that gives ``per_key`` bits to each key, within ``MIN_BITS`` and ``MAX_BITS``."""
    bits = MIN_BITS
    while bits < per_key * keys and bits < MAX_BITS:
        bits *= 2
    return bits


def positions(a: np.ndarray, b: np.ndarray, bits: int, salt: int, hashes: int = HASHES) -> list[np.ndarray]:
    """Bit numbers of keys with the hashes a and b."""
    step = C.mix64(b + np.uint64(salt)) | np.uint64(1)
    return [((C.mix64(a ^ np.uint64(salt * 0x9E3779B1)) + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(hashes)]


def build(keys: DataFrame, bits: int, salt: int = 0, hashes: int = HASHES) -> np.ndarray:
    """Bit array (64-bit words) over the first and last column (hashes) of ``keys``."""

    def words(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, batch.num_columns - 1))
            at = np.concatenate(positions(a, b, bits, salt, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), C.signed(np.uint64(1) << (at & 63).astype(np.uint64))], names=["w", "v"])

    got = keys.mapInArrow(words, "w long, v long").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def probe(words: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int = 0, hashes: int = HASHES) -> np.ndarray:
    """Whether each key passes."""
    ok = np.ones(len(a), bool)
    for at in positions(a, b, len(words) * 64, salt, hashes):
        ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok
