"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text are the hashed words, their beginnings of ``STEMS``
bytes (so that inflected forms of a word share a weight), neighbouring word pairs
and pairs with one word between them (each counted once per text).  Per-coordinate
learning rates and an L1 penalty leave few non-zero weights, which are broadcast
as two short arrays.

Defined cases: a null text counts as empty, and an empty text's score comes from
the bias alone; rows are judged one by one; without labels every score is 0.5.
Extra columns are kept in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm import common as C

#: Feature space (a power of two: the weights never hold more entries).
BITS = 20
#: Lengths of word beginnings; a shorter word has none.
STEMS = (4, 5)
#: Bounds of the training sample: labelled rows, and the length of a sampled text.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 50_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text number of every word, word beginning, pair and skip pair of a chunk."""
    buf, offs = C.text_buffer(texts)
    starts, ends, woffs = C.word_spans(buf, offs)
    h = C.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), woffs[1:] - woffs[:-1])
    idx, of = [h], [doc]
    for size in STEMS:
        ok = ends - starts >= size
        idx.append(C.mix64(C.word_hashes(buf, starts[ok], starts[ok] + size) + np.uint64(64 + size)))
        of.append(doc[ok])
    for gap in (1, 2):
        if len(h) > gap:
            ok = doc[gap:] == doc[:-gap]
            idx.append(C.mix64(h[:-gap][ok] * np.uint64(2 * gap + 1) + C.mix64(h[gap:][ok] + np.uint64(gap))))
            of.append(doc[gap:][ok])
    return (np.concatenate(idx) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


class Weights:
    """Bias and the non-zero weights."""

    def __init__(self, bias: float, index: np.ndarray, value: np.ndarray):
        self.bias, self.index, self.value = bias, index, value
        self._dense = None

    def __getstate__(self):
        return {"bias": self.bias, "index": self.index, "value": self.value, "_dense": None}

    def score(self, texts: pa.Array) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.index] = self.value
        idx, of = features(texts)
        hit = self._dense[idx] != 0
        key = np.unique((of[hit] << BITS) | idx[hit])  # each feature once per text
        raw = np.bincount(key >> BITS, self._dense[key & ((1 << BITS) - 1)], len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-(raw + self.bias)))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0,
        l1: float = 10.0, l2: float = 0.0, seed: int = 5) -> Weights:
    """FTRL-proximal over rows given as arrays of distinct feature indices; the last coordinate is the bias (no L1)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    if len(rows):
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                i = rows[r]
                w = weight(i)
                b = -z[size] / ((beta + np.sqrt(n[size])) / alpha)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y[r]
                root = np.sqrt(n[i])
                n[i] += g * g
                z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
                rb = np.sqrt(n[size])
                n[size] += g * g
                z[size] += g - (np.sqrt(n[size]) - rb) / alpha * b
    every = np.arange(size)
    w = weight(every)
    keep = np.flatnonzero(w)
    return Weights(float(-z[size] / ((beta + np.sqrt(n[size])) / alpha)), keep, w[keep])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text",
          id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Weights:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, with texts of at most
    ``sample_chars`` characters; only their feature indices reach the driver."""
    rows = C.training_rows(docs, labels, label_col, sample_rows, text_col, id_col, sample_chars)

    def distinct(texts):
        idx, of = features(texts)
        key = np.unique((of << BITS) | idx)
        counts = np.bincount(key >> BITS, minlength=len(texts))
        return [C.lists(pa.array((key & ((1 << BITS) - 1)).astype(np.int32)), counts)]

    got = C.annotate(C.packed(rows, "text", ["id", "label"]), "x array<int>", distinct).select("row.id", "row.label", "x")
    got = got.toArrow().sort_by("id")
    x = got.column("x").combine_chunks()
    if not len(got):
        return fit([], np.zeros(0))
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    flat, offs = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(offs[:-1], offs[1:])], got.column("label").to_numpy().astype(float))


def score(df: DataFrame, model: Weights, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and ``score``, the probability of label 1, for every row of ``df``."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    return C.annotate(C.packed(df, text_col, keep), "score double", lambda texts: [pa.array(bc.value.score(texts))])
