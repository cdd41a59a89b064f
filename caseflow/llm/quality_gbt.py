"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (byte classes, word lengths, repetition of words,
word pairs and lines) are computed in numpy over Arrow chunks.  The trees are
grown level by level from per-bin sums of gradients on a bounded sample of
labelled rows, and flattened into three arrays (feature, threshold, leaf value)
that all rows traverse together, one gather per level.

Defined cases: a null text counts as empty and gets the score of an empty text;
rows are judged one by one; without labels every score is 0.5, with one class
only it is that class's smoothed rate.  Extra columns are kept in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm import common as C

#: Bound of the training sample (rows).
SAMPLE_ROWS = 20_000

#: Byte classes counted per text; the rest of ASCII is the class after the last.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",", "!", "?",
           "|", "*#%$&@", "\"'", "()[]{}<>", "=/\\_+-:;"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0x80:0xC0] = len(CLASSES) + 1
_CLASS[0xC0:] = len(CLASSES) + 2
_N_CLASS = len(CLASSES) + 3


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each document and the count of its most frequent one."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.append(at, len(key)))
    of = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, run)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    buf, offs = C.text_buffer(texts)
    n = len(offs) - 1
    size = offs[1:] - offs[:-1]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * _N_CLASS + _CLASS[buf], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    share = counts / np.maximum(size, 1)[:, None]
    starts, ends, woffs = C.word_spans(buf, offs, C.NONSPACE)
    words = woffs[1:] - woffs[:-1]
    per = np.maximum(words, 1)
    wdoc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    mean = _sums(length, woffs) / per
    std = np.sqrt(np.maximum(_sums(length * length, woffs) / per - mean * mean, 0))
    h = C.word_hashes(buf, starts, ends)
    pair = np.zeros(len(h), bool)
    pair[1:] = wdoc[1:] == wdoc[:-1]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & pair[1:]
    two = C.mix64(h[:-1] * np.uint64(3) + h[1:])[pair[1:]]
    distinct, most = _distinct(h, wdoc, n)
    distinct2, most2 = _distinct(two, wdoc[1:][pair[1:]], n)
    lstarts, lends, loffs = C.word_spans(buf, offs, C.INLINE)
    lines = loffs[1:] - loffs[:-1]
    lper = np.maximum(lines, 1)
    llen = (lends - lstarts).astype(float)
    lh = C.word_hashes(buf, lstarts, lends)
    ldoc = np.repeat(np.arange(n), lines)
    ldistinct, _ = _distinct(lh, ldoc, n)
    longest = np.zeros(n)
    np.maximum.at(longest, ldoc, llen)
    capital = _sums(((buf[starts] >= 65) & (buf[starts] <= 90)).astype(float), woffs) / per
    return np.column_stack([
        share, np.log1p(size), np.log1p(words), mean, std, _sums(same, woffs) / per, distinct / per, most / per,
        distinct2 / per, most2 / per, np.log1p(lines), words / lper, ldistinct / lper, longest / np.maximum(size, 1),
        capital, counts[:, 7] / per, counts[:, 9] / per, counts[:, 10] / per, counts[:, 5] / per, counts[:, 2] / per])


class Trees:
    """Boosted trees of one depth as flat arrays: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.leaf, self.depth = base, feature, threshold, leaf, depth

    def score(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        out = np.empty(len(x))
        trees, nodes = self.feature.shape
        root = np.arange(trees) * nodes
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for i in range(0, len(x), step):
            part = x[i:i + step]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), trees), np.int64)
            for _ in range(self.depth):
                k = root + at
                at = 2 * at + 1 + (part[rows, feature[k]] > threshold[k])
            raw = self.base + self.leaf[np.arange(trees), at - nodes].sum(1)
            out[i:i + step] = 1 / (1 + np.exp(-raw))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, min_rows: float = 5.0) -> Trees:
    """Logistic boosting on binned columns; a split needs ``min_rows`` rows on both sides."""
    n, k = x.shape
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    nodes = 2 ** depth - 1
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, nodes + 1))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # code > b iff x > cuts[b]
    flat = code + np.arange(k) * bins
    raw = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)  # node of each row within its level
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            cell = (at[:, None] * (k * bins) + flat).ravel()
            sg, sh, sn = (np.bincount(cell, np.repeat(v, k), width * k * bins).reshape(width, k, bins).cumsum(2)
                          for v in (g, h, np.ones(n)))
            tg, th, tn = sg[:, :, -1:], sh[:, :, -1:], sn[:, :, -1:]
            gain = sg ** 2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg ** 2 / (th + l2)
            gain[(sn < min_rows) | (tn - sn < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(1)
            j, b = best // bins, best % bins
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for node in np.flatnonzero(ok):
                feature[t, first + node], threshold[t, first + node] = j[node], cuts[j[node]][b[node]]
            at = 2 * at + (ok[at] & (code[np.arange(n), j[at]] > b[at]))
        leaf[t] = rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + l2)
        raw += leaf[t][at]
    return Trees(base, feature, threshold, leaf, depth)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
          id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled rows that are not held out; only their statistics reach the driver."""
    rows = C.training_rows(docs, labels, label_col, sample_rows, text_col, id_col)
    got = C.annotate(C.packed(rows, "text", ["id", "label"]), "x array<double>", _stat_lists)
    got = got.select("row.id", "row.label", "x").toPandas().sort_values("id", kind="stable")
    if got.empty:
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.stack(got["x"].to_list()), got["label"].to_numpy(float))


def _stat_lists(texts: pa.Array) -> list:
    x = statistics(texts)
    return [C.lists(pa.array(x.ravel()), np.full(len(x), x.shape[1]))]


def score(df: DataFrame, model: Trees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and ``score``, the probability of label 1, for every row of ``df``."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    return C.annotate(C.packed(df, text_col, keep), "score double",
                      lambda texts: [pa.array(bc.value.score(statistics(texts)))])
