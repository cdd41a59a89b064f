"""Language ID: a byte convolutional network over fixed-length windows.

A window of ``WINDOW`` folded bytes is embedded, convolved with filters of
several widths, max-pooled over positions and classified by a softmax.  The
network is trained in numpy on windows drawn from a bounded sample of labelled
texts, and is applied to every window of every whole text; a text's language is
the one with the largest mean probability over its windows.

Defined cases: a null or empty text, or one without any letter, is ``und`` with
score 0; rows are judged one by one, so repeated rows get equal answers; with no
labelled row every text is ``und``.  Extra columns are kept in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

WINDOW = 64
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
PAD = 256
#: Bounds of the training sample: labelled texts, and windows taken from each.
SAMPLE_TEXTS = 6000
SAMPLE_WINDOWS = 4

_FOLD = np.arange(256, dtype=np.int16)
_FOLD[65:91] += 32
_FOLD[0x80:0x9F] += 0x20  # second bytes of two-byte capitals (e.g. the accented Latin letters)


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a chunk as (n, WINDOW) byte codes (short ones padded), and the n + 1 window offsets of its texts."""
    buf, offs = C.text_buffer(texts)
    n = -(-(offs[1:] - offs[:-1]) // WINDOW)
    woffs = np.zeros(len(offs), np.int64)
    np.cumsum(n, out=woffs[1:])
    doc = np.repeat(np.arange(len(n)), n)
    at = offs[:-1][doc] + (np.arange(woffs[-1]) - woffs[:-1][doc]) * WINDOW
    idx = at[:, None] + np.arange(WINDOW)
    inside = idx < offs[1:][doc][:, None]
    codes = np.full(idx.shape, PAD, np.int16)
    codes[inside] = _FOLD[buf[idx[inside]]]
    return codes, woffs


class ByteCnn:
    """Parameters and passes of the network (float32 arrays only, so it pickles small)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.langs = langs
        self.p = {"E": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                  "b": np.zeros(FILTERS * len(WIDTHS), np.float32),
                  "V": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32),
                  "c": np.zeros(len(langs), np.float32)}
        # one weight matrix for all widths: a filter of width w has zeros beyond its w bytes
        self.mask = np.zeros((wide * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
        self.p["W"] = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.p["E"][PAD] = 0

    def _unfold(self, codes: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        x = self.p["E"][np.pad(codes, ((0, 0), (0, wide - 1)), constant_values=PAD)]
        n = len(codes)
        x = x.reshape(n, -1)
        return np.lib.stride_tricks.as_strided(
            x, (n, WINDOW, wide * EMBED), (x.strides[0], EMBED * 4, 4)).reshape(n * WINDOW, wide * EMBED)

    def forward(self, codes: np.ndarray) -> tuple:
        cols = self._unfold(codes)
        z = (cols @ self.p["W"]).reshape(len(codes), WINDOW, -1)
        top = z.max(1) + self.p["b"]
        pooled = np.maximum(top, 0)
        logits = pooled @ self.p["V"] + self.p["c"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), pooled, z, cols

    def predict(self, codes: np.ndarray, step: int = 512) -> np.ndarray:
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        for i in range(0, len(codes), step):
            out[i:i + step] = self.forward(codes[i:i + step])[0]
        return out

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.004,
            seed: int = 3) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), batch):
                rows = order[i:i + batch]
                x = codes[rows]
                prob, pooled, z, cols = self.forward(x)
                n, f = pooled.shape
                d = prob
                d[np.arange(n), y[rows]] -= 1
                d /= n
                g = {"V": pooled.T @ d, "c": d.sum(0)}
                dp = (d @ self.p["V"].T) * (pooled > 0)
                g["b"] = dp.sum(0)
                at = z.argmax(1)  # (n, f): only the winning position gets a gradient
                flat = (np.arange(n)[:, None] * WINDOW + at).ravel()
                picked = cols[flat].reshape(n, f, -1)
                g["W"] = np.einsum("nfk,nf->kf", picked, dp) * self.mask
                dcol = (dp[:, :, None] * self.p["W"].T[None]).reshape(n * f, wide, EMBED)
                byte = np.pad(x, ((0, 0), (0, wide - 1)), constant_values=PAD)[
                    np.repeat(np.arange(n), f)[:, None], at.ravel()[:, None] + np.arange(wide)]
                g["E"] = np.zeros_like(self.p["E"])
                np.add.at(g["E"], byte.ravel(), dcol.reshape(-1, EMBED))
                g["E"][PAD] = 0
                t += 1
                for k, v in g.items():  # Adam
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has any letter (of any script)."""
    buf, offs = C.text_buffer(texts)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(ascii_letter[buf], out=total[1:])
    found = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~found & (offs[1:] > offs[:-1])):
        found[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return found


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_texts: int = SAMPLE_TEXTS, sample_windows: int = SAMPLE_WINDOWS) -> ByteCnn | None:
    """Fit on at most ``sample_texts`` labelled texts (those with the smallest id
    hash, so the sample does not depend on the partitioning) and at most
    ``sample_windows`` evenly spread windows of each.  Null languages, and texts
    without a letter, are left out.  None if nothing is labelled."""
    spread = sample_windows

    def draw(texts):
        codes, woffs = windows(texts)
        ok = has_letter(texts)
        pick, count = [], np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(ok):
            lo, hi = woffs[i], woffs[i + 1]
            take = np.unique(np.linspace(lo, hi - 1, min(spread, hi - lo)).astype(np.int64))
            pick.append(take)
            count[i] = len(take)
        idx = np.concatenate(pick) if pick else np.zeros(0, np.int64)
        raw = codes[idx].astype("<i2").tobytes()
        size = WINDOW * 2
        return [C.lists(pa.array([raw[k * size:(k + 1) * size] for k in range(len(idx))], pa.binary()), count)]

    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                           F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # ids first (narrow rows in the top-n), then the texts of those ids only
    ids = rows.select("id", F.xxhash64("id").alias("h")).where(F.col("id").isNotNull()).orderBy("h", "id").limit(sample_texts)
    rows = rows.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    got = C.annotate(C.packed(rows, "text", ["lang", "id"]), "w array<binary>", draw).select(
        "row.lang", "row.id", "w").orderBy(F.xxhash64("id"), "lang", "w").limit(sample_texts).toArrow()
    codes, y = [], []
    langs = sorted({x for x in got.column("lang").to_pylist()})
    for lang, ws in zip(got.column("lang").to_pylist(), got.column("w").to_pylist()):
        for w in ws:
            codes.append(np.frombuffer(w, "<i2"))
            y.append(langs.index(lang))
    if not codes:
        return None
    x, y = np.stack(codes).astype(np.int16), np.array(y)
    # short texts are one padded window: show the net some cut windows too
    rng = np.random.default_rng(11)
    cut = x[::3].copy()
    cut[np.arange(WINDOW)[None, :] >= rng.integers(6, WINDOW, len(cut))[:, None]] = PAD
    return ByteCnn(langs).fit(np.concatenate([x, cut]), np.concatenate([y, y[::3]]))


def identify(df: DataFrame, model: ByteCnn | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns), ``lang_pred`` and ``score`` for every row of ``df``."""
    bc = df.sparkSession.sparkContext.broadcast(model)

    def judge(texts):
        net = bc.value
        known = has_letter(texts) & (net is not None)
        label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if net is not None:
            codes, woffs = windows(texts)
            total = np.zeros((len(codes) + 1, len(net.langs)))
            np.cumsum(net.predict(codes), axis=0, out=total[1:])
            n = np.maximum(woffs[1:] - woffs[:-1], 1)
            mean = (total[woffs[1:]] - total[woffs[:-1]]) / n[:, None]
            best = mean.argmax(1)
            label[known] = np.array(net.langs, object)[best[known]]
            score[known] = np.clip(mean[np.arange(len(best)), best], 0, 1)[known]
        return [pa.array(label, pa.string()), pa.array(score)]

    return C.annotate(C.packed(df, text_col, keep), "lang_pred string, score double", judge)
