"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector: the mean embedding
of the elements and class words on its tag path (parent-child pairs too), the
mean embedding of its hashed words, and a few numbers (length, link share,
punctuation, place).  A bidirectional LSTM in numpy reads the sequence both ways
and labels every block as main text or not, with the whole page as context.

No page is labelled, so the network is trained on weak labels: a bounded sample
of pages, plain and with boilerplate of many kinds inserted and containers
renamed, labelled by where a block stands (``weak_label``).  Only the network
decides at extraction.

Defined cases: a null or empty page, or one without text, gives an empty text;
pages are read one by one; with no page to learn from, every text is empty.
Extra columns are kept in ``row``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C
from caseflow.llm.html_blocks import blocks

#: Bounds of the training sample: pages, characters of a page (longer ones are not sampled),
#: and characters of a block's text that varied pages take into inserted boilerplate.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 40_000
SNIPPET_CHARS = 400
PATH_SIZE, PATH_DIM = 4096, 24
WORD_SIZE, WORD_DIM = 4096, 8
NUMBERS = 9
HIDDEN = 16
#: Words per block that are embedded are all of them; pages per step of the network.
BATCH = 64

#: Names that mark boilerplate and main containers (words of classes and ids, and elements).
BOILER = {"nav", "header", "footer", "aside", "form", "head", "title", "menu", "dialog", "button", "select", "fieldset",
          "ad", "ads", "advert", "advertisement", "adverts", "banner", "sponsor", "sponsored", "promo", "sidebar", "side",
          "navigation", "navbar", "breadcrumb", "breadcrumbs", "cookie", "cookies", "notice", "consent", "gdpr", "alert",
          "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "comment", "comments", "reply",
          "replies", "disqus", "discussion", "respond", "related", "recommended", "share", "social", "widget", "foot",
          "copyright", "legal", "pagination", "pager", "tags", "masthead", "topbar", "toolbar"}
MAIN = {"article", "main", "content", "post", "entry", "story", "body", "text"}

_LEAD = re.compile(r"\w+", re.U)


def _words(path: tuple[str, ...]) -> list[set[str]]:
    return [set(x.split(".")) for x in path]


def weak_label(path: tuple[str, ...], has_main: bool) -> int:
    """1 if the place of a block says main text: inside a main container (if the page
    has any) and inside nothing that is named like boilerplate."""
    names = _words(path)
    inside = False
    for element, words in zip(path, names):
        tag = element.split(".")[0]
        if tag in ("html", "body"):
            continue
        if tag == "article" or tag == "main" or (words - {tag}) & (MAIN - {"body", "text"}):
            if not words & BOILER:
                inside = True
        if words & BOILER:
            if tag == "header" and inside and re.fullmatch(r"h[1-6]", path[-1].split(".")[0]):
                continue
            return 0
    return int(inside or not has_main)


def has_container(paths: list[tuple[str, ...]]) -> bool:
    return any(weak_label(p, True) for p in paths)


_cache: dict[tuple[str, ...], np.ndarray] = {}


def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    got = _cache.get(path)
    if got is None:
        if len(_cache) > 20_000:
            _cache.clear()
        names = []
        for up, x in zip(("",) + path, path):
            tag, *words = x.split(".")
            names += [tag, f"{up.split('.')[0]}>{tag}", *(f".{w}" for w in words)]
        names.append("leaf " + path[-1].split(".")[0] if path else "leaf")
        got = _cache[path] = np.array([zlib.crc32(n.encode()) % PATH_SIZE for n in names])
    return got


def _flat_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.int64)), size


def encode(page: list[tuple[tuple[str, ...], str, int]]) -> tuple:
    """Flat path ids and word ids with their counts per block, and the number columns, of a page's blocks."""
    path, npath = _flat_ids([_path_ids(b[0]) for b in page])
    texts = pa.array([b[1] for b in page], pa.string())
    buf, offs = C.text_buffer(texts)
    starts, ends, woffs = C.word_spans(buf, offs)
    word = (C.word_hashes(buf, starts, ends) >> np.uint64(52)).astype(np.int64)
    nword = woffs[1:] - woffs[:-1]
    n = len(page)
    chars = np.array([len(b[1]) for b in page], float)
    link = np.array([b[2] for b in page], float)
    last = np.array([b[1][-1] in ".!?…:\"»”" for b in page], float)
    digit = np.bincount(np.searchsorted(offs[1:], np.flatnonzero((buf >= 48) & (buf < 58)), "right"), minlength=n)[:n]
    t = np.arange(n)
    numbers = np.column_stack([np.log1p(chars) / 6, np.log1p(nword) / 4, link / np.maximum(chars, 1), last,
                               digit / np.maximum(chars, 1), t / max(n, 1), np.full(n, np.log1p(n) / 5),
                               t == 0, t == n - 1]).astype(np.float32)
    return path, npath, word, nword, numbers


class Labeller:
    """Embeddings, one LSTM per direction and a logistic output."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS

        def init(*shape, s):
            return rng.normal(0, s, shape).astype(np.float32)

        self.p = {"P": init(PATH_SIZE, PATH_DIM, s=0.5), "Q": init(WORD_SIZE, WORD_DIM, s=0.1),
                  "o": init(2 * HIDDEN + d, s=0.1), "c": np.zeros(1, np.float32)}
        for side in "fb":
            self.p["W" + side] = init(d, 4 * HIDDEN, s=0.2)
            self.p["U" + side] = init(HIDDEN, 4 * HIDDEN, s=0.2)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1
            self.p["b" + side] = bias

    def vectors(self, pages: list[tuple]) -> np.ndarray:
        """Block vectors of several pages one after another."""
        out = []
        for path, npath, word, nword, numbers in pages:
            n = len(npath)
            a = np.zeros((n, PATH_DIM), np.float32)
            b = np.zeros((n, WORD_DIM), np.float32)
            np.add.at(a, np.repeat(np.arange(n), npath), self.p["P"][path])
            if len(word):
                ok = np.flatnonzero(nword)
                at = np.cumsum(nword) - nword
                b[ok] = np.add.reduceat(self.p["Q"][word], at[ok], axis=0)
            out.append(np.concatenate([a / np.maximum(npath, 1)[:, None] ** 0.5, b / np.maximum(nword, 1)[:, None], numbers], 1))
        return np.concatenate(out)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple:
        """LSTM over (time, page, feature); padded steps leave the state as it is."""
        t, n, _ = x.shape
        z = x @ self.p["W" + side] + self.p["b" + side]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, saved = np.zeros((t, n, HIDDEN), np.float32), []
        u = self.p["U" + side]
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            a = z[i] + h @ u
            g = 1 / (1 + np.exp(-a[:, :3 * HIDDEN]))  # in, forget, out
            w = np.tanh(a[:, 3 * HIDDEN:])
            m = mask[i][:, None]
            c2 = g[:, HIDDEN:2 * HIDDEN] * c + g[:, :HIDDEN] * w
            tc = np.tanh(c2)
            h2 = g[:, 2 * HIDDEN:] * tc
            if keep:
                saved.append((i, h, c, g, w, tc, m))
            c = np.where(m, c2, c)
            h = np.where(m, h2, h)
            hs[i] = h
        return hs, saved

    def _padded(self, pages: list[tuple]) -> tuple:
        size = np.array([len(p[1]) for p in pages])
        t, n = int(size.max()), len(pages)
        x = np.zeros((t, n, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        row = np.repeat(np.arange(n), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        x[step, row] = self.vectors(pages)
        mask = np.arange(t)[:, None] < size[None, :]
        return x, mask, step, row

    def forward(self, pages: list[tuple], keep: bool = False) -> tuple:
        x, mask, step, row = self._padded(pages)
        hf, sf = self._run(x, mask, "f", keep)
        hb, sb = self._run(x, mask, "b", keep)
        full = np.concatenate([hf, hb, x], 2)
        p = 1 / (1 + np.exp(-np.clip(full[step, row] @ self.p["o"] + self.p["c"][0], -30, 30)))
        return p, (x, mask, step, row, full, sf, sb)

    def _back(self, side: str, x: np.ndarray, saved: list, dh_all: np.ndarray, g: dict) -> np.ndarray:
        t, n, d = x.shape
        dz_all = np.zeros((t, n, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        u = self.p["U" + side]
        gu = np.zeros_like(u)
        for i, h0, c0, s, w, tc, m in reversed(saved):
            dh = dh + dh_all[i]
            gi, gf, go = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            dht, dct = np.where(m, dh, 0), np.where(m, dc, 0)
            dct = dct + dht * go * (1 - tc * tc)
            da = np.concatenate([dct * w * gi * (1 - gi), dct * c0 * gf * (1 - gf), dht * tc * go * (1 - go), dct * gi * (1 - w * w)], 1)
            dz_all[i] = da
            gu += h0.T @ da
            dh = np.where(m, da @ u.T, dh)
            dc = np.where(m, dct * gf, dc)
        g["U" + side] = gu
        g["W" + side] = x.reshape(-1, d).T @ dz_all.reshape(t * n, -1)
        g["b" + side] = dz_all.sum((0, 1))
        return dz_all @ self.p["W" + side].T

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = 8, batch: int = 16, rate: float = 0.01,
            seed: int = 9) -> "Labeller":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        size = np.array([len(p[1]) for p in pages])
        for epoch in range(epochs):
            order = np.argsort(size + rng.uniform(0, 8, len(size)))  # pages of like length share a batch
            groups = [order[i:i + batch] for i in range(0, len(order), batch)]
            for k in rng.permutation(len(groups)):
                part = [pages[i] for i in groups[k]]
                y = np.concatenate([labels[i] for i in groups[k]])
                p, (x, mask, step, row, full, sf, sb) = self.forward(part, True)
                d = ((p - y) / len(y)).astype(np.float32)
                g = {"o": full[step, row].T @ d, "c": np.array([d.sum()], np.float32)}
                dfull = np.zeros_like(full)
                dfull[step, row] = d[:, None] * self.p["o"][None]
                dx = dfull[:, :, 2 * HIDDEN:] + self._back("f", x, sf, dfull[:, :, :HIDDEN], g)
                dx = dx + self._back("b", x, sb, dfull[:, :, HIDDEN:2 * HIDDEN], g)
                dv = dx[step, row]
                g["P"], g["Q"] = np.zeros_like(self.p["P"]), np.zeros_like(self.p["Q"])
                at = 0
                for path, npath, word, nword, _ in part:
                    n = len(npath)
                    e = dv[at:at + n]
                    np.add.at(g["P"], path, np.repeat(e[:, :PATH_DIM] / np.maximum(npath, 1)[:, None] ** 0.5, npath, axis=0))
                    np.add.at(g["Q"], word, np.repeat(e[:, PATH_DIM:PATH_DIM + WORD_DIM] / np.maximum(nword, 1)[:, None], nword, axis=0))
                    at += n
                t += 1
                lr = rate * (0.5 ** (epoch // 3))
                for name, v in g.items():  # Adam
                    m[name] += 0.1 * (v - m[name])
                    s[name] += 0.001 * (v * v - s[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(s[name] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Whether each block of each page (none empty) is main text; like lengths run together."""
        out = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        i = 0
        while i < len(order):
            longest = len(pages[order[min(i + BATCH, len(order)) - 1]][1])
            n = BATCH if longest <= 512 else max(1, BATCH * 512 // longest)  # bounded padded size
            part = order[i:i + n]
            p = self.forward([pages[j] for j in part])[0]
            at = 0
            for j in part:
                out[j] = p[at:at + len(pages[j][1])] >= 0.5
                at += len(pages[j][1])
            i += n
        return out


#: Kinds of boilerplate inserted into training pages: before, after or within the main container.
_BEFORE = ['<header><h1>{0}</h1><p>{1}</p></header>', '<div class="header"><a href="/">{0}</a></div>', '<div id="cookie-notice"><p>{1}</p><button>{0}</button></div>',
           '<div class="notice"><p>{1}</p></div>', '<div class="menu"><ul><li><a href="/a">{0}</a></li><li><a href="/b">{2}</a></li></ul></div>',
           '<form action="/s"><label>{0}</label><input name="q"><p>{2}</p></form>', '<aside><h2>{0}</h2><p>{1}</p></aside>',
           '<div class="ad"><p>{1}</p></div>', '<div class="banner">{1}</div>', '<header class="site-header"><p>{1}</p></header>',
           '<div class="breadcrumbs"><a href="/">{0}</a> {2}</div>', '<div role="navigation"><a href="/">{0}</a></div>', '<div class="alert">{1}</div>',
           '<section class="consent"><p>{1}</p></section>']
_AFTER = ['<section class="comments"><h2>{0}</h2><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>',
          '<div id="comments"><ul><li><p>{1}</p></li><li><p>{2}</p></li></ul></div>', '<div class="comments"><p>{1}</p><p>{2}</p></div>',
          '<aside class="sidebar"><h3>{0}</h3><ul><li><a href="/x">{2}</a></li></ul></aside>', '<div class="sidebar"><p>{1}</p><p>{2}</p></div>',
          '<div class="related"><h2>{0}</h2><p><a href="/r">{2}</a></p></div>', '<form class="newsletter"><p>{1}</p><button>{0}</button></form>',
          '<div class="share"><a href="#">{0}</a></div>', '<footer><p>{1}</p></footer>', '<div class="footer">{1}</div>', '<div class="widget"><p>{1}</p></div>',
          '<div class="promo"><p>{1}</p></div>', '<ol class="commentlist comments"><li>{1}</li></ol>', '<div class="cookie-banner"><p>{1}</p></div>',
          '<div class="sponsored"><p>{1}</p></div>', '<section id="comments"><article class="comment"><p>{1}</p></article></section>']
_MAIN_OPEN = ['<article>', '<main>', '<article class="post">', '<div class="content">', '<div id="content">', '<main><article>',
              '<div class="entry-content">', '<div class="post-body">', '<section class="article">', '<div id="main">', '<div>']
_EXTRA = ['<h2>{0}</h2>', '<ul><li>{1}</li><li>{2}</li></ul>', '<blockquote><p>{1}</p></blockquote>', '<ol><li>{2}</li></ol>', '<pre>{1}</pre>',
          '<table><tr><th>{0}</th><td>{2}</td></tr></table>', '<figure><figcaption>{2}</figcaption></figure>', '<p>{0}</p>', '<div>{1}</div>',
          '<p>{1} <a href="/l">{0}</a> {2}</p>', '<h3>{2}</h3><p>{1}</p>']
_ARTICLE = re.compile(r"<article[^>]*>(.*?)(?:</article>|\Z)", re.S | re.I)


def vary(page: str, texts: list[str], rng: np.random.Generator) -> str:
    """A training page with boilerplate inserted, its main container renamed and content elements added."""

    def pick(kinds):
        a, b, c = (texts[int(i)] for i in rng.integers(0, len(texts), 3))
        return kinds[int(rng.integers(len(kinds)))].format(" ".join(a.split()[:3]), b, " ".join(c.split()[:8]))

    m = _ARTICLE.search(page)
    if not m:
        return page
    inner = m[1]
    for _ in range(int(rng.integers(0, 4))):
        cut = [x.start() for x in re.finditer(r"<p>", inner)]
        at = cut[int(rng.integers(len(cut)))] if cut and rng.random() < 0.8 else len(inner)
        inner = inner[:at] + (pick(_EXTRA) if rng.random() < 0.75 else pick(_BEFORE + _AFTER)) + inner[at:]
    opened = _MAIN_OPEN[int(rng.integers(len(_MAIN_OPEN)))]
    closed = "".join(f"</{x}>" for x in re.findall(r"<(\w+)", opened)[::-1])
    before = "".join(pick(_BEFORE) for _ in range(int(rng.integers(0, 4))))
    after = "".join(pick(_AFTER) for _ in range(int(rng.integers(0, 4))))
    head, tail = page[:m.start()], page[m.end():]
    if rng.random() < 0.3:
        head = re.sub(r"<nav>.*?</nav>|<div class=\"ad\">.*?</div>", "", head, flags=re.S)
    return head + before + opened + inner + closed + after + tail


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = SAMPLE_PAGES,
          sample_chars: int = SAMPLE_CHARS, snippet_chars: int = SNIPPET_CHARS) -> Labeller | None:
    """Fit on at most ``sample_pages`` pages of at most ``sample_chars`` characters, each as it is and
    three times varied with inserted texts of at most ``snippet_chars`` characters."""
    text = F.col(f"`{html_col}`").cast("string")
    rows = pages.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"), text.alias("html"))
    rows = rows.where(F.col("html").isNotNull() & (F.length("html") <= sample_chars))
    # the smallest hashes first (eight bytes a row), then only those pages
    first = [r.h for r in rows.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    got = rows.where(F.col("h") <= (first[-1] if first else 0)).groupBy("h").agg(F.min("html").alias("html"))
    got = [r.html for r in got.orderBy("h").collect()] if first else []
    rng = np.random.default_rng(12)
    plain = [blocks(p) for p in got]
    texts = [b[1][:snippet_chars] for p in plain for b in p if len(b[1]) > 20] or ["text"]
    enc, labels = [], []
    for page, own in zip(got, plain):
        for leaf in [own, *(blocks(vary(page, texts, rng)) for _ in range(3))]:
            if leaf:
                main = has_container([b[0] for b in leaf])
                enc.append(encode(leaf))
                labels.append(np.array([weak_label(b[0], main) for b in leaf], float))
    return Labeller().fit(enc, labels) if enc else None


def extract(pages: DataFrame, model: Labeller | None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns), ``text`` and ``n_chars`` for every row of ``pages``."""
    bc = pages.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        leaf = [blocks(t) for t in texts.to_pylist()]
        some = [i for i, p in enumerate(leaf) if p and bc.value is not None]
        out = [""] * len(leaf)
        for i, main in zip(some, bc.value.label([encode(leaf[i]) for i in some]) if some else []):
            out[i] = "\n".join(b[1] for b, ok in zip(leaf[i], main) if ok)
        return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

    return C.annotate(C.packed(pages, html_col, keep), "text string, n_chars long", run)
