"""Maximal periodic runs of words: descending-LCP Kruskal over suffix classes.

The suffixes of a text are ordered, and neighbours in that order are the edges of
a graph, weighted by their longest common prefix (LCP).  Edges are taken by
decreasing weight and unite classes of suffixes; a class keeps its positions in
order.  When two classes meet at weight l, positions i < j of different classes
that become neighbours have LCP l exactly; at a distance j - i <= l they seed a
run of period j - i that ends at j + l, and the period is the smallest one,
since a smaller one would have put a position between them earlier.  The seeds of
one run share its period and end, and the first of them is its start.

A run of ``MIN_RUN`` words or more with at least two periods starts at an LCP of at
least half its length, so only suffixes whose first ``MIN_RUN`` / 2 words occur
again in the text take part; they are found by hash and then ordered exactly.

Defined cases: null, empty and blank texts have no words, no runs and an empty
collapsed text; rows are judged one by one.  The kept columns travel in ``row``.
Memory is a multiple of the longest text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm import common as C

MIN_RUN = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _repeated(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Positions whose next ``k`` words occur again in their text (and perhaps a few more: equal hashes)."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64)
    for j in range(k):
        h = h * _ODD + C.mix64(ids[j:j + n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(np.arange(n) + k <= end[doc[:n]])
    h = h[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return at[hit]


def _suffix_order(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, cand: np.ndarray, k: int):
    """Neighbours (i, j, LCP) of equal first ``k`` words in the order of the suffixes, and the number of their group."""
    n = len(ids)
    # a common prefix of k or more words of two candidates ends at most k behind a candidate
    ahead = cand + k
    at = np.unique(np.concatenate([cand, ahead[ahead < end[doc[cand]]]]))
    slot = np.full(n + 1, -1, np.int64)
    slot[at] = np.arange(len(at))
    last = end[doc[at]]

    def word(j):
        p = at + j
        return np.where(p < last, ids[np.minimum(p, n - 1)], -1) + 1

    keys = [doc[at]] + [(word(j) << 32) | (word(j + 1) if j + 1 < k else 0) for j in range(0, k, 2)]
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in keys], axis=0)])
    first = np.flatnonzero(new)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.repeat(first, np.diff([*first, len(at)]))
    group = rank

    def shifted(r, idx, by):
        """Rank of the suffix ``by`` words behind those of idx; -1 behind the text's end."""
        p = at[idx] + by
        inside = p < last[idx]
        return np.where(inside, r[slot[np.where(inside, p, 0)]], -1)

    levels, size = [rank], k
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=len(at))[rank] > 1)
        if not len(tied):
            break
        a, b = rank[tied], shifted(rank, tied, size)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        top = np.concatenate([[True], a[1:] != a[:-1]])
        sub = top | np.concatenate([[True], b[1:] != b[:-1]])
        place = np.arange(len(a))
        rank = rank.copy()
        rank[tied[order]] = a + np.maximum.accumulate(np.where(sub, place, 0)) - np.maximum.accumulate(np.where(top, place, 0))
        levels.append(rank)
        size *= 2
    sa = np.argsort(rank)
    pair = np.flatnonzero(group[sa[1:]] == group[sa[:-1]])
    i, j = sa[pair], sa[pair + 1]
    lcp = np.zeros(len(i), np.int64)
    for r, length in reversed([(r, k << t) for t, r in enumerate(levels)]):
        x, y = shifted(r, i, lcp), shifted(r, j, lcp)
        lcp += np.where((x == y) & (x >= 0), length, 0)
    for _ in range(k - 1):  # what is left is shorter than k
        p, q = at[i] + lcp, at[j] + lcp
        inside = (p < last[i]) & (q < last[j])
        lcp += inside & (ids[np.minimum(p, n - 1)] == ids[np.minimum(q, n - 1)])
    return at[i], at[j], lcp, group[i]


def _kruskal(i: np.ndarray, j: np.ndarray, lcp: np.ndarray) -> dict[tuple[int, int], int]:
    """First position of the seeds of every run (period, end)."""
    parent, classes, runs = {}, {}, {}

    def seed(a, b, n):
        if b - a <= n:
            key = (b - a, b + n)
            if runs.get(key, a) >= a:
                runs[key] = a

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    order = np.argsort(-lcp, kind="stable")
    for x, y, n in zip(i[order].tolist(), j[order].tolist(), lcp[order].tolist()):
        x, y = find(x), find(y)
        big, small = classes.pop(x, None) or [x], classes.pop(y, None) or [y]
        if len(big) < len(small):
            big, small = small, big
        at = [bisect_left(big, s) for s in small]
        top = len(small) - 1
        for t, s in enumerate(small):
            k = at[t]
            if k and (t == 0 or at[t - 1] < k):  # the position before is of the other class
                seed(big[k - 1], s, n)
            if k < len(big) and (t == top or at[t + 1] > k):
                seed(s, big[k], n)
        if top:
            big += small
            big.sort()  # two ordered runs: one merge
        else:
            big.insert(at[0], small[0])
        parent[y] = x
        classes[x] = big
    return runs


def find_runs(ids: np.ndarray, offs: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period, for the word ids of
    texts laid end to end (``offs``: where each begins, and the end)."""
    k = max(2, -(-min_run // 2))
    doc, end = np.repeat(np.arange(len(offs) - 1), np.diff(offs)), offs[1:]
    cand = _repeated(ids, doc, end, k)
    if not len(cand):
        return np.zeros((0, 4), np.int64)
    i, j, lcp, group = _suffix_order(ids, doc, end, cand, k)
    # a group whose closest positions are further apart than its longest common prefix seeds nothing
    names, of = np.unique(group, return_inverse=True)
    far = np.zeros(len(names), np.int64)
    np.maximum.at(far, of, lcp)
    pos, grp = np.concatenate([i, j]), np.concatenate([of, of])
    order = np.lexsort((pos, grp))
    pos, grp = pos[order], grp[order]
    gap = np.where((grp[1:] == grp[:-1]) & (pos[1:] > pos[:-1]), pos[1:] - pos[:-1], len(ids))
    near = np.full(len(names), len(ids), np.int64)
    np.minimum.at(near, grp[1:], gap)
    use = (near <= far)[of]
    runs = _kruskal(i[use], j[use], lcp[use])
    if not runs:
        return np.zeros((0, 4), np.int64)
    keys = np.array(list(runs.keys()), np.int64)
    period, stop, start = keys[:, 0], keys[:, 1], np.fromiter(runs.values(), np.int64, len(runs))
    ok = stop - start >= np.maximum(min_run, 2 * period)
    period, stop, start = period[ok], stop[ok], start[ok]
    out = np.column_stack([doc[start], start - offs[doc[start]], stop - start, period])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _scan(texts: pa.Array, min_run: int) -> list[pa.Array]:
    lists = [(t or "").encode().split() for t in texts.to_pylist()]  # bytes are split at \t-\r and the blank
    offs = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    number = defaultdict(count().__next__)
    ids = np.array([number[w] for words in lists for w in words], np.int64)
    runs = find_runs(ids, offs, min_run)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, offs[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(step, offs[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    keep = np.cumsum(step[:-1]) == 0
    rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    held = np.bincount(runs[:, 0], minlength=len(lists))
    kept = [b" ".join(compress(w, keep[a:b].tolist()) if n else w) for w, a, b, n in zip(lists, offs, offs[1:], held)]
    return [pa.array(np.diff(offs)), C.lists(rows, held), pa.array(kept, pa.binary()).cast(pa.string())]


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_run: int = MIN_RUN) -> DataFrame:
    """Every row of ``docs`` as ``row`` with ``n_words``, ``runs`` (array of start, length and
    period, by start, then period; words are counted from 0) and ``collapsed``: the words
    joined by one blank, without those that a run holds behind its first period."""
    fields = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return C.annotate(C.packed(docs, text_col, keep), fields, lambda texts: _scan(texts, min_run))
