"""Periodic runs against a plain search of all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from caseflow.llm import periodic_runs as R
from caseflow.llm import queries as Q
from tests.conftest import SF001
from tests.llm import cases


def brute(w, least=12):
    out, n = [], len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s:
                size = i + p - s
                seg = w[s:s + size]
                if size >= max(least, 2 * p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.append((s, size, p))
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_random_sequences(rng):
    for _ in range(300):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            w = rng.integers(0, rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 3, 12, 40, 90])).tolist()
            while w and rng.random() < 0.6:
                a = int(rng.integers(0, len(w)))
                b = int(rng.integers(a, len(w))) + 1
                w[a:a] = w[a:b] * int(rng.integers(1, 4))
                w = w[:150]
            texts.append(w)
        least = int(rng.choice([12, 12, 4, 7]))
        offs = np.cumsum([0, *map(len, texts)])
        got = R.find_runs(np.array(sum(texts, []), np.int64), offs, least)
        assert [tuple(x) for x in got.tolist()] == [(d, *x) for d, w in enumerate(texts) for x in brute(w, least)]


def test_equal_hashes_change_nothing(rng, monkeypatch):
    monkeypatch.setattr(R.C, "mix64", lambda x: x & np.uint64(1))
    texts = [rng.integers(0, 4, 80).tolist() * 2, [1, 2] * 30, rng.integers(0, 2, 150).tolist()]
    got = R.find_runs(np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)]))
    assert [tuple(x) for x in got.tolist()] == [(d, *x) for d, w in enumerate(texts) for x in brute(w)]


@pytest.mark.parametrize("w, runs", [
    (["x"] * 100_000, [(0, 100_000, 1)]), (["x"] * 11, []), (["x"] * 12, [(0, 12, 1)]), (["a", "b"] * 50_000, [(0, 100_000, 2)]),
    (list("abcdefghijkl") * 2, [(0, 24, 12)]), (list("abcdefghijkl") + list("abcdefghijk"), []),
    (list("zzzabcabcabcabcabd"), [(3, 14, 3)])])
def test_edges(w, runs):
    got = R.find_runs(np.unique(w, return_inverse=True)[1].astype(np.int64), np.array([0, len(w)]))
    assert [tuple(x[1:]) for x in got.tolist()] == runs


def test_many_lines_of_one_kind(rng):
    """A line that stands a thousand times among others: linear room, all its runs."""
    line = list(range(9))
    w = sum((line * int(rng.integers(1, 4)) + [100 + i] for i in range(1000)), [])
    got = R.find_runs(np.array(w), np.array([0, len(w)]))
    same = [i for i in range(len(w)) if i == 0 or w[i - 1] >= 100]
    want = [(s, len(line) * k, 9) for s in same for k in [next(j for j in range(1, 5) if w[s + 9 * j] >= 100)] if k > 1]
    assert [tuple(x[1:]) for x in got.tolist() if x[3] == 9] == want


def rows_hold(got, docs):
    want = []
    for i, t in docs:
        w = planted(i, words(t))
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(),
                     hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    short = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if len(words(r.text)) < 900]
    spark.createDataFrame(short, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = Q.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/a").collect()
    assert sum(r.n_runs > 0 for r in rows) > 5
    rows_hold(rows, short)
    some = [(i, t and t[:6000], *x) for i, t, *x in cases.TEXTS]
    some += [(10 * k, "a b  c\td é\x0bf\x0cg h\ri \U0001f600 " * k, "en", "s") for k in range(40)]
    cases.documents(spark, some).write.parquet(f"{tmp_path}/b/documents.parquet")
    rows_hold(Q.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/b").collect(), [x[:2] for x in some])


def test_defined_cases(spark):
    rows = R.scan(cases.documents(spark)).collect()
    assert len(rows) == len(cases.TEXTS) and all(r.row.length == 9 for r in rows)
    by = {r.row.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].runs == [] and by[3].collapsed == by[5].collapsed == ""
    assert [tuple(x) for x in by[7].runs] == [(0, 120_000, 6)] and by[7].collapsed == "la maison est grande et belle"
    assert by[8].collapsed == " ".join(words(by[8].row.text)) and R.scan(cases.empty(spark)).count() == 0
