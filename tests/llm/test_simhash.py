"""SimHash near-dedup against brute force, with every bucket path."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from caseflow.llm import simhash_blocks as S
from tests.llm import cases


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, bits=3):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= bits
    lab = np.arange(len(f))
    while True:
        new = np.where(near, lab[None, :], len(f)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_fingerprints(rng):
    vocab = ["Aa", "bé", "c c", " ", "d", "E!"]
    texts = [" ".join(vocab[int(i)] for i in rng.integers(0, 6, int(rng.integers(0, 50)))) for _ in range(200)]
    texts += [None, "", "one", "one TWO", " one\x0btwo\r\nthree\tfour ", "x\x1fy z w"]
    assert S.fingerprints(pa.array(texts, pa.string())).tolist() == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("most", [512, 3, 1])
def test_links_match_all_pairs(spark, rng, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_BUCKET", most)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64).astype(np.uint64)
    fps = [int(b) for b in base]
    for b in base[:12]:  # balls around some, with chains of links
        x = b
        for _ in range(12):
            for bit in rng.integers(0, 64, int(rng.integers(1, 5))):
                x = x ^ (np.uint64(1) << np.uint64(bit))
            fps.append(int(x))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    comp = {r.node: r.root for r in S.components(S.links(df)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = [comp.get(s, s) for s in signed]
    want = brute_roots(fps)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_every_division_keeps_close_pairs(rng):
    for blocks, _ in S.LEVELS:
        masks = S._masks(blocks, 3)
        for _ in range(200):
            x = np.uint64(rng.integers(0, 1 << 62))
            y = x
            for b in rng.integers(0, 64, 3):
                y = y ^ (np.uint64(1) << np.uint64(b))
            assert ((masks & x) == (masks & y)).any()


def test_defined_cases(spark):
    docs = cases.documents(spark)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(cases.TEXTS)
    fps = [brute_fp(r.row.text) for r in rows]
    assert [int(np.int64(r.fp).view(np.uint64)) for r in rows] == fps
    root = brute_roots(fps)
    for i, r in enumerate(rows):
        ids = [x.row.doc_id for x, k in zip(rows, root) if k == root[i] and x.row.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == ["1", "3", "6", "7", "8", "None"]
    assert S.near_duplicates(cases.empty(spark)).count() == 0 and S.deduplicate(cases.empty(spark)).count() == 0
