"""Multi-index hashing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import multi_index as M
from caseflow.llm import queries as Q


def brute(ids, x, q, k=5):
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(np.isin(ids, q)):
        s = (x * x[i]).sum(1) / (n * n[i])
        ok = ids != ids[i]
        order = np.lexsort((ids[ok], -s[ok]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[ok][order], s[ok][order])]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    want = brute(ids, x, ids[ids % 50 == 0])
    have = got(Q.op6_nearest_neighbours(spark, sf))
    assert set(have) == set(want) and all(len(v) == 5 for v in have.values())
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in have[q]}) / 5 for q in want]) >= 0.93


def test_radius_search_is_complete(rng):
    """Probing finds every code within the radius, whatever the radius."""
    x = rng.normal(size=(700, 20))
    codes = M.learn(x)
    for radius in range(codes.bits + 1):
        codes.radius = radius
        block = M.Block(np.arange(700), x, codes)
        q, r = block.candidates(block.code[:8])
        near = np.bitwise_count(block.code[:8, None] ^ block.code[None, :]) <= radius
        assert sorted(zip(q, r)) == sorted(zip(*np.nonzero(near)))


def test_defined_cases(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(size=6)], i % 3) for i in range(60)]
    same = [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0) for i in range(40)]  # ties: smaller ids first
    bad = [(200, None, 0), (250, [0.0] * 6, 0), (300, [1.0, None, 1, 1, 1, 1], 0), (350, [float("nan")] * 6, 0), (400, [float("inf"), 1.0, 1, 1, 1, 1], 0),
           (450, [1.0], 0), (None, [1.0] * 6, 0), (500, [], 0)]
    df = spark.createDataFrame([(i, [None if a is None else float(a) for a in v] if v is not None else None, s) for i, v, s in good + same + bad],
                               "vec_id long, embedding array<float>, score int").repartition(4)
    monkeypatch.setattr(M, "QUERY_BLOCK", 2)
    have = got(M.nearest(df, df.where("vec_id % 50 = 0")))
    ids = np.array([i for i, *_ in good + same])
    x = np.array([v for _, v, _ in good + same], np.float32).astype(float)
    want = brute(ids, x, [0, 50, 100])
    assert set(have) == {0, 50, 100} and have[100] == want[100] and [a for a, _ in have[100]] == [101, 102, 103, 104, 105]
    assert all(len(v) == 5 for v in have.values())


def test_few_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 1.0]), (50, [2.0, 2.0])], schema)
    have = got(M.nearest(df, df.where("vec_id % 50 = 0")))
    assert [a for a, _ in have[0]] == [50, 50, 2, 1] and set(a for a, _ in have[50]) == {0, 1, 2}  # all candidates, if fewer than k
    none = spark.createDataFrame([], schema)
    assert M.nearest(none, none).count() == 0
    one = df.where("vec_id = 0")
    assert M.nearest(one, one).count() == 0
    assert M.nearest(df, none).count() == 0


def test_components_of_any_size(spark, rng):
    """Cosines of vectors whose squares overflow or vanish, equal to those of the same directions."""
    x = rng.normal(size=(60, 8))
    size = np.array([1.0, 1e200, 1e-200, 1e300, 1e-300])[np.arange(60) % 5]
    big = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, size))], "vec_id long, embedding array<double>")
    got = M.nearest(big, big.where("vec_id % 5 < 5 and vec_id < 20"), 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 100
    for r in got:
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12
    found = 0
    for q in range(20):
        near = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in range(60) if i != q)[:5]
        found += len({i for _, i in near} & {r.vec_id for r in got if r.query_id == q})
    assert found >= 85
