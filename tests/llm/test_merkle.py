"""Merkle manifest against a plain tree with plain proofs, and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from caseflow.llm import merkle_manifest as M
from caseflow.llm import queries as Q
from tests.llm import cases


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root and, per node, (left, right) siblings level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    paths[i].append(("".join(nodes[run[0]:k]), "".join(nodes[k + 1:run[-1] + 1])))
        under = [[i for k in run for i in under[k]] for run in runs]
        nodes = [sha(*nodes[run[0]:run[-1] + 1]) for run in runs]
    return nodes[0], paths


def plain(docs):
    """docs: (doc_id, source, lang, n_chars, text); rows of the query."""
    groups = {}
    for d in sorted(docs, key=lambda d: (d[1] is not None, (d[1] or "").encode(), d[0] is not None, d[0] or 0, leaf(d))):
        groups.setdefault(d[1], []).append(d)
    inner = [tree([leaf(d) for d in g]) for g in groups.values()]
    root, outer = tree([r for r, _ in inner]) if inner else (None, [])
    out = []
    for g, (sub, paths), up in zip(groups.values(), inner, outer):
        for d, p in zip(g, paths):
            h = d
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                h = (*d[:4], d[4].translate(str.maketrans(Q.UPPER, Q.LOWER)))
            x = leaf(h)
            for left, right in p + up:
                x = sha(left, x, right)
            out.append((d[0], leaf(d), sub, root, sha(*[s for step in p + up for s in step]), x, x == root))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, parts=3):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts).write.parquet(path)
    got = sorted(map(tuple, Q.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({Q.ORACLE['op13_merkle_manifest']})").fetchall(), key=str)
    assert got == plain(docs)
    return got


def text(i):
    return ["Some Text É", "lower only", "", None, "X" * 50][i % 5]


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [1] * 17, [257, 1, 16, 0, 300], [600] + [3] * 40, [1] * 300])
def test_trees_of_many_shapes(spark, tmp_path, sizes):
    docs, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            docs.append((i * 7 % 10_007, None if s == 1 else f"s{s}" if s % 2 else f"é{s}", "en", i, text(i)))
            i += 1
    got = run(spark, tmp_path, docs)
    assert all(r[6] or zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in got)


def test_small_ranges_and_shuffled_pointers(spark, tmp_path, monkeypatch):
    """Many ranges, a hot source, and joins that never broadcast."""
    monkeypatch.setattr(M, "RANGE_ROWS", 100)
    monkeypatch.setattr(M, "LEAST_ROWS", 50)
    monkeypatch.setattr(M.C, "BROADCAST_BYTES", 0)
    docs = [(i, "hot" if i % 3 else f"s{i % 91}", None, None, text(i)) for i in range(1500)]
    run(spark, tmp_path, docs, 7)


def test_defined_cases(spark, tmp_path):
    docs = [(i, s, lang, len(t) if t is not None else None, t) for i, t, lang, s in cases.TEXTS]
    docs += [(None, None, None, None, None)] * 20 + [(2, "s2", "en", 1, "twin")] * 18
    run(spark, tmp_path, docs)
    out = M.manifest(cases.documents(spark), ["doc_id", "text", "row", "n_hit"], keep=["doc_id", "row", "score"])
    rows = out.collect()
    assert len(rows) == len(cases.TEXTS) and all(r.verified and r.row.row == "r" for r in rows)
    assert M.manifest(cases.empty(spark), Q.LEAF).count() == 0


def test_any_change_of_any_row_is_seen(spark):
    docs = cases.documents(spark)
    for f in ("lang", "n_chars"):
        out = M.manifest(docs, Q.LEAF, tampered={f: F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("x"))})
        assert out.where("verified").isEmpty()
    assert M.manifest(docs, Q.LEAF, tampered={"text": F.col("text")}).where("not verified").isEmpty()
