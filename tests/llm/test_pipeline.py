"""The pipeline's stages against brute force, and its queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from caseflow.llm import common as C
from caseflow.llm import queries as Q
from tests.conftest import SF01
from tests.llm import cases
from tests.llm.test_packing import check, reference  # noqa: F401
from tests.llm.test_secrets import base
from tests.llm.test_simhash import brute_fp, brute_roots
from tests.llm.test_winnow import words


def test_stages_one_by_one(spark, reference):  # noqa: F811
    docs = C.table(spark, SF01, "documents")
    names = docs.columns
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(C.written(stage(spark, tables[-1], SF01), "test-stage"))
    _, lang, dedup, clean, redacted, packed = [t.collect() for t in tables]
    assert all(t.columns == names for t in tables[:-1])
    # language: clean documents stay
    assert len(lang) >= 0.99 * docs.count()
    # near copies: one of each group, its smallest id
    root = brute_roots([brute_fp(r.text) for r in lang])
    want = {}
    for r, k in zip(lang, root):
        want[k] = min(want.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in dedup) == sorted(want.values())
    # decontamination: no benchmark window is left, no clean document is gone
    wins = set()
    for r in C.table(spark, SF01, "benchmark").collect():
        w = words(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in wins}
    def hit(t):
        w = words(t)
        return any(tuple(w[i:i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in dedup if not hit(r.text))
    # secrets: masked, all else as it was
    before = {r.doc_id: r.text for r in clean}
    assert {r.doc_id for r in redacted} == set(before)
    for r in redacted:
        assert r.n_chars == len(r.text) and not base(r.text)
        if not base(before[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id]
    # packing
    rows = [type("R", (), {"row": type("D", (), {"doc_id": r.doc_id}), "piece": r.piece, "start": r.start, "length": r.length, "crc": r.ids_crc32,
                           "sequence_id": r.sequence_id, "offset": r.offset}) for r in packed]
    check(rows, [(r.doc_id, r.text) for r in redacted], reference)


def test_defined_cases(spark):
    sf = "/root/testdata/sf0.001"
    for docs in (cases.documents(spark), cases.empty(spark)):
        for _, stage in P.STAGES:
            docs = C.written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = Q.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    have = sorted(map(tuple, got.select(*cols).collect()), key=str)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLE[name]})").fetchall(), key=str)
    assert have == want


def test_oracles_on_the_hard_rows(spark, tmp_path):
    """The same SQL over nulls, empty texts and repeats (the SQL copies a text's words per
    window, so the long text is cut here; tests of the operators take it whole)."""
    rows = [(i, t and t[:3000], lang, s) for i, t, lang, s in cases.TEXTS]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "quick brown fox JUMPS over the lazy dog near the old river"), (70, "ganzen Tag"), (8, None)],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op1_secret_scans", "op3_decontamination"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        cols = sorted(got.columns)
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(
            con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLE[name]})").fetchall(), key=str)
