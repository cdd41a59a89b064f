"""Language ID, quality and toxicity: held-out accuracy, defined cases, bounds of the training sample."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import common as C
from caseflow.llm import lang_cnn, quality_gbt, toxicity_ftrl
from caseflow.llm import queries as Q
from tests.conftest import SF01
from tests.llm import cases


def test_held_out_rule(spark):
    import zlib
    got = {r.id: r.h for r in spark.range(200).select("id", C.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(C.held_out(F.col("id"))).first()[0] is False


def test_language_held_out_accuracy(spark):
    out = Q.op10_language_id(spark, SF01).join(C.table(spark, SF01, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    row = out.where("held_out and n_chars >= 40").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 0.98
    assert out.where("score < 0 or score > 1").isEmpty()


@pytest.mark.parametrize("name,label,least", [("op2_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.98)])
def test_scores_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    out = Q.QUERIES[name](spark, sf).join(C.table(spark, sf, "labels"), "doc_id").where("held_out")
    got = out.select(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert got[1] > 500 and got[0] > least


def test_language_defined_cases(spark):
    docs = cases.documents(spark)
    model = lang_cnn.train(docs)
    rows = lang_cnn.identify(docs, model).collect()
    assert len(rows) == len(cases.TEXTS)
    for r in rows:
        assert r.row.score == 0.5 and r.row.row == "r"  # clashing columns survive
        if r.row.doc_id in (3, 4, 5, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr") and 0 < r.score <= 1
    assert lang_cnn.train(cases.empty(spark)) is None
    assert {r.lang_pred for r in lang_cnn.identify(docs, None).collect()} == {"und"}
    assert lang_cnn.identify(cases.empty(spark), model).count() == 0


def test_cnn_windows_cover_whole_texts():
    texts = pa.array(["a" * 64, "b" * 130, "", None, "Été"])
    codes, offs = lang_cnn.windows(texts)
    assert offs.tolist() == [0, 1, 4, 4, 4, 5]
    assert (codes[1:4] == ord("b")).sum() == 130 and (codes[3] == lang_cnn.PAD).sum() == 62
    assert codes[4][:5].tolist() == [0xC3, 0xA9, ord("t"), 0xC3, 0xA9]  # folded


def test_cnn_gradient():
    rng = np.random.default_rng(0)
    net = lang_cnn.ByteCnn(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, lang_cnn.WINDOW)).astype(np.int16), rng.integers(0, 3, 6)
    before = -np.log(net.forward(x)[0][np.arange(6), y]).mean()
    net.fit(x, y, epochs=30, batch=6)
    assert -np.log(net.forward(x)[0][np.arange(6), y]).mean() < before / 5


def test_quality_statistics_do_not_depend_on_neighbours():
    texts = ["One two two three.\nOne two two three.", "", "AAA!! BBB!!", "x", "été | a | b"]
    together = quality_gbt.statistics(pa.array(texts))
    alone = np.vstack([quality_gbt.statistics(pa.array([t])) for t in texts])
    np.testing.assert_allclose(together, alone, atol=1e-9)


def test_trees_flat_traversal_matches_recursion(rng):
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    m = quality_gbt.fit(x, y, trees=20, depth=3, rate=0.3)

    def walk(t, r, k=0):
        if k >= 7:
            return m.leaf[t][k - 7]
        return walk(t, r, 2 * k + 1 + int(r[m.feature[t][k]] > m.threshold[t][k]))

    raw = np.array([m.base + sum(walk(t, r) for t in range(20)) for r in x[:50]])
    np.testing.assert_allclose(m.score(x[:50]), 1 / (1 + np.exp(-raw)), rtol=1e-12)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("op", [quality_gbt, toxicity_ftrl])
def test_scores_defined_cases(spark, labels, op):
    docs = cases.documents(spark)
    label = "quality" if op is quality_gbt else "toxic"
    model = op.train(docs, labels, label)
    rows = op.score(docs, model).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r.score <= 1 and r.row.score == 0.5 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.row.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())  # equal texts, equal scores; null as empty
    blank = op.train(cases.empty(spark), labels.limit(0), label)
    assert {r.score for r in op.score(docs, blank).collect()} == {0.5}
    assert op.score(cases.empty(spark), model).count() == 0


def test_training_rows_leave_out_held_out_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(0, "other")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(4, 1), (5, 1)], "doc_id long, quality int")
    import zlib
    rows = C.training_rows(docs, lab, "quality", 1000).collect()
    want = {i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2} - {4}
    assert {r.id for r in rows} == want and len(rows) == len(want)
    assert C.training_rows(docs, lab, "quality", 10).count() == 10


def test_ftrl_is_sparse_and_finds_the_word():
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(800):
        words = [vocab[j] for j in rng.integers(0, 300, 40)]
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(40))] = "awfulword"
        texts.append(" ".join(words))
        y.append(float(bad))
    rows = [np.unique(toxicity_ftrl.features(pa.array([t]))[0]) for t in texts]
    m = toxicity_ftrl.fit(rows[:600], np.array(y[:600]))
    score = m.score(pa.array(texts[600:]))
    assert ((score >= 0.3) == (np.array(y[600:]) == 1)).mean() > 0.97
    assert len(m.index) < 2000


def test_inflected_forms_share_a_weight():
    texts = [f"word{i} awful{'abcdefghij'[i % 10]} other{i % 7}" if i % 3 == 0 else f"word{i} plain{i % 9} other{i % 7}" for i in range(400)]
    y = np.array([float(i % 3 == 0) for i in range(400)])
    rows = [np.unique(toxicity_ftrl.features(pa.array([t]))[0]) for t in texts]
    m = toxicity_ftrl.fit(rows, y)
    assert m.score(pa.array(["word1 awfulzzz other2"]))[0] > 0.3 > m.score(pa.array(["word1 plainzzz other2"]))[0]
