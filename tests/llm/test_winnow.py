"""Decontamination against brute force over words."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import bloom, winnow
from tests.llm import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, ids, any_hit = set(), set(), False
        for item, it in items:
            v = words(it)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == v[a:a + n]:
                        hit |= set(range(b, b + n))
                        any_hit = True
                        if item is not None:
                            ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids), any_hit))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows.collect()), key=str)


def test_random_texts_match_brute_force(spark, rng):
    vocab = ["a", "b", "C", "dé", "5"]
    def text(n):
        return " ".join(vocab[int(i)] for i in rng.integers(0, len(vocab), n))
    items = [(i, text(int(rng.integers(0, 16)))) for i in range(25)] + [(None, text(12)), (3, text(11))]
    docs = []
    for i in range(120):
        t = text(int(rng.integers(0, 40)))
        if i % 3 == 0:  # plant a part of an item, in other case and punctuation
            v = (items[int(rng.integers(25))][1] or "").split()
            a = int(rng.integers(0, max(1, len(v))))
            t += " . " + ", ".join(v[a:]).upper().replace("É", "é") + "; " + text(3)
        docs.append((i, t))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = winnow.decontaminate(d, b)
    assert got(out) == brute(docs, items)


def test_defined_cases(spark):
    docs = cases.documents(spark)
    bench = spark.createDataFrame([(7, "quick brown fox JUMPS over the lazy dog near the old river"), (70, "ganzen Tag"),
                                   (70, "ganzen  tag"), (8, None), (9, ""), (None, "grande et belle la maison est grande et belle la maison")],
                                  "item_id long, text string")
    out = winnow.decontaminate(docs, bench)
    want = brute([(i, t) for i, t, *_ in cases.TEXTS if i != 7], [(r.item_id, r.text) for r in bench.collect()])
    assert got(out.where(F.coalesce("row.doc_id", F.lit(0)) != 7)) == want
    long = out.where("row.doc_id = 7").first()
    assert long.n_hit > 100_000 and long["items"] == [] and long.contaminated and long.row.n_hit == 3
    none = winnow.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(cases.TEXTS) and not any(r.contaminated for r in none)
    assert winnow.decontaminate(cases.empty(spark), bench).count() == 0
    kept = winnow.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["3", "4", "5", "6", "8"]


def test_one_passage_in_many_documents(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" " + passage)).alias("text"))
    out = winnow.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.where("n_hit = 30 and n_words = 31 and contaminated").count() == 3000


def test_a_saturated_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(bloom, "bits_for", lambda n, per: 64)
    docs = [(1, "a b c d e f g h i j k l"), (2, "z y x w v u t s r q p")]
    items = [(i, " ".join(f"{c}{i}" for c in "abcdefghijkl")) for i in range(50)] + [(99, "b c d e f g h i j k")]
    out = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(out) == brute(docs, items)


def test_items_digest_of_the_query(spark):
    from caseflow.llm import queries as Q
    out = Q.op3_decontamination(spark, "/root/testdata/sf0.001").where("not contaminated").first()
    assert out.items_sha256 == hashlib.sha256(b"").hexdigest() and out.n_items == 0


@pytest.mark.parametrize("bits", [0, 1, 6])
def test_equal_hashes_of_different_words_hit_nothing(spark, rng, monkeypatch, bits):
    """Word hashes cut down to a few values: the words decide, for whole windows and short items."""
    real = winnow._gram_at
    monkeypatch.setattr(winnow, "_gram_at", lambda h, at, n: real(h, at, n) & winnow.np.uint64((1 << bits) - 1))
    vocab = ["a", "b", "c", "d"]
    items = [(i, " ".join(vocab[int(k)] for k in rng.integers(0, 4, int(rng.integers(1, 20))))) for i in range(12)]
    texts = [" ".join(vocab[int(k)] for k in rng.integers(0, 4, int(rng.integers(0, 40)))) for _ in range(30)]
    docs = [(i, t + " " + items[i % 12][1]) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    shorts = list(range(1, 10))
    # the prints are made here, since a worker does not see the change
    def table(rows, whole):
        arr = winnow.pa.array([t for _, t in rows])
        got = winnow._prints(arr, shorts, None, whole)[1].to_pylist()
        return [(i, p["fp"], p["span"], p["at"], p["pre"], p["ctx"]) for (i, _), ps in zip(rows, got) for p in ps]
    schema = "id long, fp long, span int, at long, pre int, ctx array<string>"
    mine = spark.createDataFrame(table(docs, False), schema)
    other = spark.createDataFrame(table(items, True), schema).selectExpr("fp", "span", "pre", "ctx", "cast(id as string) as item").distinct()
    found = winnow.extended(mine.select(*winnow.PRINT).distinct(), other)
    back = mine.join(found, winnow.PRINT).collect()
    hit, ids = {}, {}
    for r in back:
        core = 5 if r.span == 10 else r.span
        hit.setdefault(r.id, set()).update(range(r["at"] - r.before, r["at"] + core + r.behind))
        ids.setdefault(r.id, set()).add(r.item)
    want = brute(docs, items)
    assert sorted(((i, len(words(t)), len(hit.get(i, ())), sorted(ids.get(i, ())), i in hit) for i, t in docs), key=str) == want


def test_a_text_keeps_few_fingerprints(rng):
    h = rng.integers(0, 1 << 62, 10_000).astype(winnow.np.uint64)
    at, _ = winnow._selected(h, winnow.np.zeros(10_000, int))
    assert 0.2 * 10_000 < len(at) < 0.4 * 10_000 and winnow.np.diff(at).max() <= 6
