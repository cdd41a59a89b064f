"""Packing: exact round trip, ids equal to the reference tokenizer, few sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseflow.llm import pattern_packing as P
from tests.llm import cases


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file(reference, rng):
    enc = P.encoder()
    alphabet = list("ab Z9_.'\n\t\r<|>") + ["é", "ß", "Ω", "中", "\U0001f600", "\u0301", "\u00a0", "\u2028", "\u0085", "\x1c", "\x00", "'s", "'ll", "  ", "<|endoftext|>", "½", "Ⅷ"]
    texts = ["".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 60)))) for _ in range(800)]
    for t in [*texts, "<|endoftext|>", "", "x" * 3000, " " * 500]:
        assert enc.encode_ordinary(t) == reference(t)


def check(rows, docs, reference, size=1024):
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append([*reference(t), 2])
    by = {}
    for r in rows:
        by.setdefault(r.row.doc_id, []).append(r)
    assert {k: sum(map(len, v)) for k, v in left.items()} == {k: sum(r.length for r in v) for k, v in by.items()}
    for i, ids in left.items():
        want = []
        for x in ids:
            first = len(x) % size or size
            cut = [0, *range(first, len(x) + 1, size)]
            want += [(k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        assert sorted(want) == sorted((r.piece, r.start, r.length, r.crc) for r in by[i])
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    return len(seq)


def test_defined_cases_round_trip(spark, reference):
    docs = cases.documents(spark)
    rows = P.pack(docs).collect()
    assert all(r.row.length == 9 for r in rows)  # a clashing column survives
    check(rows, [(i, t) for i, t, *_ in cases.TEXTS], reference)
    assert P.pack(cases.empty(spark)).count() == 0


def test_exact_multiple_of_the_size(spark, reference):
    word = " the"
    docs = [(i, word * n) for i, n in enumerate([1023, 1024, 2047, 2048, 1, 1022])]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert check(rows, docs, reference) == 8  # six full pieces; 1 + 1023; 1 + 2


@pytest.mark.parametrize("kind", ["uniform", "hot", "large", "tiny", "two"])
def test_plan_places_every_length_in_few_bins(rng, kind):
    lengths = {"uniform": rng.integers(1, 1025, 30_000), "hot": np.concatenate([np.full(10_000, 341), rng.integers(1, 1025, 20_000)]),
               "large": rng.integers(500, 1025, 5_000), "tiny": rng.integers(1, 30, 50_000), "two": np.repeat([700, 324], 1000)}[kind]
    hist = np.bincount(lengths, minlength=1025)
    bins = P.plan(hist)
    used = np.zeros(1025, np.int64)
    for held, k in bins:
        assert k > 0 and 0 < sum(held) <= 1024
        for v in held:
            used[v] += k
    assert (used == hist).all()
    n = sum(k for _, k in bins)
    plain = sum(k for _, k in P.best_fit(hist.copy(), 1024))
    assert n <= 1.001 * plain + 1


def test_nnls_fits_a_mixture_of_patterns(rng):
    pats = P.patterns(np.array([100, 200, 724, 824, 924, 512]), 1024)
    true = rng.uniform(0, 1000, len(pats))
    hist = sum(np.bincount(pats[:, j], true, 1025) for j in range(3))
    hist[0] = 0
    x = P.nnls(pats, hist, 3000, cost=0)
    use = sum(np.bincount(pats[:, j], x, 1025) for j in range(3))
    use[0] = 0
    assert (x >= 0).all() and np.abs(use - hist).max() < 0.01 * hist.max()


def test_hot_length_over_many_tasks(spark, reference):
    docs = [(i, "one two three" if i % 3 else "x " * (i % 700)) for i in range(3000)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()
    n = check(rows, docs, reference)
    assert n <= 1.01 * sum(r.length for r in rows) / 1024 + 2


def test_the_added_token_is_one_id_as_by_default(spark, rng):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not plain.encode_special_tokens

    def default(x):
        return plain.encode(x or "", add_special_tokens=False).ids

    assert default("a <|endoftext|> b") == [64, 220, 50256, 275]
    bits = ["<|endoftext|>", "<|endoftext|", "|>", "<", " ", "  ", "\n", "a", " the", "'s", "é", "1"]
    texts = ["".join(bits[int(i)] for i in rng.integers(0, len(bits), int(rng.integers(0, 30)))) for _ in range(800)]
    enc = P.encoder()
    for t in [*texts, "", "<|endoftext|>", "a <|endoftext|> b"]:
        assert P.token_ids(enc, t) == default(t)
    docs = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>" * 1023), (2, "x <|endoftext|>  y" * 700), (3, None), (4, "plain")]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs, default)
    assert [r.length for r in rows if r.row.doc_id == 1] == [1024]
