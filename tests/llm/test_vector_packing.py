"""Vector packing: ids of the tokeniser file, exact round trip, limits, little padding."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseflow.llm import queries as Q
from caseflow.llm import vector_packing as V
from tests.conftest import SF001
from tests.llm import cases


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file(reference, rng):
    words = V.Words()
    alphabet = [*"abAZ09_.'\n\t\r<|> !-", "\x1c", "\x85", "\xa0", " ", "́", "é", "é", "É", "Σ", "ΑΣ", "İ", "ß", "ﬁ", "中", "\U0001f600",
                "'s", "'LL", "''re", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x0b", "\x0c", "\x00", "½", "Ⅷ", "​", "×", "÷", "ª", "µ", "hello", "World"]
    for _ in range(3000):
        t = "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 40))))
        assert words.ids(t) == reference(t), repr(t)
    for t in [None, "", "x" * 3000, "It's the DOG'S don't I'll we've 12345 a1b2 -- ''' 's's", "Ünïcödé ÀÉÎ naïve façade straße"]:
        assert words.ids(t) == reference(t)


def test_every_entry_is_reached_by_merging_pairs():
    """What merges by bytes (the lookup here) equals what merges by pairs (the file), if
    pair by pair the parts of every entry lead to that entry."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
    added = {t["content"] for t in spec["added_tokens"]}
    for token in set(spec["model"]["vocab"]) - added:
        end = token.endswith("</w>")
        w = list(token[:-4] if end else token)
        if end:
            w[-1] += "</w>"
        while len(w) > 1:
            r, i = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(w, w[1:])))
            assert r < 1 << 30, token
            w[i:i + 2] = ["".join(w[i:i + 2])]
        assert w == [token]


def bounds_hold(seqs, tokens, loss, size, segments, max_loss):
    got = {i: [] for i in range(len(tokens))}
    for held in seqs:
        assert 0 < len(held) <= segments and sum(n for *_, n in held) <= size
        assert sum(max(0, a + n - max(a, tokens[i] - loss[i])) for i, a, n in held) <= max_loss
        for i, a, n in held:
            assert n > 0
            got[i].append((a, n))
    for i, parts in got.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == tokens[i]


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [(64, 64, 64), (64, 3, 64), (64, 10, 20), (16, 1, 5), (100, 4, 30)])
def test_limits_hold_together(rng, limits, cut):
    size, segments, max_loss = limits
    for kind in range(3):
        tokens = [rng.integers(1, 200, 300), rng.integers(1, 6, 300), np.where(rng.random(300) < 0.3, 33, rng.integers(1, 64, 300))][kind]
        loss = (tokens * rng.random(300)).astype(int) if kind != 1 else tokens
        seqs = V.place(tokens, loss, size, segments, max_loss, cut)
        bounds_hold(seqs, tokens, loss, size, segments, max_loss)
        if cut:  # every sequence is full or of a length that needs no padding
            totals = [sum(n for *_, n in held) for held in seqs]
            assert all(t & (t - 1) == 0 or t == size for t in totals)
        else:  # only what cannot fit an empty sequence is cut
            parts = np.bincount([i for held in seqs for i, *_ in held])
            fits = (tokens <= size) & (loss <= max_loss)
            assert (parts[fits] == 1).all()


def test_whole_examples_need_few_sequences(rng):
    tokens = rng.integers(1, 1000, 2000)
    seqs = V.place(tokens, tokens, 4096, 128, cut=False)
    assert len(seqs) <= 1.01 * tokens.sum() / 4096 + 1
    # two kinds that fill a sequence only together: much loss and few tokens, or the reverse
    tokens, loss = np.repeat([30, 70], 500), np.repeat([30, 2], 500)
    assert len(V.place(tokens, loss, 100, 10, 32, cut=False)) == 500


def check(rows, docs, reference, size=4096):
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append([*reference(t), 2])
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(left)
    for i, texts in left.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(by[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at:at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(texts[0])
        assert sum(r.length for r in by[i]) == sum(map(len, texts))
    padding = 0
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_query_is_an_exact_round_trip(spark, reference, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check(Q.QUERIES["op11_vector_packing"](spark, SF001).collect(), docs, reference)
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.QUERIES["op11_vector_packing"](spark, str(tmp_path)).collect()
    check(rows, [(i, t) for i, t, *_ in cases.TEXTS], reference)
    assert V.pack(cases.documents(spark)).where("row.length != 9 or row.row != 'r'").isEmpty()  # clashing columns survive
    assert V.pack(cases.empty(spark)).count() == 0 and V.sequences(cases.empty(spark)).count() == 0


def test_small_blocks_and_repeated_tasks(spark, reference, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    docs = [(i, "word " * (i * 37 % 900)) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = V.pack(df).selectExpr("row.doc_id", "start", "length", "crc as ids_crc32", "tokens as doc_tokens", "sequence_id", "offset")
    first = sorted(map(tuple, rows.collect()))
    assert first == sorted(map(tuple, rows.collect()))
    check(rows.collect(), docs, reference)


def test_sequences_hold_prompts_and_responses(spark, reference):
    docs = [(i, "ask " * (i % 50), "answer " * (1 + i * 7 % 90)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, prompt string, reply string")
    got = V.sequences(df, "reply", "prompt", size=256, segments=8, max_loss=160, cut=False).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    held = []
    for r in got:
        assert len(r.ids) == len(r.loss) == sum(r.lengths) <= 256 and len(r.lengths) <= 8 and sum(r.loss) <= 160
        at = 0
        for n in r.lengths:
            held.append((tuple(r.ids[at:at + n]), sum(r.loss[at:at + n])))
            at += n
    assert sorted(held) == sorted(((*reference(p), *reference(a), 2), len(reference(a)) + 1) for _, p, a in docs)
    pieces = V.pack(df, "reply", "prompt", keep=["doc_id"], size=64, segments=4, max_loss=40).collect()
    for i, p, a in docs:
        assert sum(x.loss for x in pieces if x.row.doc_id == i) == len(reference(a)) + 1
