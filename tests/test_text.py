"""Corpus windows against brute force on small inputs (tiny blocks force block edges)."""

from caseflow.operators import text as TX


def _corpus(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def _brute(texts, seq):
    s = "".join((t or "").lower() + "\n" for t in texts)
    return [(i, s[i:i + seq], s[i + seq]) for i in range(len(s) - seq)], s


def test_windows_match_brute_force(spark):
    texts = ["Hello World", "", None, "A longer title, with Ümlaut", "x" * 40, "end"]
    df = _corpus(spark, texts)
    for seq, block in ((5, 7), (3, 1), (10, 64)):
        got = sorted(tuple(r) for r in TX.t_windows(df, seq=seq, block=block, rows_per_range=3).collect())
        exp, s = _brute(texts, seq)
        assert got == exp
        assert len(got) == len(s) - seq


def test_vocab_encode_decode_roundtrip(spark):
    texts = ["abc cab", "zz top", "a"]
    df = _corpus(spark, texts)
    vocab = TX.t_char_vocab(df)
    chars = [r["ch"] for r in vocab.orderBy("idx").collect()]
    assert chars == sorted(set("".join(t + "\n" for t in texts)))
    w = TX.t_windows(df, seq=4, block=5)
    back = TX.t_decode(TX.t_encode(w, vocab), vocab)
    assert sorted(tuple(r) for r in back.collect()) == sorted((r["pos"], r["window"]) for r in w.collect())
    stats = TX.t_corpus_stats(df, seq=4).first()
    assert stats["n_chars"] == sum(len(t) + 1 for t in texts) and stats["n_patterns"] == stats["n_chars"] - 4


def test_argmax_and_generate(spark):
    df = _corpus(spark, ["abababab", "abac"])
    am = {r["ctx"]: r["next_char"] for r in TX.t_argmax(TX.t_next_char_counts(df, 2, block=4)).collect()}
    assert am["ab"] == "a"
    seeds = spark.createDataFrame([(0, "ab")], "pos long, window string")
    gen = TX.t_generate(seeds, TX.t_argmax(TX.t_next_char_counts(df, 2)), 2, 6, checkpoint_every=3).first()
    assert gen["generated"] == "ababab"


def test_long_lines_null_order_and_wide_characters(spark):
    texts = ["é\U0001f600x" * 900, None, "中文" * 700, "", "tail"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "last")]
    df = spark.createDataFrame(rows, "id int, text string")
    exp, s = _brute([*texts, "last"], 9)
    got = sorted(tuple(r) for r in TX.t_windows(df, seq=9, block=64, rows_per_range=2).collect())
    assert got == exp
    vocab = TX.t_char_vocab(df)
    chars = sorted(set(s))
    assert [r["ch"] for r in vocab.orderBy("idx").collect()] == chars
    enc = TX.t_encode_corpus(df, vocab, seq=9, block=64, normalise=False).orderBy("pos").collect()
    assert [(r.x, r.y) for r in enc] == [([chars.index(c) for c in w], chars.index(n)) for _, w, n in exp]
    back = TX.t_decode(TX.t_encode_corpus(df, vocab, seq=9, block=64), vocab)
    assert sorted(tuple(r) for r in back.collect()) == [(p, w) for p, w, _ in exp]
    unknown = spark.createDataFrame([(0, "aQ", "Q")], "pos long, window string, next_char string")
    r = TX.t_encode(unknown, vocab, normalise=False).first()
    assert r.x == [chars.index("a"), None] and r.y is None


def test_windows_of_few_bytes_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(TX, "CHARS_PER_TASK", 500)
    lines = spark.createDataFrame([(i, f"Zeile {i} \U0001f600 énd") for i in range(150)], "id long, text string")
    want = "".join(f"zeile {i} \U0001f600 énd\n" for i in range(150))
    blocks, _ = TX._window_blocks(lines, "text", "id", 2, 64, 1 << 20)
    assert blocks.rdd.getNumPartitions() == -(-len(want) // 500)
    got = {r.pos: r.window + r.next_char for r in TX.t_windows(lines, seq=2, block=64).collect()}
    assert got == {i: want[i:i + 3] for i in range(len(want) - 2)}
    vocab = sorted(set(want))
    codes = TX.t_encode_corpus(lines, TX.t_char_vocab(lines), seq=2, block=64, normalise=False).select("pos", "y").collect()
    assert {r.pos: vocab[r.y] for r in codes} == {i: want[i + 2] for i in range(len(want) - 2)}


def test_offsets_sort_no_texts(spark):
    lines = TX.corpus_lines(spark.createDataFrame([(i, "x" * i) for i in range(50)], "id long, text string"))
    out = TX.corpus_offsets(lines, rows_per_range=7)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [r.off for r in out.orderBy("ord").collect()] == [i * (i + 1) // 2 for i in range(50)]
    at = next(i for i, x in enumerate(plan) if "Window [" in x)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = [x for x in plan[at + 1:] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert below and not any("line#" in x.split("Relation")[0] for x in below)
