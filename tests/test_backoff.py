"""Back-off model against a plain one over dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseflow.operators import backoff as B


class Plain:
    def __init__(self, text, order, least):
        raw = [Counter() for _ in range(order + 1)]
        raw[order] = Counter((text[i:i + order], text[i + order]) for i in range(len(text) - order))
        cnt = [None] * order + [dict(raw[order])]
        for k in range(order - 1, -1, -1):
            cnt[k] = Counter()
            for (ctx, ch), n in raw[k + 1].items():
                raw[k][ctx[1:], ch] += n
                cnt[k][ctx[1:], ch] += 1
        self.order, self.cnt, self.kept, self.d = order, cnt, [], []
        for k in range(order + 1):
            one, two = (sum(v == x for v in cnt[k].values()) for x in (1, 2))
            self.d.append(min(0.9, max(0.1, one / (one + 2 * two) if one + two else 0.0)))
            seen = defaultdict(int)
            for (ctx, _), n in raw[k].items():
                seen[ctx] += n
            self.kept.append({c for c, n in seen.items() if not k or n >= least})
        self.v = len(cnt[0]) + 1
        self.rows = [defaultdict(dict) for _ in cnt]
        for k, c in enumerate(cnt):
            for (ctx, ch), n in c.items():
                self.rows[k][ctx][ch] = n

    def p(self, ctx, ch):
        k = len(ctx)
        if k and ctx not in self.kept[k]:
            return self.p(ctx[1:], ch)
        row = self.rows[k][ctx]
        total, d = sum(row.values()), self.d[k]
        lower = self.p(ctx[1:], ch) if k else 1 / self.v
        return max(row.get(ch, 0) - d, 0) / total + d * len(row) / total * lower


TEXTS = ["The cat sat on the mat", "the bat sat on the cat", "a catalogue of cats", "", None, "Über die Katze", "bats and cats and mats", "the theme"] * 2 + ["zq"]


@pytest.fixture(scope="module", params=[(3, 1), (3, 2), (2, 3), (1, 1)])
def models(request, spark):
    order, least = request.param
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    text = "".join((t or "").lower() + "\n" for t in TEXTS)
    return order, text, Plain(text, order, least), B.t_backoff_model(df, order, min_count=least, block=16)


def test_probabilities_equal_the_plain_model_and_sum_to_one(models):
    order, text, plain, model = models
    assert model.n_chars == plain.v and np.allclose(model.discounts, plain.d)
    seen = 0
    for k in range(order + 1):
        rows = model.probs[k].collect()
        assert {r.ctx for r in rows} == plain.kept[k] == {r.ctx for r in model.weights[k].collect()}
        for r in rows:
            assert abs(r.p - plain.p(r.ctx, r.next_char)) < 1e-12
        seen += len(rows)
        for ctx in plain.kept[k]:
            assert abs(sum(plain.p(ctx, c) for c in {*plain.rows[0][""], "\0"}) - 1) < 1e-12
    assert seen > 20


def test_scores_and_entropy(spark, models):
    order, text, plain, model = models
    pairs = [(text[i:i + order], c, 1 + i % 3) for i in range(0, 40, 3) for c in ("a", "z", "!", text[i + order])] + [("x" * order, "t", 2)]
    got = B.t_backoff_score(spark.createDataFrame(pairs, "ctx string, next_char string, cnt int"), model).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert abs(r.p - plain.p(r.ctx, r.next_char)) < 1e-12
    new = "a cat on a mat?\nthe katze\n"
    df = spark.createDataFrame([(0, "A cat on a mat?"), (1, "the katze")], "id int, text string")
    r = B.t_cross_entropy(df, model).first()
    want = [-math.log(plain.p(new[i:i + order], new[i + order])) for i in range(len(new) - order)]
    assert r.n_chars == len(want) and abs(r.cross_entropy - sum(want) / len(want)) < 1e-9


def test_generation_takes_the_likeliest_character_and_never_stops(spark, models):
    order, text, plain, model = models
    am = B.t_backoff_argmax(model)
    chars = sorted(plain.rows[0][""])

    def best(ctx):
        while ctx and ctx not in plain.kept[len(ctx)]:
            ctx = ctx[1:]
        return min(chars, key=lambda c: (-round(plain.p(ctx, c), 12), c))

    rows = am.collect()
    assert len(rows) == sum(map(len, plain.kept)) and all(r.next_char == best(r.ctx) for r in rows)
    seeds = [(1, "the c"), (2, "never seen: ☃☃☃☃"), (3, ""), (4, "z")]
    want = []
    for pos, w in seeds:
        s = ""
        for _ in range(25):
            s += best((w + s)[-order:])
        want.append((pos, s))
    df = spark.createDataFrame(seeds, "pos int, window string")
    for bucket in (1 << 18, 10):
        assert sorted(map(tuple, B.t_backoff_generate(df, am, order, 25, rows_per_bucket=bucket).collect())) == want


def test_defined_cases(spark):
    df = spark.createDataFrame([(0, "ab")], "id int, text string")
    assert B.t_backoff_model(df, 5) is None and B.t_backoff_model(df.limit(0), 1) is None
    model = B.t_backoff_model(df, 2)  # one window: its contexts are all there is
    assert {(r.ctx, r.next_char) for p in model.probs for r in p.collect()} == {("ab", "\n"), ("b", "\n"), ("", "\n")}
    assert B.t_cross_entropy(df.limit(0), model).first().n_chars is None
