"""URL cascade against a plain rule search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import queries as Q
from caseflow.llm import url_cascade as U

URLS = ["http://example.net/en/x", "https://a.b.example.net/en/", "https://EXAMPLE.net/EN/", "http://net", "http://net/", "http://x.org/fr/1?q#f",
        "http://notexample.net/en/1", "http://xorg/fr/", "http://example.com/de/a", "http://m.example.com/de", "example.com/de/", None, "", "://", ":///fr/",
        "http://u@example.com:80/de/", "http://a://b.net/", "http://x.org?/fr/", "http://x.org#/fr/", "http://x\ny.org/fr/\nz?", "http://É.net/", "a://.net/",
        "http://net./", "http://" + "a." * 3000 + "org/fr/" + "p" * 5000]


def plain(url, rules, default="allow"):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def result(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "k", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, keys string, rule string, host string").repartition(3)
    rows = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert all((r.row["keys"], r.row.rule, r.row.host) == ("k", "r", "v") for r in rows)
    return {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


@pytest.mark.parametrize("most", [U.MAX_LISTED, 0])
def test_rules_of_the_query(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_LISTED", most)  # 0: the way of a list too large to broadcast
    got = result(spark, URLS, Q.URL_RULES)
    assert got == {i: plain(u, Q.URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("most", [U.MAX_LISTED, 0])
def test_many_rules_and_ties(spark, rng, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_LISTED", most)
    monkeypatch.setattr(U.bloom, "MIN_BITS", 64)  # small filters: many levels
    lab, seg = ["a", "b", "cc", "d"], ["/", "/a", "/ab/", "/b/c", ""]
    def host():
        return ".".join(lab[int(i)] for i in rng.integers(0, 4, int(rng.integers(1, 4))))
    rules = [(host(), seg[int(rng.integers(5))], U.VERDICTS[int(rng.integers(2))]) for _ in range(80)] + [(None, "/", "block"), ("a", None, "allow")]
    urls = [f"http://{host()}{seg[int(rng.integers(5))]}{seg[int(rng.integers(5))]}" for _ in range(500)]
    known = [r for r in rules if None not in r]
    assert result(spark, urls, rules) == {i: plain(u, known) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(U.bloom, "bits_for", lambda n, per: 1 << max(6, int(n).bit_length()))
    keys = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), "id")
    listed = keys.where("id % 7 = 0")
    levels = U.cascade(keys.select("a", "b"), listed.select("a", "b"))
    rows = keys.toPandas()
    got = U.member(levels, rows.a.to_numpy().view(np.uint64), rows.b.to_numpy().view(np.uint64))
    assert len(levels) > 3 and (got == (rows.id % 7 == 0)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.judge(pages, none).collect()] == [(None, "allow")]
    assert U.judge(pages.limit(0), spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")).count() == 0


def test_rules_of_very_many_shapes(spark):
    rules = [("c" * 3 + ".d" * (i % 7), "/" + "p" * i, U.VERDICTS[i % 2]) for i in range(900)]
    urls = [f"http://x.{h}{p}tail" for h, p, _ in rules[::30]] + [f"http://{h}{p}" for h, p, _ in rules[::31]] + ["http://e/", None]
    assert result(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


@pytest.mark.parametrize("bound", [0, U.C.BROADCAST_BYTES])
def test_broadcast_only_below_its_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(U.C, "BROADCAST_BYTES", bound)
    df = spark.range(5).withColumn("a", F.array(F.lit("x")))
    hinted = "broadcast" in U.C.small(df, F.size("a"))._jdf.queryExecution().logical().toString()
    assert hinted == (bound > 0) and "broadcast" in U.C.small(df.limit(0))._jdf.queryExecution().logical().toString()
