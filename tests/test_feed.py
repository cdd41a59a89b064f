"""The split reader of a feed against the one-task reader and against Python's JSON."""

import json
import random

import pytest

from caseflow.sources import docs, feed
from tests.test_docs import _bill

TRAPS = ['plain', 'a } b { c [ ] ]', 'quote " and \\ back', 'ends in \\', '\\"objects\\": [ {', '"objects": [ { } ] }',
         '}}}}', '{"id": 3}', 'ünïcödé 語 }   x', '', 'line\nbreak\t}', '@ @[', '\\\\" }']


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _texts(df):
    by_file = {}
    for r in df.collect():
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.place, json.loads(r.text)))
    return {f: [x for _, x in sorted(v, key=lambda t: t[0])] for f, v in by_file.items()}


def _value(rng, deep):
    kind = rng.randrange(6 if deep else 4)
    if kind == 0:
        return rng.choice(TRAPS)
    if kind < 4:
        return rng.choice([None, True, -1.5, 7, rng.choice(TRAPS)])
    if kind == 4:
        return [_value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return _object(rng, deep - 1)


def _object(rng, deep):
    return {rng.choice(["id", "objects", "meta", *TRAPS]): _value(rng, deep) for _ in range(rng.randrange(5))}


def test_bills_equal_those_of_the_one_task_reader(spark, tmp_path, small_blocks):
    bills = []
    for i in range(60):
        b = _bill(i % 8 + 1, "Democrat", [["2015-01-06", 2, TRAPS[i % len(TRAPS)], "<action/>"]] * (i % 4),
                  [{"bill": 7, "relation": TRAPS[-1 - i % len(TRAPS)]}])
        bills.append({**b, "id": i, "title": TRAPS[i % len(TRAPS)] * (i % 3)})
    (tmp_path / "bill.json").write_text(json.dumps({"meta": {"n": {"x": [{}]}}, "objects": bills, "other": [{"id": 1}]}, indent=1))
    one = docs.json_bills(spark, str(tmp_path))
    many = feed.json_feed(spark, str(tmp_path))
    assert many.schema == one.schema
    key = lambda r: r.id
    assert sorted(many.collect(), key=key) == sorted(one.collect(), key=key)
    blocks = spark.read.option("lineSep", "}").text(str(tmp_path / "bill.json")).select("_metadata.file_block_start").distinct()
    assert blocks.count() > 20


def test_objects_equal_those_of_a_json_parser(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    want = {}
    for f in range(25):
        roots, objects = [], []
        for _ in range(rng.randrange(1, 4)):
            around = [{rng.choice(["meta", "x", "}"]): _value(rng, 3)} if rng.random() < .7 else {} for _ in range(2)]
            body = [_object(rng, 3) for _ in range(rng.randrange(12))]
            roots.append({**around[0], "objects": body, **{k + "2": v for k, v in around[1].items()}})
            objects += body
        text = rng.choice(["", "\n"]).join(json.dumps(r, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < .5) for r in roots)
        (tmp_path / f"f{f}.json").write_text(text + rng.choice(["", "\n", "  \n\n"]), encoding="utf-8")
        if objects:
            want[f"f{f}.json"] = objects
    assert _texts(feed.json_objects(spark, str(tmp_path))) == want


def test_empty_cut_off_and_mixed_feeds(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"objects": []}')
    (tmp_path / "nested.json").write_text('{"objects": [{"objects": [], "a": {"objects": [{}]}}, {"id": 4}], "x": []}')
    (tmp_path / "other.json").write_text('{"things": [{"id": 1}], "meta": {"objects": [{"id": 2}]}}')
    (tmp_path / "mixed.json").write_text('{"objects": [null, {"id": 1}, 3, "x", {"id": 2}, null]}')
    (tmp_path / "cut.json").write_text('{"objects": [{"id": 1}, {"id": 2, "title": "never en')
    assert _texts(feed.json_objects(spark, str(tmp_path))) == {"nested.json": [{"objects": [], "a": {"objects": [{}]}}, {"id": 4}],
                                                              "mixed.json": [{"id": 1}, {"id": 2}], "cut.json": [{"id": 1}]}


def test_texts_are_shuffled_again_only_at_block_borders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"objects": [{"a": 1}, {"a": 2}]}')
    plan = feed.json_objects(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [file#") >= 3 and plan.count("block#") and "Union" in plan
    exchanges = [x for x in feed.json_objects(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(file" in x and "place#" in x]
    assert len(exchanges) == 1  # the border objects alone
