"""Nested bill documents from a self-made fixture of the same shape."""

import json

from caseflow.sources import docs


def _bill(i, party, actions, related):
    return {
        "id": 1000 + i, "congress": 114, "number": i, "bill_type": "house_bill",
        "display_number": f"H.R. {i}", "introduced_date": "2015-01-0%d" % (i + 1),
        "current_status": "referred", "current_status_date": "2015-02-01", "current_chamber": None,
        "is_alive": True, "is_current": True, "title": f"H.R. {i}: t{i}", "title_without_number": f"t{i}",
        "major_actions": actions,
        "titles": [["short", None, f"short {i}"], ["official", "introduced", f"official {i}"]],
        "related_bills": related, "committee_reports": [], "text_incorporation": None,
        "sponsor": {"bioguideid": f"X{i % 2}", "id": i % 2, "name": f"Member {i % 2}",
                    "birthday": "1960-0%d-01" % (i + 1), "gender": "female"},
        "sponsor_role": {"party": party, "state": "CA", "role_type": "representative", "district": 3,
                         "startdate": "2015-01-0%d" % (i + 1), "enddate": "2017-01-03",
                         "congress_numbers": [114], "extra": {"office": "1 Main St"}},
        "source_link": None,
    }


def test_json_feed(spark, tmp_path):
    feed = {"objects": [
        _bill(1, "Democrat", [["datetime.datetime(2015, 1, 6, 0, 0)", 2, "Referred.", '<action state="REFERRED"/>'],
                              ["datetime.datetime(2015, 2, 9, 14, 30)", 3, "Reported.", "<action/>"]],
              [{"bill": 7, "relation": "identical"}]),
        _bill(2, "Republican", [["2015-03-01", 2, "Referred.", '<x state="PASS_OVER"/>']], []),
    ]}
    p = tmp_path / "bill.json"
    p.write_text(json.dumps(feed, indent=2))
    bills = docs.json_bills(spark, str(p))
    assert bills.count() == 2
    acts = sorted(tuple(r) for r in docs.json_actions(bills).select("bill_id", "seq", "action_date", "state").collect())
    assert [(a[0], a[1], str(a[2]), a[3]) for a in acts] == [
        ("HR1", 0, "2015-01-06", "REFERRED"), ("HR1", 1, "2015-02-09", None), ("HR2", 0, "2015-03-01", "PASS_OVER")]
    assert docs.json_titles(bills).count() == 4
    rel = sorted(tuple(r) for r in docs.json_related(bills).collect())
    assert rel == [("HR1", 7, "identical"), ("HR2", None, None)]
    members, sponsors = docs.json_members(bills)
    m = {r["bioguideid"]: r for r in members.collect()}
    assert m["X1"]["party"] == "D" and m["X0"]["party"] == "R"
    assert sponsors.count() == 2


def test_text_source_sink_and_catalog(spark, tmp_path):
    from caseflow.operators.relational import is_empty
    from caseflow.sources.tables import table_exists
    p = tmp_path / "titles.txt"
    p.write_text("First title\nsecond  title\n\nlast\n")
    t = docs.src_text(spark, str(p))
    rows = [r["text"] for r in t.orderBy("id").collect()]
    assert rows == ["First title", "second  title", "", "last"]
    out = tmp_path / "out"
    t.write.mode("overwrite").parquet(str(out))        # sink
    assert spark.read.parquet(str(out)).count() == 4
    t.createOrReplaceTempView("titles_tmp")
    assert table_exists(spark, "titles_tmp") and not table_exists(spark, "no_such_table")
    assert is_empty(t.where("text = 'missing'")) and not is_empty(t)


def test_one_hot(spark):
    from caseflow.operators import text as TX
    enc = spark.createDataFrame([(0, 2), (1, 0)], "pos long, y int")
    v = TX.t_one_hot(enc, 4).orderBy("pos").collect()
    assert v[0]["y_onehot"].size == 4 and v[0]["y_onehot"][2] == 1.0


def test_kpi_youngest_sponsor_from_documents(spark, tmp_path):
    from caseflow.operators.stats import kpis
    feed = {"objects": [_bill(1, "Democrat", [], []), _bill(2, "Republican", [], [])]}
    p = tmp_path / "bill.json"
    p.write_text(json.dumps(feed))
    members, _ = docs.json_members(docs.json_bills(spark, str(p)))
    feats = spark.createDataFrame([(3, 10), (7, 2)], "ac_count long, no_days int")
    r = kpis(feats, members).first()
    # X0 (bill 2, born 1960-03-01) is younger than X1 (bill 1, born 1960-02-01)
    assert (r["max_actions"], r["max_days"], r["youngest_sponsor"]) == (7, 10, "Member 0")


def test_jdbc_partitioned_read_needs_bounds(spark):
    import pytest
    from caseflow.sources.tables import src_jdbc
    # no database is started in tests; only the option checking is exercised
    with pytest.raises(ValueError):
        src_jdbc(spark, "jdbc:postgresql://db.invalid/x", "actions", partition_column="id")


def test_schema_info(spark):
    from caseflow.operators.stats import schema_info
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert [tuple(r) for r in schema_info(df).collect()] == [(1, "id", "bigint", True), (2, "name", "string", True)]


def test_unreadable_dates_and_short_entries_do_not_fail(spark):
    from pyspark.sql import functions as F
    feed = {"objects": [_bill(1, "Democrat", [["datetime.datetime(2015, 13, 40)", 2], ["datetime", 1], ["soon", 1, "x"], [None], [], ["2015-01-02T03:04:05", 3]], [])]}
    feed["objects"][0]["sponsor"]["birthday"] = "n/a"
    bills = spark.createDataFrame([(json.dumps(feed),)], "j string").select(F.from_json("j", docs.FEED).alias("f")).select(F.explode("f.objects").alias("o")).select("o.*")
    got = [str(r.action_date) for r in docs.json_actions(bills).orderBy("seq").collect()]
    assert got == ["None"] * 5 + ["2015-01-02"]
    assert docs.json_members(bills)[0].first().birthday is None


def test_text_source_numbers_lines_in_file_order(spark, tmp_path):
    want = []
    for i in range(6):
        lines = [f"file {i} line {j} " + "x" * (50 * (6 - i)) for j in range(300)]
        (tmp_path / f"part-{i}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = docs.src_text(spark, str(tmp_path)).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in got] == list(range(len(want))) and [r.text for r in got] == want
