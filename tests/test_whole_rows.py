"""Queries take all rows: whole logs, texts of any kind, orders without items."""

import os

import duckdb
import pytest

from treegrammar.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_a_log_is_all_of_a_users_events(spark):
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    got = {n: [r.valid for r in QUERIES[n](spark, SF).collect()] for n in QUERIES if n.startswith("events_log_")}
    got |= {n: [r.valid for r in QUERIES[n](spark, SF).collect()] for n in ("events_choice_star", "events_optional", "events_interleave")}
    assert len(got) == 9 and all(len(v) == users for v in got.values())
    assert not any(got["events_interleave"])
    assert 0 < sum(got["events_log_interleave_loose"]) < users


def test_texts_with_controls_and_nulls_are_validated(spark, tmp_path):
    texts = [None, "", "plain & <b>", "a\r\nb\rc", "x\x01y", "x\ufffey", "x\x0cy", "a" * 1500, "a" * 1501, "\r\n" * 1500, "\r\n" * 1501, "\r" * 1500, "\r" * 1501, "é\t" * 750, "\U0001f600" * 1501]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.valid) for r in QUERIES["entities_in_all_text"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["entities_in_all_text"]).fetchall())
    assert [v for _, v in got] == [False, True, True, True, False, False, False, True, False, True, False, True, False, True, False]


def test_orders_without_items_are_not_valid(spark):
    orders, items = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet")
    bare = {r.o_orderkey for r in orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").collect()}
    got = {r.o_orderkey: r.error_kind for r in QUERIES["first_error"](spark, SF).collect()}
    assert bare and len(got) == orders.count() and {k for k, e in got.items() if e == "element-close"} == bare
