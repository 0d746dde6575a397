"""Appends that count once, other charsets, stored search pages, sketches, lookups, the restarted job, late orders."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import search
from rivulet.operators.popularity import SketchedPopularity
from rivulet.plans.batch import rows_signature, run_batch
from rivulet.sources import commits, csv_io, keyed
from rivulet.streaming import late_orders

SCHEMA = "itemId long, title string"


# ---- appends -----------------------------------------------------------------------

def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_counts_once(spark, tmp_path):
    table = csv_io.appended_csv(spark, str(tmp_path / "t"))
    assert table.read(SCHEMA).count() == 0 and table.vacuum() == 0
    one = spark.createDataFrame([(1, 'x, "y"\nz'), (2, None)], SCHEMA)
    two = spark.createDataFrame([(3, " blank ")], SCHEMA)
    assert table.append(one, "2024/01 a%") and table.append(two, "b")
    assert not table.append(two, "b") and not table.append(one, "2024/01 a%")
    assert rows_of(table.read(SCHEMA)) == [(1, 'x, "y"\nz'), (2, None), (3, " blank ")]
    assert set(table.committed()) == {"2024/01 a%", "b"}
    with pytest.raises(ValueError):
        table.append(one, "")


def test_half_written_and_racing_attempts(spark, tmp_path):
    table = commits.Appended(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    dead = table.write_attempt(df, "1")
    assert table.read(SCHEMA).count() == 0
    first, second = table.write_attempt(df, "2"), table.write_attempt(df, "2")
    assert table.commit("2", first) and not table.commit("2", second)
    assert table.read(SCHEMA).count() == 1
    assert table.vacuum() == 2 and not os.path.exists(tmp_path / "t" / "data" / dead)
    assert table.append(df, "1") and table.read(SCHEMA).count() == 2
    assert table.read(SCHEMA, but={"1"}).count() == 1


def test_small_files_are_whole_and_replaced(spark, tmp_path):
    p = str(tmp_path / "d" / "x")
    assert commits.write_small_file(spark, p, "é\n1", replace=False)
    assert not commits.write_small_file(spark, p, "2", replace=False)
    assert commits.read_small_files(spark, str(tmp_path / "d")) == {"x": "é\n1"}
    assert commits.write_small_file(spark, p, "3", replace=True)
    assert commits.read_small_files(spark, str(tmp_path / "d")) == {"x": "3"}
    assert commits.read_small_files(spark, str(tmp_path / "none")) == {}


# ---- charsets ------------------------------------------------------------------------

def test_other_charsets_without_a_legacy_setting(spark, tmp_path):
    text = 'id,名字,x\n1,"男, ""女""\n保密",9\n2,𠀀é,\n'
    for charset in ("gb18030", "gbk", "big5", "cp1252"):
        body = text if charset == "gb18030" else text.replace("𠀀é", "ok").replace("男", "中").replace("女", "文").replace("保密", "字") if charset != "cp1252" \
            else 'id,名字,x\n1,"ä, ""ß""\né",9\n2,ok,\n'.replace("名字", "nämé")
        p = tmp_path / f"{charset}.csv"
        p.write_bytes(body.encode(charset))
        name = "nämé" if charset == "cp1252" else "名字"
        got = csv_io.read_csv(spark, str(p), f"x int, id long, `{name}` string", encoding=charset).collect()
        want = body.split('"', 1)[1].rsplit('",9', 1)[0].replace('""', '"')
        assert [(r.x, r.id) for r in got] == [(9, 1), (None, 2)] and got[0][name] == want
        again = str(tmp_path / f"out-{charset}")
        csv_io.write_csv(csv_io.read_csv(spark, str(p), f"id long, `{name}` string", encoding=charset), again, encoding=charset)
        assert rows_of(csv_io.read_csv(spark, again, f"id long, `{name}` string", encoding=charset)) == sorted((r.id, r[name]) for r in got)
    (tmp_path / "bad.csv").write_bytes(b"id,t\n1,\xff\xff\n")
    with pytest.raises(Exception):
        csv_io.read_csv(spark, str(tmp_path / "bad.csv"), "id long, t string", encoding="gb18030").collect()
    with pytest.raises(ValueError):
        csv_io.read_csv(spark, str(tmp_path / "gbk.csv"), "id long, nothing string", encoding="gbk")


def test_bom_on_request(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    csv_io.write_csv(df, str(tmp_path / "b"), bom=True)
    parts = [p for p in (tmp_path / "b").iterdir() if p.suffix == ".csv"]
    assert parts and all(p.read_bytes().startswith("﻿itemId,title".encode()) for p in parts)
    assert rows_of(csv_io.read_csv(spark, str(tmp_path / "b"), SCHEMA)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        csv_io.write_csv(df, str(tmp_path / "c"), bom=True, header=False)


# ---- stored search pages ----------------------------------------------------------------

def record(**more):
    r = {"title": "<em class='k'>a</em> & b", "author": "u", "bvid": "BV1", "pubdate": 86400, "duration": "3:07", "video_review": 4, "like": 5, "play": 6,
         "favorites": 7, "typename": "t", "tag": "x,y", "description": "d"} | more
    return {k: v for k, v in r.items() if v != "gone"}


def page(*records):
    return json.dumps({"code": 0, "data": {"result": list(records)}})


def test_search_pages(spark):
    rows = [(1, 200, page(record(), record(like="gone", video_review="gone", bvid="BV2")), "p"), (2, 200, page(record(author="gone")), "p"), (3, 412, page(record()), "p"),
            (4, None, page(record()), "p"), (5, 200, page(record())[:-9], "p"), (6, 200, '{"code": 1}', "p"), (7, 200, None, "p"), (8, 200, "", "p"),
            (9, 200, page(), "p"), (10, 200, page(record(author=None, like=None, play="many", pubdate=None)), "p"), (11, 200, '{"data": {"result": 5}}', "p"),
            (12, 200, '{"data": {"result": [null]}}', "p"), (13, 200, "[1]", "p"), (None, 200, page(record()), "p"), (1, 200, page(record()), "p")]
    pages = spark.createDataFrame(rows, "page_id long, status int, body string, records string")
    assert sorted(((r.page_id, r.reason) for r in search.search_rejects(pages).collect())) == [
        (2, "record"), (3, "status"), (4, "status"), (5, "malformed"), (6, "no result"), (7, "malformed"), (8, "malformed"), (11, "malformed"),
        (12, "record"), (13, "malformed")]
    items = search.search_items(pages).collect()
    assert sorted(str(r.page_id) for r in items) == ["1", "1", "1", "10", "None"]
    a, b = sorted((r for r in items if r.page_id == 1), key=lambda r: (r.bvid, r.pos))[::2]
    assert tuple(a)[1:] == (1, "a & b", "u", "BV1", "1970-01-02 00:00:00", "3:07", 4, 5, 6, 7, "t", "x,y", "d")
    assert (b.pos, b.bvid, b.danmaku, b.likes) == (2, "BV2", 0, 0)
    odd = next(r for r in items if r.page_id == 10)
    assert (odd.author, odd.likes, odd.plays, odd.uploaded, odd.danmaku) == (None, None, None, None, 4)
    assert search.search_items(pages.drop("status"), status_col=None).where("page_id = 3").count() == 1
    assert search.search_items(pages.limit(0)).count() == 0 and search.search_rejects(pages.limit(0)).count() == 0


# ---- sketches, lookups -------------------------------------------------------------------

def test_sketches_unite_over_batches_and_days(spark, tmp_path):
    rng = random.Random(1)
    day = [datetime.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(rng.choice(day), rng.randint(0, 3), f"u{rng.randint(0, 30)}") for _ in range(600)] + [(day[0], 9, "u1"), (None, 9, "u2"), (day[0], 9, None), (day[0], None, "u3")]
    table = SketchedPopularity(spark, str(tmp_path / "s"))
    assert table.popularity().count() == 0
    for i in (0, 1, 1, 2):
        table.append(spark.createDataFrame(rows[i::3], "day date, itemId long, userId string"), f"b{i}")
    for first, last in ((None, None), (day[1], None), (None, day[0]), (day[1], day[1])):
        want = {}
        for d, i, u in rows:
            if None not in (d, i, u) and (first is None or d >= first) and (last is None or d <= last):
                want.setdefault(i, set()).add(u)
        assert {r.itemId: r.user_count for r in table.popularity(first, last).collect()} == {i: len(u) for i, u in want.items()}  # small counts are exact


def test_lookup_reads_one_bucket(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 500).cast("string").alias("k"), "id").union(spark.createDataFrame([(None, -1)], "k string, id long"))
    keyed.write_keyed(df, str(tmp_path / "k"), "k", 16)
    found = keyed.read_keyed(spark, str(tmp_path / "k"), "k", "77")
    assert sorted(r.id for r in found.collect()) == [77, 577, 1077, 1577] and found.columns == ["k", "id"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_of_16" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,77)]" in plan
    for v in ("none", None):
        assert keyed.read_keyed(spark, str(tmp_path / "k"), "k", v).count() == 0
    keyed.write_keyed(df, str(tmp_path / "one"), "k")
    assert keyed.read_keyed(spark, str(tmp_path / "one"), "k", 77).count() == 4
    with pytest.raises(ValueError):
        keyed.write_keyed(df.withColumn("bucket_of_2", F.lit(1)), str(tmp_path / "p"), "k", 2)
    df.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        keyed.read_keyed(spark, str(tmp_path / "plain"), "k", 77)


# ---- the job goes on ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def job_tables(spark):
    rng = random.Random(4)
    users = [(u, "; ".join(str(rng.randint(1, 30)) for _ in range(6)), f"n{u}", rng.choice("MF"), u, 20 + u, 5 * u) for u in range(20)]
    items = [(i, i * 10, i, i, i * 90, i % 5, f"t{i}", "u1; u2") for i in range(1, 31)]
    return (spark.createDataFrame(users, "userId long, itemId string, name string, gender string, following long, age int, fans long"),
            spark.createDataFrame(items, "itemId long, length int, comment long, like long, watch long, share long, name string, userId string"))


def test_job_goes_on_where_it_stopped(spark, job_tables, tmp_path):
    users, items = job_tables
    options = dict(n_similar=3, rank=3, max_iter=2, n_recs=2, n_retrieval=10, k_users=3, k_items=4, lookup_buckets=4)
    out, done = str(tmp_path / "job"), {}

    def run(u=users, i=items, **more):
        report = []
        paths = run_batch(spark, u, i, out, report=report, **{**options, **more})
        done.clear()
        done.update(report)
        return paths, [n for n, what in report if what == "written"]

    assert run(stop_after="F4")[1] == ["interactions", "F3", "F3_by_key", "factors", "ranked", "F4"]
    before = {p: os.path.getmtime(p) for p in (f"{out}/factors/_SUCCESS", f"{out}/F4/_SUCCESS")}
    paths, written = run()
    assert written == ["Retrieval", "Retrieval_by_key", "F5", "F5_by_key", "item_clusters", "F6", "user_clusters", "F7", "Filtered_Recommendations"]
    assert before == {p: os.path.getmtime(p) for p in before}
    assert run()[1] == []
    assert run(k_items=5)[1] == ["item_clusters", "F6", "Filtered_Recommendations"]
    assert run(k_items=5, n_recs=1)[1] == ["F4"]
    assert run(i=items.where("itemId < 30"), k_items=5, n_recs=1)[1] == ["item_clusters", "F6", "Filtered_Recommendations"]
    assert "F3" in run(u=users.where("userId < 19"))[1]
    # a stage that died while writing is not in the ledger: it is written again
    os.remove(f"{out}/_stages/F7")
    os.remove(f"{out}/F7/_SUCCESS")
    assert run(u=users.where("userId < 19"))[1] == ["F7"]
    assert keyed.read_keyed(spark, paths["Retrieval_by_key"], "userId", "3").count() == 1


def test_signature_of_rows(spark, job_tables):
    users, _ = job_tables
    assert rows_signature(users) == rows_signature(users.repartition(5)) != rows_signature(users.withColumn("age", F.col("age") + 1))
    assert rows_signature(users.union(users.limit(1))) != rows_signature(users)


# ---- late orders -----------------------------------------------------------------------------

LINE, ORDER = "l_orderkey long, l_partkey long, l_time timestamp", "o_orderkey long, o_custkey long, o_time timestamp"


def t(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_lines_before_their_order_count(spark, tmp_path):
    path = str(tmp_path / "s")
    li, od = str(tmp_path / "lines"), str(tmp_path / "orders")

    def add(folder, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def now():
        lines = late_orders.file_stream(spark, li, "*.parquet", spark.createDataFrame([], LINE).schema)
        orders = late_orders.file_stream(spark, od, "*.parquet", spark.createDataFrame([], ORDER).schema)
        return {r.itemId: r.user_count for r in late_orders.run_late_orders(spark, lines, orders, path, state_partitions=2).read().collect()}

    add(li, [(1, 10, t(1)), (1, 11, t(1)), (2, 10, t(2)), (None, 10, t(2)), (3, None, t(3)), (9, 12, t(3))], LINE)
    add(od, [], ORDER)
    assert now() == {}
    add(od, [(1, 100, t(0)), (2, 100, t(0))], ORDER)
    assert now() == {10: 1, 11: 1}  # both orders are of one user
    add(od, [(9, 101, t(0)), (4, 102, t(0)), (None, 1, t(0))], ORDER)
    add(li, [(4, 10, t(4)), (4, 10, t(4)), (9, 10, t(5))], LINE)
    assert now() == {10: 3, 11: 1, 12: 1}
    assert now() == {10: 3, 11: 1, 12: 1}


def test_readers_see_whole_tables_and_batches_count_once(spark, tmp_path):
    table = late_orders.PointedTable(spark, str(tmp_path / "p"))
    counts = lambda *rows: spark.createDataFrame(rows, late_orders.SCHEMA)
    assert table.pointer() is None and table.read().count() == 0
    assert table.add(counts((1, 5), (2, 1)), 0) and not table.add(counts((1, 5)), 0)
    reader = table.read()
    spark.createDataFrame([(7, 7)], late_orders.SCHEMA).write.parquet(str(tmp_path / "p" / "table-000000000001-dead"))  # died before its pointer
    assert rows_of(table.read()) == [(1, 5), (2, 1)]
    assert table.add(counts((1, 1), (3, 2)), 1)
    assert rows_of(reader) == [(1, 5), (2, 1)] and rows_of(table.read()) == [(1, 6), (2, 1), (3, 2)]
    for n in range(2, 7):
        table.add(counts((1, 1)), n)
    assert rows_of(table.read()) == [(1, 11), (2, 1), (3, 2)]
    assert len([p for p in (tmp_path / "p").iterdir() if p.name.startswith("table-")]) <= late_orders.KEPT + 1


def test_bounded_state_with_times(spark, tmp_path):
    li, od = str(tmp_path / "lines"), str(tmp_path / "orders")
    spark.createDataFrame([(1, 10, t(5)), (2, 11, t(50))], LINE).write.parquet(li)
    spark.createDataFrame([(1, 100, t(1)), (2, 101, t(1))], ORDER).write.parquet(od)
    lines = late_orders.file_stream(spark, li, "*.parquet", spark.createDataFrame([], LINE).schema)
    orders = late_orders.file_stream(spark, od, "*.parquet", spark.createDataFrame([], ORDER).schema)
    got = late_orders.run_late_orders(spark, lines, orders, str(tmp_path / "o"), times=("l_time", "o_time", "10 minutes"), state_partitions=2)
    assert rows_of(got.read()) == [(10, 1)]  # the other line is 49 minutes after its order
