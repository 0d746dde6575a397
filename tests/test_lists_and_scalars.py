"""Edge rows for the list codecs and scalar rules (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from rivulet.functions.lists import count_splits, long_to_wide, numeric_tokens, wide_to_long
from rivulet.functions.scalars import (LEVEL_MARKERS, clamp_int, epoch_seconds, extract_or_default,
                                       first_match_class, format_epoch, gender_code, normalize_gender,
                                       parse_duration, round_half_even, strip_tags, thousands)

LISTS = [(1, "1;2;"), (2, " 1 ; 2"), (3, ";;"), (4, ""), (5, None), (6, "\t7\t;8"), (7, "9;9"), (8, "42")]


def _lists(spark):
    return spark.createDataFrame(LISTS, "userId long, itemId string")


def test_wide_to_long_drop_blank(spark):
    rows = wide_to_long(_lists(spark), "userId", "itemId", ";", drop_blank=True, pos_col="pos").collect()
    got = sorted((r.userId, r.pos, r.itemId) for r in rows)
    assert got == [(1, 0, "1"), (1, 1, "2"), (2, 0, "1"), (2, 1, "2"), (6, 0, "7"), (6, 1, "8"),
                   (7, 0, "9"), (7, 1, "9"), (8, 0, "42")]


def test_wide_to_long_keep_blank(spark):
    rows = wide_to_long(_lists(spark), "userId", "itemId", ";", drop_blank=False).collect()
    got = sorted((r.userId, r.itemId) for r in rows)
    assert (1, "") in got and got.count((3, "")) == 3 and (4, "") in got
    assert all(u != 5 for u, _ in got)          # a null list gives no rows


def test_long_to_wide_order_and_round_trip(spark):
    df = spark.createDataFrame([(1, 3, 2), (1, 1, 7), (1, 2, 5), (2, 1, 4)], "userId long, rank int, itemId long")
    rows = {r.userId: r.itemId for r in long_to_wide(df, "userId", "itemId", ["rank"], "; ").collect()}
    assert rows == {1: "7; 5; 2", 2: "4"}
    back = wide_to_long(long_to_wide(df, "userId", "itemId", ["rank"], ";"), "userId", "itemId", ";", pos_col="p")
    assert sorted((r.userId, r.p, r.itemId) for r in back.collect()) == [(1, 0, "7"), (1, 1, "5"), (1, 2, "2"),
                                                                       (2, 0, "4")]


def test_numeric_tokens_and_count_splits(spark):
    df = spark.createDataFrame([("x; 3 ;4a;-1; 5;5;",), (None,), ("",)], "s string")
    rows = df.select(numeric_tokens("s").alias("a"), count_splits("s").alias("n")).collect()
    assert rows[0].a == [3, 5, 5] and rows[0].n == 6
    assert rows[1].n == 0 and rows[2].n == 0 and rows[2].a == []


def test_parse_duration(spark):
    vals = ["3:45", "1:02:03", "3:75", "300", "a:b", "", None, " 3:05", "1:2:3:4"]
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    got = [r.s for r in df.select(parse_duration("d").alias("s")).collect()]
    assert got == [225, 3723, 255, None, None, None, None, 185, None]


def test_gender_rules(spark):
    df = spark.createDataFrame([(1, "男"), (2, "女"), (3, "保密"), (4, None)], "id long, sex string")
    rows = df.select("id", normalize_gender("sex", "id").alias("g")).collect()
    g = {r.id: r.g for r in rows}
    assert g[1] == "M" and g[2] == "F" and g[3] in ("M", "F") and g[4] in ("M", "F")
    again = {r.id: r.g for r in df.select("id", normalize_gender("sex", "id").alias("g")).collect()}
    assert again == g                          # deterministic
    codes = spark.createDataFrame([("M",), ("F",), ("X",), (None,)], "g string").select(gender_code("g").alias("c"))
    assert [r.c for r in codes.collect()] == [0, 1, None, None]


def test_rounding_and_clamp(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (13.9,), (75.0,)], "x double")
    rows = df.select(round_half_even("x").alias("r"), clamp_int("x", 14, 60).alias("c")).collect()
    assert [r.r for r in rows] == [2, 4, 0, 14, 75]
    assert [r.c for r in rows] == [14, 14, 14, 14, 60]


def test_page_rules(spark):
    df = spark.createDataFrame([
        ('{"name":"Ann","sex":"女"} lv4 lv1', "https://h.example.com/space/12"),
        ('{"name":"","sex":"男"}', "http://x.org/a/b"),
        ("no marker here", "https://q.net/7"),
    ], "html string, url string")
    rows = df.select(
        extract_or_default("html", r'"name":"(.*?)"').alias("name"),
        extract_or_default("html", r'"age":"(.*?)"').alias("age"),
        first_match_class("html", LEVEL_MARKERS).alias("level"),
        F.regexp_replace("url", "^https?://[^/]+", "").alias("path")).collect()
    assert rows[0].name == "Ann" and rows[0].age == "未知" and rows[0].level == 1
    assert rows[1].name == "" and rows[1].level == -1 and rows[1].path == "/a/b"
    assert rows[2].name == "未知"
    t = spark.createDataFrame([("<em>a</em> b <i>c</i>",)], "t string").select(strip_tags("t").alias("t"))
    assert t.first().t == "a b c"


def test_epoch_and_thousands(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.5' AS ts, 1234567 AS n")
    r = df.select(epoch_seconds("ts").alias("e"), format_epoch(epoch_seconds("ts")).alias("s"),
                  thousands("n").alias("t")).first()
    assert r.e == 1704067207 and r.s == "2024-01-01 00:00:07" and r.t == "1,234,567"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r2 = df.select(epoch_seconds("ts").alias("e"), format_epoch(epoch_seconds("ts")).alias("s")).first()
        assert (r2.e, r2.s) == (r.e, r.s)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_duration_beyond_int_is_null(spark):
    df = spark.createDataFrame([("999999:00:00",), ("2147483647:2147483647:1",), ("1:02:03",)], "d string")
    assert [r[0] for r in df.select(parse_duration("d")).collect()] == [None, None, 3723]
