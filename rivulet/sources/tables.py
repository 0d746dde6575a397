"""Readers for the parquet test tables and the domain stand-ins built from them.

Each stand-in is a plain DataFrame derivation, so its size grows with the
input tables.  The same derivations are written in SQL in
``rivulet/plans/oracles.py`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rivulet.functions.lists import long_to_wide

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_inter: distinct (userId, itemId) = (customer, part) over order lines."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("itemId"))
            .distinct())


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_events: small dense interactions from events.props $.k."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.select(F.col("user_id").alias("userId"),
                      F.get_json_object("props", "$.k").cast("bigint").alias("itemId"))
            .distinct())


def item_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_meta: itemId, cluster (three size bands), watch (total quantity, 0 if none)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    qty = (read_table(spark, sf_dir, "lineitem").groupBy("l_partkey")
           .agg(F.sum("l_quantity").cast("bigint").alias("w")))
    return (part.join(qty, part.p_partkey == qty.l_partkey, "left")
            .select(F.col("p_partkey").alias("itemId"),
                    F.when(F.col("p_size") <= 24, 0).when(F.col("p_size") <= 48, 1).otherwise(2).alias("cluster"),
                    F.coalesce(F.col("w"), F.lit(0)).cast("bigint").alias("watch")))


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_recs: one ranked list per user (pos 0-based, order by md5 of 'user:item')."""
    inter = interactions(spark, sf_dir)
    key = F.md5(F.concat(F.col("userId").cast("string"), F.lit(":"), F.col("itemId").cast("string")))
    w = Window.partitionBy("userId").orderBy(key)
    return inter.select("userId", "itemId", (F.row_number().over(w) - 1).alias("pos"))


SEGMENT_GENDER = {"AUTOMOBILE": "M", "MACHINERY": "M", "FURNITURE": "F", "HOUSEHOLD": "F"}
SEGMENT_SEX = {"AUTOMOBILE": "男", "MACHINERY": "男", "FURNITURE": "女", "HOUSEHOLD": "女", "BUILDING": "保密"}


def _segment_map(col: str, mapping: dict) -> F.Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out


def user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read_table(spark, sf_dir, "orders").groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders")))


def users_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users: userId, itemId list ('1; 5; 9' by item id), name, gender, following, age, fans."""
    c = read_table(spark, sf_dir, "customer")
    lists = long_to_wide(interactions(spark, sf_dir), "userId", "itemId", ["itemId"], sep="; ")
    n_orders = user_orders(spark, sf_dir)
    return (c.join(n_orders, c.c_custkey == n_orders.o_custkey, "left")
            .select(F.col("c_custkey").alias("userId"),
                    F.col("c_name").alias("name"),
                    _segment_map("c_mktsegment", SEGMENT_GENDER).alias("gender"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("following"),
                    (F.lit(14) + F.col("c_custkey") % 47).cast("int").alias("age"),
                    F.abs(F.col("c_acctbal")).cast("bigint").alias("fans"))
            .join(lists, "userId", "left")
            .select("userId", "itemId", "name", "gender", "following", "age", "fans"))


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_users: id, mid, name, sex (男/女/保密/null), following, fans, level (-1..6), age."""
    c = read_table(spark, sf_dir, "customer")
    n_orders = user_orders(spark, sf_dir)
    return (c.join(n_orders, c.c_custkey == n_orders.o_custkey, "left")
            .select(F.col("c_custkey").alias("id"),
                    F.concat(F.lit("mid"), F.col("c_custkey").cast("string")).alias("mid"),
                    F.col("c_name").alias("name"),
                    _segment_map("c_mktsegment", SEGMENT_SEX).alias("sex"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("following"),
                    F.abs(F.col("c_acctbal")).cast("bigint").alias("fans"),
                    (F.col("c_nationkey") % 8 - 1).cast("int").alias("level"),
                    F.when(F.col("c_custkey") % 19 != 0, F.col("c_custkey") % 80).cast("int").alias("age")))


def skewed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """itemId, watch (a cube, so that quotas spread over their range) and category: brands,
    one category without any watch, one with next to none, and null."""
    p = read_table(spark, sf_dir, "part")
    r = F.col("p_partkey") % 97
    cat = F.when(r == 0, "none").when(r == 1, "tiny").when(r != 2, F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("itemId"), (r * r * r).cast("long").alias("watch"), cat.alias("category"))


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: order lines, distinct orders and distinct suppliers."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.countDistinct("l_suppkey").alias("n_supp"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_items: key, title, duration text, comments, likes, plays, favourites, category.

    Durations are 'size:ss', with two other shapes mixed in so the null path of
    the parser is exercised: plain seconds every 13th part, 'h:m:s' every 17th."""
    part = read_table(spark, sf_dir, "part")
    cnt = item_counts(spark, sf_dir)
    meta = item_meta(spark, sf_dir)
    k = F.col("p_partkey")
    mmss = F.concat(F.col("p_size").cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    dur = (F.when(k % 13 == 0, F.col("p_size").cast("string"))
           .when(k % 17 == 0, F.concat(F.lit("1:"), mmss))
           .otherwise(mmss))
    return (part.join(cnt, part.p_partkey == cnt.l_partkey, "left")
            .join(meta, part.p_partkey == meta.itemId, "left")
            .select(k.alias("key"),
                    F.col("p_name").alias("title"),
                    dur.alias("duration"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("comments"),
                    F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("likes"),
                    F.col("watch").cast("bigint").alias("plays"),
                    F.coalesce(F.col("n_supp"), F.lit(0)).cast("bigint").alias("favourites"),
                    F.col("p_type").alias("category")))


def items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items: itemId, length, comment, like, watch, share, name, userId list, category."""
    part = read_table(spark, sf_dir, "part")
    cnt = item_counts(spark, sf_dir)
    meta = item_meta(spark, sf_dir)
    aud = long_to_wide(interactions(spark, sf_dir), "itemId", "userId", ["userId"], sep="; ")
    k = F.col("p_partkey")
    return (part.join(cnt, part.p_partkey == cnt.l_partkey, "left")
            .join(meta, part.p_partkey == meta.itemId, "left")
            .select(k.alias("itemId"),
                    (F.col("p_size") * 60 + k % 60).cast("int").alias("length"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("comment"),
                    F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("like"),
                    F.col("watch").cast("bigint").alias("watch"),
                    F.coalesce(F.col("n_supp"), F.lit(0)).cast("bigint").alias("share"),
                    F.col("p_name").alias("name"),
                    F.col("p_type").alias("category"))
            .join(aud, "itemId", "left")
            .select("itemId", "length", "comment", "like", "watch", "share", "name", "userId", "category"))


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even embedding ids are users; bias label/20 (it cancels in the scaled score)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").alias("userId"), F.col("embedding").alias("features"),
        (F.col("label") / 20.0).alias("bias"))


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd embedding ids are items; bias label/10."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 2 == 1).select(
        F.col("vec_id").alias("itemId"), F.col("embedding").alias("features"),
        (F.col("label") / 10.0).alias("bias"))


def factor_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen pairs for the factor tables: user u saw items u+1, u+3, ..., u+2*label+1
    (those that exist), i.e. between 1 and 10 items per user."""
    e = read_table(spark, sf_dir, "embeddings")
    users = e.where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("userId"), "label")
    items = e.where(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("itemId"))
    cand = users.select("userId", F.explode(F.sequence(F.lit(0), F.col("label"))).alias("j")) \
        .select("userId", (F.col("userId") + 2 * F.col("j") + 1).alias("itemId"))
    return cand.join(items, "itemId", "left_semi").select("userId", "itemId")


PAGE_RECORDS = 20


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, status, body: stored JSON answers of a search, ``PAGE_RECORDS`` parts a page.

    Some records lack the counts that have a default; some pages failed, were
    cut off, hold no list, or have a record without author."""
    p = read_table(spark, sf_dir, "part")
    k, page = F.col("p_partkey"), F.floor(F.col("p_partkey") / PAGE_RECORDS).cast("long")
    author = F.when(~((page % 23 == 4) & (k % PAGE_RECORDS == 7)), F.concat(F.lit("up"), F.col("p_size").cast("string")))
    record = F.struct(
        F.concat(F.lit('<em class="keyword">'), F.col("p_brand"), F.lit("</em> "), F.col("p_name")).alias("title"), author.alias("author"),
        F.concat(F.lit("BV"), k.cast("string")).alias("bvid"), (F.lit(1500000000) + k * 3600).alias("pubdate"),
        F.concat(F.col("p_size").cast("string"), F.lit(":07")).alias("duration"), F.when(k % 5 != 0, k % 1000).alias("video_review"),
        F.when(k % 7 != 0, k * 3).alias("like"), (k * 10).alias("play"), (k % 100).alias("favorites"), F.col("p_type").alias("typename"),
        F.concat_ws(",", "p_brand", "p_type").alias("tag"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"\n')).alias("description"))
    pages = p.groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), record.alias("r")))).alias("rs"))
    whole = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.transform("rs", lambda x: x["r"]).alias("result")).alias("data")))
    n = F.col("page_id")
    cut = F.when(n % 17 == 3, F.expr("substr(body, 1, length(body) - 10)")).when(n % 31 == 6, F.lit('{"code": -412}')).otherwise(F.col("body"))
    return pages.select("page_id", whole.alias("body")).select("page_id", F.when(n % 29 == 5, 412).otherwise(200).alias("status"), cut.alias("body"))
