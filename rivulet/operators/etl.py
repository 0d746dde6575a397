"""Cleaning of raw item and user tables, audience quotas, keyed sampling,
list inversion, sequential row ids (C13-C17, P3-P6, P11, F19, A9, A10, W7, T5, T6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rivulet.functions.lists import long_to_wide, wide_to_long
from rivulet.functions.scalars import clamp_int, normalize_gender, parse_duration, round_half_even


def row_ids(df: DataFrame, order_cols: list[str], out_col: str = "row_id", start: int = 1,
            partitions: int | None = None) -> DataFrame:
    """Sequential ids start, start+1, ... in the order of ``order_cols`` (P11),
    without a single-partition window: range-partition and sort, tag each row
    with its partition and index, write the tagged rows once (checkpoint),
    count rows per partition (one small aggregate), turn the counts into
    offsets with a window over the partition count table only (#partitions
    rows), and add them to each row's index.  The sort keys must be unique
    for the numbering to be deterministic."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # Both branches below (counts and the final join) must see the same range
    # partitioning; the range sampler's seed depends on the RDD, so write the
    # tagged rows once instead of trusting exchange reuse.
    from rivulet.session import checkpoint_dir
    checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + F.col("_idx") + F.lit(start)).cast("long"))
            .drop("_pid", "_mid", "_idx", "_off"))


def encode_ids(df: DataFrame, col: str, out_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dense codes 0..n-1 of the distinct values of ``col`` in sorted order
    (F19).  Returns (df with the code, dictionary (value, code)); decoding is
    a join with the dictionary."""
    out_col = out_col or f"{col}_idx"
    dictionary = row_ids(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out_col, start=0)
    return df.join(dictionary, col, "left"), dictionary


def clean_items(raw: DataFrame, order_col: str = "key") -> DataFrame:
    """raw items -> (itemId, length, comment, like, watch, share, name, category)
    (C13): duration parsed to seconds, counters renamed, rows without length or
    name dropped, ids 1..n in raw order."""
    items = raw.select(
        order_col,
        parse_duration("duration").alias("length"),
        F.col("comments").cast("long").alias("comment"),
        F.col("likes").cast("long").alias("like"),
        F.col("plays").cast("long").alias("watch"),
        F.col("favourites").cast("long").alias("share"),
        F.col("title").alias("name"),
        "category").na.drop(subset=["length", "name"])
    items = row_ids(items, [order_col], "itemId")
    return items.select("itemId", "length", "comment", "like", "watch", "share", "name", "category")


def invert_lists(wide_items: DataFrame, item_col: str = "itemId", list_col: str = "userId",
                 sep: str = ";", out_sep: str = "; ") -> DataFrame:
    """item -> users lists into user -> items lists (C16): (userId, itemId), one
    row per user, items in item-row order, duplicates kept, blank user tokens
    ignored.  This is the wide form for a sink; ``inverted_pairs`` is the same
    as long rows."""
    long = inverted_pairs(wide_items, item_col, list_col, sep)
    return long_to_wide(long, "userId", "itemId", ["itemId", "pos"], sep=out_sep)


def inverted_pairs(wide_items: DataFrame, item_col: str = "itemId", list_col: str = "userId",
                   sep: str = ";") -> DataFrame:
    """(userId, itemId, pos): one row per non-blank user token of an item's list."""
    long = wide_to_long(wide_items.select(item_col, list_col), item_col, list_col, sep, drop_blank=True,
                        pos_col="pos")
    return long.select(F.col(list_col).alias("userId"), F.col(item_col).alias("itemId"), "pos")


def renumber_users(raw: DataFrame, order_cols: list[str]) -> DataFrame:
    """Raw users with ids 1..n in the order of ``order_cols`` (unique together) in place
    of their own, which may repeat or have gaps; level dropped, age clamped to [14, 60]."""
    u = row_ids(raw.drop("level", "id"), order_cols, "id")
    return u.withColumn("age", clamp_int("age", 14, 60))


def clean_users(raw: DataFrame, user_lists: DataFrame, seed: int = 42) -> DataFrame:
    """raw users -> (userId, itemId, name, gender, following, age, fans), one row
    per user (C17): level dropped if present, gender normalised, the given age
    clamped to [14, 60] (null stays null), users without an item list dropped
    (inner join).  Ids are kept; ``renumber_users`` makes new ones first."""
    u = raw.drop("level")
    u = u.select(F.col("id").cast("string").alias("userId"), "name",
                 normalize_gender("sex", "id", seed).alias("gender"),
                 "following", clamp_int("age", 14, 60).alias("age"), "fans")
    lists = user_lists.select(F.col("userId").cast("string").alias("userId"), "itemId")
    return u.join(lists, "userId").select("userId", "itemId", "name", "gender", "following", "age", "fans")


def category_share(items: DataFrame, cat_col: str = "category", watch_col: str = "watch") -> DataFrame:
    """(category, cat_watch, share) with share = category watch / total watch; a null category
    counts in the total but is no group (A9, A10)."""
    total = items.agg(F.sum(watch_col).alias("t")).first()["t"] or 0
    cats = items.where(F.col(cat_col).isNotNull()).groupBy(cat_col).agg(F.sum(watch_col).alias("cat_watch"))
    return cats.withColumn("share", F.col("cat_watch") / F.lit(float(total)) if total else F.lit(None))


#: Smallest and largest quota of an item whose category has users.
QUOTA_LOW, QUOTA_HIGH = 20, 100


def audience_quota(items: DataFrame, n_users: int, cat_col: str = "category", watch_col: str = "watch",
                   lo: int = QUOTA_LOW, hi: int = QUOTA_HIGH, scale: int = 100) -> DataFrame:
    """(itemId, category, k) (C14, F4): a category pool of
    min(round(share * n_users * scale), n_users) users; per item
    k = clamp(round(pool * scale * watch / cat_watch), lo, hi), or 0 when the
    category has no watch or no pool.  Rounding is half to even."""
    cats = category_share(items, cat_col, watch_col)
    pool = F.least(round_half_even(F.col("share") * F.lit(n_users) * F.lit(scale)), F.lit(n_users))
    cats = cats.select(cat_col, "cat_watch", F.when(pool > 0, pool).otherwise(F.lit(0)).alias("pool"))
    j = items.select("itemId", cat_col, watch_col).join(cats, cat_col, "left")
    ratio = F.col(watch_col) / F.col("cat_watch")
    k = F.greatest(F.lit(lo), F.least(round_half_even(F.col("pool") * F.lit(scale) * ratio), F.lit(hi)))
    ok = (F.col("cat_watch") > 0) & (F.col("pool") > 0)
    return j.select("itemId", cat_col, F.when(ok, k).otherwise(F.lit(0)).cast("long").alias("k"))


def keyed_sample(df: DataFrame, group: str, id_col: str, k: int | str, seed: int = 42, at_most: int | None = None) -> DataFrame:
    """Deterministic sample without replacement: per group the rows with the
    smallest md5('seed:group:id') (T5, T6).  ``k`` is a number or a column
    with a per-group size that is never above ``at_most`` (for quotas, their upper
    clamp): the window keeps no more rows of a group than that before the shuffle
    (WindowGroupLimit).  Without ``at_most`` the largest size is read first, which
    runs ``df`` twice."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(id_col).cast("string")))
    w = Window.partitionBy(group).orderBy(key, F.col(id_col))
    limit = k if isinstance(k, int) else at_most if at_most is not None else df.agg(F.max(k)).first()[0] or 0
    ranked = df.withColumn("rank", F.row_number().over(w))
    ranked = ranked.where(F.col("rank") <= limit)
    if isinstance(k, str):
        ranked = ranked.where(F.col("rank") <= F.col(k))
    return ranked
