"""User-based collaborative filtering: co-counts, similarity, neighbours,
recommendations (C1-C3, J1, A2-A8).

sim(u, v) = sum over common items i of w_i / sqrt(|I(u)| * |I(v)|), with
w_i = 1 ('cosine') or 1 / ln(1 + |U(i)|) (any other method name, 'iif').
Only pairs with a common item exist; a user is never its own neighbour.
User and item ids may be of any type that can be ordered and hashed.

Weights are whole numbers (IIF weights in units of 1 / WEIGHT_UNITS), so sums
do not depend on their order.  The neighbours of one user u are ordered by
sum / sqrt(|I(v)|), which is sim(u, v) without the factor that all of them
share, ties by smaller id: the order of two neighbours then depends on their
own sums and sizes alone, whichever way a pair was found.

Scale, two ways with the same rows, chosen by their cost.

Lists (most user pairs share nothing).  The audience of an item is one list, or
several of about ``bucket_size`` users if it is larger, so that no row holds the
whole audience of a popular item.  Every user gets the lists of its items, and its
pairs are made and summed where they arrive: the lists are shuffled, never the
pairs.  A listed user is one whole number of its id and its size where both fit.

Grid (few items, most users share some).  Blocks of users are multiplied with all
users in ``sets.match_sets``; users are copied once per block, and pairs are final
where they are made.

The top-k operators (similar users, user-CF recommendations) form no user pairs
inside very popular items: see ``nearest_users``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from rivulet.functions.lists import long_to_wide, strip_ws
from rivulet.functions.scalars import cosine_norm, iif_weight
from rivulet.operators.sets import MAX_ITEMS, match_sets
from rivulet.operators.topk import top_k

DEFAULT_BUCKET = 1024
PAIRS_PER_TASK = 2_000_000   # pair rows made in one task; sets the partition count
GRID_CELLS = 1_000           # cells of a block product that cost as much as one pair of a list
LIST_ITEMS = 4_096           # items in one row of a user's list
HOT_USERS = 10_000           # items with more users are compared class by class; any value gives the same rows
WEIGHT_UNITS = 10 ** 12     # IIF weights are whole multiples of 1 / WEIGHT_UNITS (a pair sum fits a long up to 10 M common items, then raises)
SCORE_UNITS = 10 ** 15       # similarities are summed to scores in these units


def distinct_interactions(inter: DataFrame, user_col: str = "userId", item_col: str = "itemId") -> DataFrame:
    """Distinct (userId, itemId); null ids and blank string ids dropped (A2)."""
    d = inter.select(F.col(user_col).alias("userId"), F.col(item_col).alias("itemId"))
    d = d.where(F.col("userId").isNotNull() & F.col("itemId").isNotNull())
    if dict(d.dtypes)["itemId"] == "string":
        d = d.withColumn("itemId", strip_ws("itemId")).where(F.col("itemId") != "")
    return d.distinct()


def user_item_sets(inter: DataFrame) -> DataFrame:
    """(userId, items): the sorted item set of each user, the edge form of A2 for a
    sink; the operators themselves work on ``distinct_interactions``."""
    return distinct_interactions(inter).groupBy("userId").agg(F.sort_array(F.collect_list("itemId")).alias("items"))


def items_per_user(inter: DataFrame) -> DataFrame:
    """(userId, n_items): distinct items per user."""
    return distinct_interactions(inter).groupBy("userId").agg(F.count(F.lit(1)).alias("n_items"))


def item_audience(inter: DataFrame) -> DataFrame:
    """(itemId, n_users): distinct users per item (A4 as counts)."""
    return distinct_interactions(inter).groupBy("itemId").agg(F.count(F.lit(1)).alias("n_users"))


def materialized_interactions(inter: DataFrame) -> DataFrame:
    """Distinct interactions written once to the shared checkpoint folder: the
    pair join reads them from several branches (counts per user, per item,
    both join sides, the seen filter), which then scan the written table
    instead of re-deriving it."""
    from rivulet.session import checkpoint_dir
    checkpoint_dir(inter.sparkSession)
    return distinct_interactions(inter).checkpoint(eager=True)


def _units(method: str) -> int:
    return 1 if method == "cosine" else WEIGHT_UNITS


def _item_weights(d: DataFrame, method: str) -> DataFrame:
    """(itemId, size, w): audience and whole-number weight of every item."""
    w = (F.lit(1).cast("long") if method == "cosine"
         else F.floor(iif_weight("size") * F.lit(float(WEIGHT_UNITS)) + F.lit(0.5)).cast("long"))
    return d.groupBy("itemId").agg(F.count(F.lit(1)).alias("size")).select("itemId", "size", w.alias("w"))


class _Entry:
    """How a user of ``users`` (userId, n, ...) travels: as one whole number of id and size where they fit, else as a struct."""

    def __init__(self, users: DataFrame):
        self.kind, self.attrs, self.base = users.schema["userId"].dataType, [c for c in users.columns if c not in ("userId", "n")], None
        if isinstance(self.kind, IntegralType) and not self.attrs:
            r = users.agg(F.min("userId").alias("lo"), F.max("userId").alias("hi"), F.max("n").alias("n")).first()
            span = (r["hi"] - r["lo"] + 1) * (r["n"] + 1) if r["n"] else 1 << 63
            if span < 1 << 63:
                self.lo, self.base, self.type = r["lo"], r["n"] + 1, "int" if span < 1 << 31 else "long"

    def pack(self) -> Column:
        if self.base is None:
            return F.struct("userId", "n", *self.attrs)
        return ((F.col("userId").cast("long") - F.lit(self.lo)) * F.lit(self.base) + F.col("n")).cast(self.type)

    def user(self, c: str) -> Column:
        return F.col(c)["userId"] if self.base is None else (F.expr(f"{c} div {self.base}") + F.lit(self.lo)).cast(self.kind)

    def size(self, c: str) -> Column:
        return F.col(c)["n"] if self.base is None else (F.col(c) % F.lit(self.base)).cast("long")


def _facts(items: DataFrame) -> tuple[int, int, int]:
    """(items, largest audience, sum of the squared audiences)"""
    r = items.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.sum(F.col("size") * F.col("size")).alias("sq")).first()
    return r["n"], r["top"] or 0, r["sq"] or 0


def _by_grid(d: DataFrame, n_users: int, facts: tuple[int, int, int]) -> bool:
    """Whether block products cost less than the lists."""
    plain = all(isinstance(d.schema[c].dataType, (IntegralType, StringType, DateType)) for c in ("userId", "itemId"))
    return plain and facts[0] <= MAX_ITEMS and n_users * n_users * facts[0] <= GRID_CELLS * facts[2]


def _listed(d: DataFrame, items: DataFrame, facts: tuple[int, int, int], bucket_size: int, users: DataFrame,
            both: bool) -> tuple[DataFrame, _Entry]:
    """(u, v, co) for pairs with a common item among ``items`` (itemId, size, w), and how u and v are to be read: u < v,
    or with ``both`` both directions.  Dealt by u."""
    entry = _Entry(users)
    nb = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(bucket_size))).cast("int")
    b = F.pmod(F.xxhash64("userId"), nb.cast("long")).cast("int")
    dd = d.join(users, "userId").join(items, "itemId").select("itemId", nb.alias("nb"), b.alias("b"), "w", entry.pack().alias("e"))
    lists = dd.groupBy("itemId", "nb", "b", "w").agg(F.sort_array(F.collect_list("e")).alias("es"))
    later = F.filter("vs", lambda x: x > F.col("u"))

    one = lists.where("nb = 1")
    if both:
        rows = one.select(F.explode("es").alias("u"), "w", F.col("es").alias("vs"))
    else:
        rows = one.select(F.posexplode("es").alias("at", "u"), "w", "es").select("u", "w", F.expr("slice(es, at + 2, size(es))").alias("vs"))
    if facts[1] > bucket_size:
        cut = lists.where("nb > 1")
        left = cut.select("itemId", "w", F.col("b").alias("bl"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("br"), "es")
        right = cut.select("itemId", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bl"), F.col("b").alias("br"), F.col("es").alias("vs"))
        # a joined row makes bucket_size^2 pairs: an explicit count keeps AQE from joining partitions up by their bytes
        n_parts = max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(facts[2] / PAIRS_PER_TASK))
        keys = ["itemId", "bl", "br"]
        cross = left.repartition(n_parts, *keys).join(right.repartition(n_parts, *keys), keys).select(F.explode("es").alias("u"), "w", "vs")
        rows = rows.unionByName(cross if both else cross.select("u", "w", later.alias("vs")))
    if not both:
        rows = rows.where(F.size("vs") > 0)
    n_parts = max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(facts[2] / (1 if both else 2) / PAIRS_PER_TASK))
    pairs = rows.repartition(n_parts, "u").select("u", F.explode("vs").alias("v"), "w")
    if both:
        pairs = pairs.where(F.col("u") != F.col("v"))
    return pairs.groupBy("u", "v").agg(F.sum("w").alias("co")), entry


def _sets(d: DataFrame, items: DataFrame) -> DataFrame:
    """(userId, items, ws): items of ``items`` and their weights, per user that has any."""
    one = d.join(items.select("itemId", "w"), "itemId").groupBy("userId").agg(F.collect_list(F.struct("itemId", "w")).alias("s"))
    return one.select("userId", F.col("s.itemId").alias("items"), F.col("s.w").alias("ws"))


def _gridded(d: DataFrame, items: DataFrame, users: DataFrame, k: int | None, hot: DataFrame | None = None) -> DataFrame:
    """(userId, otherId, co, n, m) of all pairs with a common item of ``items``, both directions, or the best k of each
    user at least; ``hot``: further items that count in the sums of such pairs."""
    sets = users.select("userId", "n").join(_sets(d, items), "userId")
    if hot is not None:
        more = _sets(d, hot).select("userId", F.col("items").alias("more"), F.col("ws").alias("more_ws"))
        sets = sets.join(more, "userId", "left")
    sets = sets.checkpoint(eager=True)
    others = sets.withColumnsRenamed({"userId": "otherId", "n": "m"}).drop("ws", "more_ws")
    return match_sets(sets, others, "userId", k, same=True)


def _sizes(d: DataFrame) -> DataFrame:
    return d.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))


def _sim(method: str) -> Column:
    return cosine_norm(F.col("co").cast("double") / F.lit(float(_units(method))), "n", "m")


def _best_first(size: str = "m") -> list[Column]:
    return [F.desc(F.col("co").cast("double") / F.sqrt(F.col(size).cast("double"))), F.asc("otherId")]


def pair_cocounts(inter: DataFrame, method: str = "cosine", bucket_size: int = DEFAULT_BUCKET,
                  distinct: bool = False) -> DataFrame:
    """(u, v, nu, nv, co) for u < v with at least one common item.

    ``co`` is the number of common items ('cosine') or the IIF-weighted sum.
    ``distinct=True`` says ``inter`` already is materialized distinct pairs.
    """
    d = inter if distinct else materialized_interactions(inter)
    co = (F.col("co").cast("double") / F.lit(float(_units(method)))).alias("co")
    items, users = _item_weights(d, method), _sizes(d)
    facts = _facts(items)
    if _by_grid(d, users.count(), facts):
        pc = _gridded(d, items, users, None).where(F.col("userId") < F.col("otherId"))
        return pc.select(F.col("userId").alias("u"), F.col("otherId").alias("v"), F.col("n").alias("nu"), F.col("m").alias("nv"), co)
    pc, e = _listed(d, items, facts, bucket_size, users, both=False)
    return pc.select(e.user("u").alias("u"), e.user("v").alias("v"), e.size("u").alias("nu"), e.size("v").alias("nv"), co)


def _read(pairs: DataFrame, e: _Entry) -> DataFrame:
    return pairs.select(e.user("u").alias("userId"), e.user("v").alias("otherId"), "co", e.size("u").alias("n"), e.size("v").alias("m"))


def user_similarity(inter: DataFrame, method: str = "cosine", bucket_size: int = DEFAULT_BUCKET,
                    distinct: bool = False) -> DataFrame:
    """(userId, otherId, sim) in both directions."""
    d = inter if distinct else materialized_interactions(inter)
    items, users = _item_weights(d, method), _sizes(d)
    facts = _facts(items)
    if _by_grid(d, users.count(), facts):
        pc = _gridded(d, items, users, None)
        return pc.select("userId", "otherId", _sim(method).alias("sim"))
    # each pair is made once, from half the lists, and turned round where it is
    pc = _read(*_listed(d, items, facts, bucket_size, users, both=False)).select("userId", "otherId", _sim(method).alias("sim"))
    ends = F.array(F.struct("userId", "otherId"), F.struct(F.col("otherId").alias("userId"), F.col("userId").alias("otherId")))
    return pc.select("sim", F.explode(ends).alias("p")).select("p.userId", "p.otherId", "sim")


def _nearest(d: DataFrame, items: DataFrame, facts: tuple[int, int, int], users: DataFrame, k: int, bucket_size: int) -> DataFrame:
    """(userId, otherId, co, n, m) holding the best k of every user."""
    if _by_grid(d, users.count(), facts):
        return _gridded(d, items, users, k)
    pairs, e = _listed(d, items, facts, bucket_size, users, both=True)
    # ranked where the pairs are: the rows are dealt by u, and a packed v sorts like its id
    best = F.desc(F.col("co").cast("double") / F.sqrt(e.size("v").cast("double")))
    return _read(top_k(pairs, "u", [best, F.asc("v")], k), e)


def nearest_users(inter: DataFrame, k: int, method: str = "cosine",
                  bucket_size: int = DEFAULT_BUCKET, distinct: bool = False,
                  hot_threshold: int | None = HOT_USERS) -> DataFrame:
    """(userId, otherId, sim, rank): the k most similar users, ties by smaller id.

    Users with the same set of hot items (more than ``hot_threshold`` users; None: no
    item is hot) form a class.  A pair's sum is its sum over other items plus the
    shared hot weight of its two classes.

    * Pairs with a common other item come from the bucketed join over those items and
      look the hot weight of their classes up.
    * For pairs that share hot items only, a user's candidates depend on its class
      alone: within a class with the same shared weight, fewer items and then the
      smaller id come first, so the first k + 1 members of each class, and of all
      those the best k + 1 for each class, hold the best k of every user (one of them
      may be the user).  Each user is joined to the k + 1 rows of its class.

    The shared weights of classes come from lists or a grid like those of users, so they
    are never more work than the user pairs, and any number of hot items and classes is
    allowed.  The rows are the same for every threshold."""
    d = inter if distinct else materialized_interactions(inter)
    items = _item_weights(d, method)
    facts = _facts(items)
    if hot_threshold is None or facts[1] <= hot_threshold:
        near = _nearest(d, items, facts, _sizes(d), k, bucket_size)
    else:
        near = _near_by_class(d, items, k, bucket_size, hot_threshold)
    return top_k(near, "userId", _best_first(), k).select("userId", "otherId", _sim(method).alias("sim"), "rank")


def _near_by_class(d: DataFrame, items: DataFrame, k: int, bucket_size: int, hot_threshold: int) -> DataFrame:
    """(userId, otherId, co, n, m) holding the best k of every user; see nearest_users."""
    hot, rest = items.where(F.col("size") > hot_threshold), items.where(F.col("size") <= hot_threshold)
    dh = d.join(hot.select("itemId", "w"), "itemId")
    # a class is named by the count and two 64-bit hash sums of its items: no list is gathered
    cls = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("itemId")),
                      F.bit_xor(F.xxhash64(F.lit("class"), "itemId")))
    users = _sizes(d).join(dh.groupBy("userId").agg(cls.alias("cls")), "userId", "left").checkpoint(eager=True)
    members = users.where(F.col("cls").isNotNull())
    speakers = members.groupBy("cls").agg(F.min("userId").alias("userId"))
    dc = dh.join(speakers, "userId").select(F.col("cls").alias("userId"), "itemId", "w").checkpoint(eager=True)
    class_items = dc.groupBy("itemId").agg(F.count(F.lit(1)).alias("size"), F.max("w").alias("w"))
    class_facts, rest_facts, classes = _facts(class_items), _facts(rest), _sizes(dc)
    class_grid, rest_grid = _by_grid(dc, classes.count(), class_facts), _by_grid(d, users.count(), rest_facts)
    shared = None
    if not class_grid or rest_facts[0] and not rest_grid:
        dcp = dc.select("userId", "itemId")
        pc = (_gridded(dcp, class_items, classes, None) if class_grid
              else _read(*_listed(dcp, class_items, class_facts, bucket_size, classes, both=True)))
        own = dc.groupBy(F.col("userId").alias("cls"), F.col("userId").alias("other")).agg(F.sum("w").alias("shared"))
        shared = (pc.select(F.col("userId").alias("cls"), F.col("otherId").alias("other"), F.col("co").alias("shared"))
                  .unionByName(own).checkpoint(eager=True))

    firsts = top_k(members, "cls", [F.asc("n"), F.asc("userId")], k + 1, "_r").select(
        F.col("cls").alias("other"), F.col("userId").alias("otherId"), F.col("n").alias("m"))
    if class_grid:
        sets = _sets(dc.select("userId", "itemId"), class_items).withColumnRenamed("userId", "cls").checkpoint(eager=True)
        others = firsts.join(sets.select(F.col("cls").alias("other"), "items"), "other").select("otherId", "m", "items")
        cand = match_sets(sets.withColumn("n", F.lit(0).cast("long")), others, "cls", k + 1, same=False).drop("n")
    else:
        cand = shared.join(firsts, "other").select("cls", "otherId", "m", F.col("shared").alias("co"))
    cand = top_k(cand, "cls", _best_first(), k + 1, "_r").drop("_r")
    by_class = (members.join(cand, "cls").where(F.col("userId") != F.col("otherId"))
                .select("userId", "otherId", "co", "n", "m"))
    if not rest_facts[0]:
        return by_class

    if rest_grid:
        near = _gridded(d, rest, users, k, hot)
    else:
        pairs, e = _listed(d, rest, rest_facts, bucket_size, users, both=True)
        # a user without a class gets a key of its own, so such pairs stay spread out
        keyed = pairs.withColumn("cls", F.coalesce(F.col("u.cls"), F.concat(F.lit("-"), F.col("u.userId").cast("string"))))
        keyed = keyed.withColumn("other", F.coalesce(F.col("v.cls"), F.concat(F.lit("-"), F.col("v.userId").cast("string"))))
        keyed = keyed.join(shared, ["cls", "other"], "left").withColumn(
            "co", F.col("co") + F.coalesce(F.col("shared"), F.lit(0)))
        near = top_k(_read(keyed, e), "userId", _best_first(), k, "_r").drop("_r")
    # a pair found both ways: the sum over all its items is the larger one
    return (near.select(*by_class.columns).unionByName(by_class).groupBy("userId", "otherId", "n", "m").agg(F.max("co").alias("co")))


def similar_users(inter: DataFrame, n: int = 10, method: str = "cosine",
                  bucket_size: int = DEFAULT_BUCKET, sep: str = ";",
                  hot_threshold: int | None = HOT_USERS) -> DataFrame:
    """(userId, similarUsers): best-first list of up to n users; a user with no
    neighbour keeps a row with an empty list (C2)."""
    d = materialized_interactions(inter)
    top = nearest_users(d, n, method, bucket_size, distinct=True, hot_threshold=hot_threshold)
    lists = long_to_wide(top, "userId", "otherId", ["rank"], sep=sep, out_col="similarUsers")
    users = d.select("userId").distinct()
    return (users.join(lists, "userId", "left")
            .select("userId", F.coalesce(F.col("similarUsers"), F.lit("")).alias("similarUsers")))


def usercf_recommend(inter: DataFrame, n: int = 5, k: int = 10, method: str = "cosine",
                     bucket_size: int = DEFAULT_BUCKET, hot_threshold: int | None = HOT_USERS) -> DataFrame:
    """(userId, itemId, score, rank): sum of the similarities of the k nearest
    neighbours over items the user has not seen, top n, ties by smaller item id
    (C3).  Similarities are summed in units of 1 / SCORE_UNITS, so the sum does
    not depend on its order.  Users unknown to the interactions get no rows."""
    d = materialized_interactions(inter)
    units = F.floor(F.col("sim") * F.lit(float(SCORE_UNITS)) + F.lit(0.5)).cast("long")
    nbrs = nearest_users(d, k, method, bucket_size, distinct=True,
                         hot_threshold=hot_threshold).select("userId", "otherId", units.alias("units"))
    lists = _item_lists(d)
    given = nbrs.join(lists.withColumnRenamed("userId", "otherId"), "otherId").select("userId", "units", "items")
    own = lists.select("userId", F.lit(None).cast("long").alias("units"), "items")
    # whole lists are dealt by user, and summed and ranked where they arrive; an own list marks what is seen
    n_parts = max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(d.count() * (k + 1) / PAIRS_PER_TASK))
    rows = given.unionByName(own).repartition(n_parts, "userId").select("userId", "units", F.explode("items").alias("itemId"))
    scored = rows.groupBy("userId", "itemId").agg(F.sum("units").alias("units"), F.max(F.col("units").isNull()).alias("seen"))
    scored = scored.where(~F.col("seen")).drop("seen")
    top = top_k(scored, "userId", [F.desc("units"), F.asc("itemId")], n)
    return top.select("userId", "itemId", F.round(F.col("units") / F.lit(float(SCORE_UNITS)), 6).alias("score"), "rank")


def _item_lists(d: DataFrame) -> DataFrame:
    """(userId, items): the items of each user, in several rows of about LIST_ITEMS if there are more."""
    users = _sizes(d)
    if (users.agg(F.max("n").alias("n")).first()["n"] or 0) <= LIST_ITEMS:
        return d.groupBy("userId").agg(F.collect_list("itemId").alias("items"))
    part = F.pmod(F.xxhash64("itemId"), F.ceil(F.col("n") / F.lit(LIST_ITEMS)))
    return (d.join(users, "userId").groupBy("userId", part.alias("_part")).agg(F.collect_list("itemId").alias("items"))
            .select("userId", "items"))
