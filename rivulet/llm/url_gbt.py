"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are built-in expressions over the URL alone: length, depth, digit
ratio, entropy, parameters, host shape, and the rate of bad labels under its
suffix (the last two host labels), shrunk toward the overall rate and without
the row's own label when trained on.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import staged

#: Labelled URLs that the trees are trained on, at most.
LABEL_LIMIT = 20_000
SUFFIX_PRIOR = 20.0
TREES, DEPTH = 12, 3
#: Labelled URLs in a leaf, at least.
LEAF = 10
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_length", "host_labels", "hyphens", "suffix_rate"]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits the host or a subdomain and begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # a longer rule overrides
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``urls`` with the lexical features and ``suffix``; a null URL has the features of an empty one."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    share = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return urls.withColumns({
        "length": F.length(u).cast("double"),
        "depth": F.regexp_count(F.col(path), F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "entropy": F.round(entropy, 9),
        "params": F.when(u.contains("?"), F.regexp_count(u, F.lit("[?&][^&#=]+="))).otherwise(0).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": F.regexp_count(F.col(host), F.lit("[^.]+")).cast("double"),
        "hyphens": F.regexp_count(F.col(host), F.lit("-")).cast("double"),
        "suffix": F.substring_index(F.col(host), ".", -2),
    })


def train(labelled: DataFrame, limit: int = LABEL_LIMIT):
    """(model, suffix table) from labelled URLs (url, bad); None without labels of both kinds.

    At most ``limit`` distinct URLs, those with the smallest hashes; a URL with
    several labels is bad if one of them is.
    """
    one = (labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
           .orderBy(F.xxhash64("url"), "url").limit(limit))
    one = one.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = staged(lexical(one, "url", "host", "path"), "url_labels")
    suffix = staged(rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")), "url_suffixes")
    t = suffix.agg(F.sum("n"), F.sum("b")).first()
    if not t[0] or t[1] in (0, t[0]):
        return None
    rate = t[1] / t[0]
    table = suffix.withColumn("rate", F.lit(rate))
    seen = rows.join(table, "suffix").withColumn(
        "suffix_rate", (F.col("b") - F.col("bad") + SUFFIX_PRIOR * rate) / (F.col("n") - 1 + SUFFIX_PRIOR))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen.withColumn("label", F.col("bad").cast("double")))
    ready = staged(ready.select("url", "features", "label"), "url_features").repartition(4, "url").sortWithinPartitions("url")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, stepSize=0.2, seed=7, cacheNodeIds=False).fit(ready)
    return model, table


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          threshold: float = 0.5, limit: int = LABEL_LIMIT) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, bad_prob.

    The longest rule that fits decides; else the trees: ``block`` from
    ``threshold`` on.  A null URL, or one without ``://``, has an empty host and
    path and fits no rule; ids are passed on as they are.  Without labels of
    both kinds the method allows everything (bad_prob 0).  Other columns are not read.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    got = train(labelled, limit)
    if got is None:
        scored = base.withColumn("bad_prob", F.lit(0.0))
    else:
        model, table = got
        scored = lexical(base, "url", "host", "path").join(table, "suffix", "left").withColumn(
            "suffix_rate", (F.coalesce("b", F.lit(0)) + SUFFIX_PRIOR * F.coalesce("rate", F.lit(0.0))) /
            (F.coalesce("n", F.lit(0)) + SUFFIX_PRIOR))
        prior = table.agg(F.max("rate")).first()[0]
        scored = scored.withColumn("suffix_rate", F.when(F.col("n").isNull(), F.lit(prior)).otherwise(F.col("suffix_rate")))
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scored))
        scored = scored.withColumn("bad_prob", vector_to_array("probability")[1])
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("bad_prob") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, by_model).alias("verdict"), "bad_prob")
