"""The operators as queries over the test tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import (dual_tree, extendible, hyperminhash, lang_zstd, pii_transducer, prefix_bpe, quality_llr, raking, site_bayes, source_audit,
                         token_frames, url_gbt, vector_join)

#: (verdict, host/path) of the URL filter.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.cosine_links(table(spark, sf_dir, "embeddings"), 0.95)


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                   public_tokenizers.PATTERN, columns=["doc_id"], with_ids=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lang_zstd.identify(docs, lang_zstd.learn(docs), columns=["doc_id"])
    return out.select("doc_id", F.coalesce(lang_zstd.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_result.*")


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, doc_id): a page shows the document whose number ends its path."""
    return table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"/(\d+)[^/?#]*/?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad): bad if the document of the page is labelled toxic or of low quality."""
    pages = page_documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op7_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), URL_RULES)


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")  # host, and the first part of the path, of the page that shows the document
    places = page_documents(spark, sf_dir).where("doc_id IS NOT NULL").select(
        "doc_id", F.nullif(url_gbt.host_of(url), F.lit("")).alias("site"), F.regexp_extract(url_gbt.path_of(url), "^/?([^/]*)", 1).alias("path"))
    out = site_bayes.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"], places=places)
    r = F.col("quality_result")
    return out.select("doc_id", *[F.round(r[c], 9).alias(c) for c in ("doc_prob", "site_prob", "path_prob", "prob")], r["kept"].alias("kept"))


def topic() -> Column:
    """A coarse topic from marks in the text."""
    t = F.col("text")
    return (F.when(t.contains(" | "), "table").when(t.contains("***") | t.contains("$$$"), "marks")
            .when(t.contains("rights reserved") | t.contains("licensed"), "legal")
            .when(t.contains("@") | t.contains("://"), "contact").otherwise("prose"))


def mix_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic()}


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixed(table(spark, sf_dir, "documents"), mix_dims()).select("doc_id", "mix.*")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible.assign_shards(docs).select("doc_id", "shard.*")


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_transducer.pii_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii_transducer.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_transducer.digest(base), 256).alias("base_sha256"),
                        pii_transducer.digest(F.col("pii")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_token_frames, op2_vector_join, op3_hyperminhash, op4_quality_rules, op5_prefix_bpe,
                                   op6_language, op7_url_gbt, op8_site_bayes, op9_raking, op10_sharding,
                                   op11_dual_tree, op12_source_audit, op13_pii_transducer)}

# ---- DuckDB SQL --------------------------------------------------------------

#: Components by the smallest label that a node's links carry to it, from (node) and (a, b) in both directions.
_REACH = """reach(id, m) AS (SELECT id, id FROM node UNION SELECT link.b, reach.m FROM reach JOIN link ON link.a = reach.id WHERE reach.m < link.b),
low AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)"""

_OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.id AS a, y.id AS b FROM good x, good y WHERE x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
node AS (SELECT id FROM v),
{_REACH}
SELECT low.id AS vec_id, (SELECT count(*) FROM link WHERE link.a = low.id) AS n_links, component_id, low.id = component_id AS kept FROM low"""

_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN []
  WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w)),
n AS (SELECT w.id, coalesce(c, 0) AS n FROM w LEFT JOIN (SELECT id, count(*) AS c FROM sh GROUP BY id) USING (id)),
pair AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
node AS (SELECT id FROM w),
{_REACH}
SELECT low.id AS doc_id, n.n AS n_shingles, component_id, low.id = component_id AS kept FROM low JOIN n ON n.id = low.id"""


def _op9_sql(sweeps: int = raking.SWEEPS, temperature: float = raking.TEMPERATURE) -> str:
    dims = ("source", "lang", "topic")
    sql = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang, '=' || CASE
  WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '***') OR contains(text, '$$$') THEN 'marks'
  WHEN contains(text, 'rights reserved') OR contains(text, 'licensed') THEN 'legal'
  WHEN contains(text, '@') OR contains(text, '://') THEN 'contact' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS n FROM documents),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens, 1.0::DOUBLE AS factor FROM d GROUP BY ALL)"""
    for x in dims:
        sql += f""",
t_{x} AS MATERIALIZED (SELECT {x}, pow(t, {temperature}) / sum(pow(t, {temperature})) OVER () AS share FROM (SELECT {x}, sum(tokens) AS t FROM c0 GROUP BY {x}) WHERE t > 0)"""
    k = 0
    for _ in range(sweeps):
        for x in dims:
            sql += f""",
c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, factor * coalesce(share * (SELECT sum(tokens) FROM c0) / nullif(now, 0), 1) AS factor
  FROM c{k} c LEFT JOIN (SELECT {x}, sum(tokens * factor) AS now FROM c{k} GROUP BY {x}) s ON s.{x} = c.{x} LEFT JOIN t_{x} t ON t.{x} = c.{x})"""
            k += 1
    return sql + f""",
p AS (SELECT source, lang, topic, factor, round(least(factor / (SELECT max(factor) FROM c{k} WHERE tokens > 0), 1), 9) AS keep_prob FROM c{k})
SELECT doc_id, n AS n_tokens, round(factor, 6) AS weight, keep_prob,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < keep_prob AS sampled
FROM d JOIN p USING (source, lang, topic)"""


_OP10 = f"""WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS h,
  coalesce(octet_length(encode(text)), 0) AS n FROM documents),
node AS (SELECT d, h >> (60 - d) AS p, sum(n) AS b, min(h) < max(h) AND sum(n) > {extendible.SHARD_BYTES} AS is_full FROM d, range(0, 61) r(d) GROUP BY ALL),
leaf AS (SELECT doc_id, h, n, (SELECT count(*) FROM node WHERE is_full AND node.p = x.h >> (60 - node.d)) AS depth FROM d x)
SELECT doc_id, substr(printf('%060b', h), 1, depth::INT) AS shard_id, depth::INT AS depth, n AS n_bytes, b::BIGINT AS shard_bytes, b > {extendible.SHARD_BYTES} AS oversized
FROM leaf JOIN node ON node.d = leaf.depth AND node.p = leaf.h >> (60 - leaf.depth)"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_OP11 = f"""WITH d AS (SELECT doc_id, {_TERMS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")} AS t FROM documents),
corpus AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t, nd),
g AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)) AS g FROM tf, corpus),
s AS (SELECT item_id, doc_id, sum(c * w * g)::BIGINT AS score FROM q JOIN w USING (t) JOIN g USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

_OP12 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS t FROM documents),
u AS (SELECT doc_id, lang, source, unnest(t) AS t FROM d),
k AS (SELECT lang, t, count(*) AS n FROM u GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.t, k.n AS all_n, coalesce(x.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, t, count(*) AS n FROM u GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.t = k.t),
p AS (SELECT lang, source, t, n, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p,
  (1 + (1000000000 * (all_n + 1)) // (sum(all_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS q FROM c),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
v AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pair LEFT JOIN v USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', t, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200"""

ORACLES = {"op2_vector_join": _OP2, "op3_hyperminhash": _OP3, "op9_raking": _op9_sql(), "op10_sharding": _OP10, "op11_dual_tree": _OP11, "op12_source_audit": _OP12}
