"""DuckDB SQL oracles, one per checkable query.

Each statement re-derives the stand-in data from the raw test tables with its
own SQL, independently of the Spark code, and computes the same result.
"""

from __future__ import annotations

WS = r"[ \t\n\r\f\x0B]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


FX_INTER = """fx_inter AS (
  SELECT DISTINCT o_custkey AS userId, l_partkey AS itemId
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FX_EVENTS = """fx_events AS (
  SELECT DISTINCT user_id AS userId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemId
  FROM events)"""

FX_META = """fx_meta AS (
  SELECT p_partkey AS itemId,
         CASE WHEN p_size <= 24 THEN 0 WHEN p_size <= 48 THEN 1 ELSE 2 END AS cluster,
         CAST(COALESCE(w, 0) AS BIGINT) AS watch
  FROM part LEFT JOIN (SELECT l_partkey, CAST(trunc(SUM(l_quantity)) AS BIGINT) AS w
                       FROM lineitem GROUP BY l_partkey) q ON l_partkey = p_partkey)"""

FX_RECS = FX_INTER + """,
fx_recs AS (
  SELECT userId, itemId,
         CAST(ROW_NUMBER() OVER (PARTITION BY userId ORDER BY md5(CAST(userId AS VARCHAR) || ':' || CAST(itemId AS VARCHAR))) - 1 AS INTEGER) AS pos
  FROM fx_inter)"""

WIDE = """wl_lines AS (
  SELECT o_custkey AS userId, l_orderkey, l_linenumber,
         CASE WHEN l_linenumber % 3 = 0 THEN ' ' || CAST(l_partkey AS VARCHAR) || chr(9)
              WHEN l_linenumber = 5 THEN ''
              ELSE CAST(l_partkey AS VARCHAR) END AS tok
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
wide AS (
  SELECT userId, CASE WHEN userId % 4 = 0 THEN s || ';' ELSE s END AS itemId
  FROM (SELECT userId, string_agg(tok, ';' ORDER BY l_orderkey, l_linenumber, tok) AS s
        FROM wl_lines GROUP BY userId) g)"""

WIDE_TOKENS = WIDE + """,
wtok AS (
  SELECT userId, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS tok
  FROM (SELECT userId, string_split(itemId, ';') AS t FROM wide) s)"""


def sims_cte(src: str, method: str) -> str:
    """CTE 'sims' (userId, otherId, sim unrounded, ord, both directions) over 'src'.

    Weights are whole numbers (IIF in units of 1e-12); the neighbours of a user are
    ordered by ord = sum / sqrt(items of the other), i.e. by sim, ties by id."""
    w, units = ("1", "1.0") if method == "cosine" else ("CAST(floor(1e12 / ln(1 + a_n.n) + 0.5) AS BIGINT)", "1e12")
    return f"""nu AS (SELECT userId, COUNT(*) AS n FROM {src} GROUP BY userId),
ni AS (SELECT itemId, COUNT(*) AS n FROM {src} GROUP BY itemId),
pc AS (
  SELECT a.userId AS u, b.userId AS v, CAST(SUM({w}) AS DOUBLE) AS co
  FROM {src} a JOIN {src} b ON a.itemId = b.itemId AND a.userId <> b.userId
  JOIN ni a_n ON a_n.itemId = a.itemId
  GROUP BY 1, 2),
sims AS (
  SELECT u AS userId, v AS otherId, co / CAST({units} AS DOUBLE) / sqrt(CAST(n1.n * n2.n AS DOUBLE)) AS sim,
         co / sqrt(CAST(n2.n AS DOUBLE)) AS ord
  FROM pc JOIN nu n1 ON n1.userId = u JOIN nu n2 ON n2.userId = v)"""


def similar_users_sql(src_cte: str, src: str, method: str, n: int) -> str:
    return f"""WITH {src_cte},
{sims_cte(src, method)},
ranked AS (
  SELECT userId, otherId,
         ROW_NUMBER() OVER (PARTITION BY userId ORDER BY ord DESC, otherId) AS rk
  FROM sims),
lists AS (
  SELECT userId, string_agg(CAST(otherId AS VARCHAR), ';' ORDER BY rk) AS similarUsers
  FROM ranked WHERE rk <= {n} GROUP BY userId)
SELECT u.userId, COALESCE(l.similarUsers, '') AS similarUsers
FROM (SELECT DISTINCT userId FROM {src}) u LEFT JOIN lists l ON l.userId = u.userId"""


def usercf_sql(src: str, n: int, k: int) -> str:
    return f"""{sims_cte(src, 'cosine')},
nbrs AS (
  SELECT userId, otherId, sim FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY ord DESC, otherId) AS rk
    FROM sims) r WHERE rk <= {k}),
cand AS (SELECT n.userId, i.itemId, n.sim FROM nbrs n JOIN {src} i ON i.userId = n.otherId),
unseen AS (
  SELECT * FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM {src} s WHERE s.userId = c.userId AND s.itemId = c.itemId)),
sc AS (SELECT userId, itemId, SUM(CAST(floor(sim * 1e15 + 0.5) AS BIGINT)) AS units FROM unseen GROUP BY 1, 2),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY units DESC, itemId) AS rank FROM sc)
SELECT userId, itemId, round(CAST(units AS DOUBLE) / 1e15, 6) AS score, rank FROM rk WHERE rank <= {n}"""


ORACLES: dict[str, str] = {}

ORACLES["wide_to_long"] = f"""WITH {WIDE_TOKENS}
SELECT userId, pos, {strip_sql('tok')} AS itemId FROM wtok WHERE {strip_sql('tok')} <> ''"""

ORACLES["wide_to_long_keep_blank"] = f"""WITH {WIDE_TOKENS}
SELECT userId, pos, {strip_sql('tok')} AS itemId FROM wtok"""

ORACLES["long_to_wide"] = f"""WITH {FX_INTER}
SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY itemId) AS itemId
FROM fx_inter GROUP BY userId"""

ORACLES["numeric_token_list"] = f"""WITH {WIDE},
noisy AS (
  SELECT userId, 'x1;' || itemId || '; 12a ;-3;' || CAST(userId % 10 AS VARCHAR) AS s FROM wide),
arr AS (
  SELECT userId,
         list_transform(
           list_filter(list_transform(string_split(s, ';'), lambda x: {strip_sql('x')}),
                       lambda x: regexp_full_match(x, '[0-9]+')),
           lambda x: TRY_CAST(x AS BIGINT)) AS a
  FROM noisy)
SELECT userId, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS itemId FROM arr"""

ORACLES["item_popularity"] = f"""WITH {FX_INTER}
SELECT itemId, COUNT(DISTINCT userId) AS user_count FROM fx_inter
WHERE itemId IS NOT NULL GROUP BY itemId"""

ORACLES["item_popularity_lists"] = f"""WITH {WIDE_TOKENS}
SELECT {strip_sql('tok')} AS itemId, COUNT(DISTINCT userId) AS user_count
FROM wtok GROUP BY 1"""

ORACLES["user_item_sets"] = f"""WITH {FX_INTER}
SELECT userId, string_agg(CAST(itemId AS VARCHAR), ';' ORDER BY itemId) AS items, COUNT(*) AS n_items
FROM fx_inter GROUP BY userId"""

ORACLES["long_to_wide_parts"] = f"""WITH {FX_INTER},
r AS (SELECT userId, itemId,
             CAST((ROW_NUMBER() OVER (PARTITION BY userId ORDER BY itemId) - 1) // 16 AS INTEGER) AS part
      FROM fx_inter)
SELECT userId, part, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY itemId) AS itemId
FROM r GROUP BY userId, part"""

ORACLES["item_audience"] = f"""WITH {FX_INTER}
SELECT itemId, COUNT(*) AS n_users FROM fx_inter GROUP BY itemId"""

ORACLES["items_per_user"] = f"""WITH {FX_INTER}
SELECT userId, COUNT(*) AS n_items FROM fx_inter GROUP BY userId"""

ORACLES["pair_cocounts"] = f"""WITH {FX_INTER}
SELECT a.userId AS u, b.userId AS v, COUNT(*) AS co
FROM fx_inter a JOIN fx_inter b ON a.itemId = b.itemId AND a.userId < b.userId
GROUP BY 1, 2"""

ORACLES["pair_cocounts_small_buckets"] = ORACLES["pair_cocounts"]

ORACLES["user_similarity_cosine"] = f"""WITH {FX_INTER},
{sims_cte('fx_inter', 'cosine')}
SELECT userId, otherId, round(sim, 6) AS sim FROM sims"""

ORACLES["user_similarity_iif"] = f"""WITH {FX_EVENTS},
{sims_cte('fx_events', 'iif')}
SELECT userId, otherId, round(sim, 6) AS sim FROM sims"""

ORACLES["similar_users_wide"] = similar_users_sql(FX_INTER, "fx_inter", "cosine", 10)
ORACLES["similar_users_iif"] = similar_users_sql(FX_EVENTS, "fx_events", "iif", 10)
ORACLES["similar_users_hot_items"] = ORACLES["similar_users_iif"]
ORACLES["similar_users_text_ids"] = similar_users_sql(FX_EVENTS + """,
fx_text AS (SELECT 'u' || CAST(userId AS VARCHAR) AS userId, 'i' || CAST(itemId AS VARCHAR) AS itemId FROM fx_events)""",
                                                      "fx_text", "cosine", 10)
ORACLES["similar_users_heavy"] = similar_users_sql("""fx_heavy AS (
  SELECT DISTINCT 'u' || CAST(user_id % 50 AS VARCHAR) AS userId, 'e' || CAST(event_id AS VARCHAR) AS itemId FROM events
  UNION ALL SELECT DISTINCT 'u' || CAST(user_id % 50 AS VARCHAR), 'all' FROM events
  UNION ALL SELECT DISTINCT 'u' || CAST(user_id % 50 AS VARCHAR), 'third' FROM events WHERE user_id % 50 % 3 = 0)""",
                                                   "fx_heavy", "cosine", 3)
ORACLES["usercf_text_ids"] = f"""WITH {FX_EVENTS},
fx_text AS (SELECT 'u' || CAST(userId AS VARCHAR) AS userId, 'i' || CAST(itemId AS VARCHAR) AS itemId FROM fx_events),
{usercf_sql('fx_text', 5, 3)}"""

ORACLES["usercf_recommend"] = f"WITH {FX_INTER},\n{usercf_sql('fx_inter', 5, 10)}"

FACTORS = """uf AS (
  SELECT vec_id AS userId, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS DOUBLE) / 20.0 AS bu
  FROM embeddings WHERE vec_id % 2 = 0),
itf AS (
  SELECT vec_id AS itemId, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS DOUBLE) / 10.0 AS bi
  FROM embeddings WHERE vec_id % 2 = 1),
seen AS (
  SELECT DISTINCT c.userId, c.itemId FROM (
    SELECT userId, userId + 2 * j + 1 AS itemId
    FROM (SELECT vec_id AS userId, unnest(range(0, label + 1)) AS j
          FROM embeddings WHERE vec_id % 2 = 0) x) c
  WHERE c.itemId IN (SELECT itemId FROM itf)),
sc AS (
  SELECT u.userId, i.itemId, list_dot_product(u.f, i.f) + u.bu + i.bi AS raw
  FROM uf u CROSS JOIN itf i),
unseen AS (
  SELECT * FROM sc
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.userId = sc.userId AND s.itemId = sc.itemId)),
mm AS (SELECT userId, MIN(raw) AS mn, MAX(raw) AS mx FROM unseen GROUP BY userId),
ranked AS (
  SELECT u.userId, u.itemId,
         (raw - mn) / CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END AS score,
         ROW_NUMBER() OVER (PARTITION BY u.userId ORDER BY round(raw, 9) DESC, u.itemId) AS rank
  FROM unseen u JOIN mm ON mm.userId = u.userId)"""

ORACLES["factor_recommend"] = f"""WITH {FACTORS}
SELECT userId, itemId, round(score, 4) AS score, rank FROM ranked WHERE rank <= 5"""

ORACLES["factor_recommend_sliced"] = ORACLES["factor_recommend"]

ORACLES["factor_recommend_one_user"] = f"""WITH {FACTORS}
SELECT userId, itemId, round(score, 4) AS score, rank FROM ranked WHERE rank <= 5 AND userId = 2"""

ORACLES["factor_recommend_unknown_user"] = f"""WITH {FACTORS}
SELECT userId, itemId, round(score, 4) AS score, rank FROM ranked WHERE rank <= 5 AND userId = -1"""

ORACLES["retrieval_wide"] = f"""WITH {FACTORS}
SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY rank) AS itemId
FROM ranked WHERE rank <= 100 GROUP BY userId"""

ORACLES["als_recommend_facts"] = f"""WITH {FX_INTER}
SELECT COUNT(DISTINCT userId) AS users, 5 * COUNT(DISTINCT userId) AS n_rows, CAST(0 AS BIGINT) AS seen_rows,
       CAST(0 AS BIGINT) AS bad_scores, CAST(0 AS BIGINT) AS bad_firsts
FROM fx_inter"""

ORACLES["kmeans_users_facts"] = """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT c_custkey) AS n_ids,
       COUNT(c_custkey) AS labelled, TRUE AS parted, CAST(0 AS BIGINT) AS n_off FROM customer"""

ORACLES["kmeans_items_facts"] = """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT p_partkey) AS n_ids,
       COUNT(p_partkey) AS labelled, TRUE AS parted, CAST(0 AS BIGINT) AS n_off FROM part"""

ORACLES["item_popularity_approx_facts"] = f"""WITH {FX_INTER}
SELECT COUNT(DISTINCT itemId) AS items, CAST(0 AS BIGINT) AS off FROM fx_inter"""

ORACLES["batch_facts"] = f"""WITH {FX_INTER},
a AS (SELECT COUNT(DISTINCT userId) AS u, COUNT(DISTINCT itemId) AS i FROM fx_inter),
unseen AS (SELECT userId, (SELECT i FROM a) - COUNT(*) AS n FROM fx_inter GROUP BY userId)
SELECT 'F3' AS output, u AS rows, CAST(NULL AS BIGINT) AS total, 'userId,similarUsers' AS columns FROM a
UNION ALL SELECT 'F4', CAST(SUM(least(n, 5)) AS BIGINT), NULL, 'userId,itemId,score' FROM unseen
UNION ALL SELECT 'Retrieval', COUNT(*), NULL, 'userId,itemId' FROM unseen WHERE n > 0
UNION ALL SELECT 'F5', NULL, CAST(SUM(least(n, 100)) AS BIGINT), 'itemId,user_count' FROM unseen
UNION ALL SELECT 'F6', COUNT(*), NULL, 'itemId,length,comment,like,watch,share,name,userId,category,cluster' FROM part
UNION ALL SELECT 'F7', COUNT(*), NULL, 'userId,itemId,name,gender,following,age,fans,cluster' FROM customer
UNION ALL SELECT 'Filtered_Recommendations', COUNT(*), NULL, 'userId,itemId' FROM unseen WHERE n > 0"""

ORACLES["factor_loss"] = f"""WITH {FACTORS},
cells AS (
  SELECT sc.raw AS p, CASE WHEN s.userId IS NULL THEN 0.0 ELSE 1.0 END AS y
  FROM sc LEFT JOIN seen s ON s.userId = sc.userId AND s.itemId = sc.itemId),
reg AS (
  SELECT (SELECT SUM(list_dot_product(f, f)) + SUM(bu * bu) FROM uf)
       + (SELECT SUM(list_dot_product(f, f)) + SUM(bi * bi) FROM itf) AS sq)
SELECT round(AVG((p - y) * (p - y)) + 0.01 * 0.5 * (SELECT sq FROM reg), 6) AS loss,
       round(AVG((p - y) * (p - y)), 6) AS mse
FROM cells"""

USERS = FX_INTER + """,
users AS (
  SELECT c_custkey AS userId, lst.itemId, c_name AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'M' WHEN 'MACHINERY' THEN 'M'
                           WHEN 'FURNITURE' THEN 'F' WHEN 'HOUSEHOLD' THEN 'F' END AS gender,
         CAST(COALESCE(o.n_orders, 0) AS BIGINT) AS following,
         CAST(14 + c_custkey % 47 AS INTEGER) AS age,
         CAST(trunc(abs(c_acctbal)) AS BIGINT) AS fans
  FROM customer
  LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY itemId) AS itemId
             FROM fx_inter GROUP BY userId) lst ON lst.userId = c_custkey)"""

ITEM_COUNTS = """icnt AS (
  SELECT l_partkey, COUNT(*) AS n_lines, COUNT(DISTINCT l_orderkey) AS n_orders,
         COUNT(DISTINCT l_suppkey) AS n_supp
  FROM lineitem GROUP BY l_partkey)"""

ITEMS = FX_INTER + ",\n" + FX_META + ",\n" + ITEM_COUNTS + """,
items AS (
  SELECT p_partkey AS itemId, CAST(p_size * 60 + p_partkey % 60 AS INTEGER) AS length,
         CAST(COALESCE(n_orders, 0) AS BIGINT) AS comment, CAST(COALESCE(n_lines, 0) AS BIGINT) AS "like",
         m.watch, CAST(COALESCE(n_supp, 0) AS BIGINT) AS share, p_name AS name, aud.userId, p_type AS category
  FROM part
  LEFT JOIN icnt ON l_partkey = p_partkey
  LEFT JOIN fx_meta m ON m.itemId = p_partkey
  LEFT JOIN (SELECT itemId, string_agg(CAST(userId AS VARCHAR), '; ' ORDER BY userId) AS userId
             FROM fx_inter GROUP BY itemId) aud ON aud.itemId = p_partkey)"""


def count_splits_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 0 ELSE "
            f"len(list_filter(string_split({x}, ';'), lambda t: {strip_sql('t')} <> '')) END")


ORACLES["user_features"] = f"""WITH {USERS}
SELECT userId, CAST(age AS DOUBLE) AS age, CAST(fans AS DOUBLE) AS fans,
       CAST(CASE gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS DOUBLE) AS gender_code,
       CAST({count_splits_sql('itemId')} AS DOUBLE) AS num_watched,
       CAST(following AS DOUBLE) AS num_follow
FROM users"""

ORACLES["item_features"] = f"""WITH {ITEMS}
SELECT itemId, CAST(length AS DOUBLE) AS length, CAST(comment AS DOUBLE) AS comment,
       CAST("like" AS DOUBLE) AS "like", CAST(watch AS DOUBLE) AS watch, CAST(share AS DOUBLE) AS share,
       CAST({count_splits_sql('userId')} AS DOUBLE) AS num_viewers
FROM items"""

ORACLES["count_splits"] = f"""WITH {WIDE}
SELECT userId, CAST({count_splits_sql('itemId')} AS BIGINT) AS n_tokens FROM wide"""

KASSIGN = """cen AS (SELECT vec_id AS cid, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id < 8),
pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (
  SELECT vec_id, cid, x,
         list_reduce(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])),
                     lambda a, b: a + b) AS dist
  FROM pts CROSS JOIN cen),
best AS (
  SELECT vec_id, CAST(cid AS INTEGER) AS cluster, dist, x FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS rk FROM d) r WHERE rk = 1)"""

ORACLES["kmeans_assign"] = f"""WITH {KASSIGN}
SELECT vec_id, cluster, round(dist, 6) AS dist FROM best"""

ORACLES["kmeans_step"] = f"""WITH {KASSIGN},
ex AS (SELECT cluster, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS dim, unnest(x) AS v FROM best),
n AS (SELECT cluster, COUNT(*) AS n FROM best GROUP BY cluster)
SELECT ex.cluster, dim, round(AVG(v), 6) AS value, n.n
FROM ex JOIN n ON n.cluster = ex.cluster GROUP BY ex.cluster, dim, n.n"""

RERANK = FX_RECS + ",\n" + FX_META + """,
known AS (
  SELECT r.userId, r.pos, r.itemId, m.cluster, m.watch
  FROM fx_recs r JOIN fx_meta m ON m.itemId = r.itemId),
k1 AS (
  SELECT *, CASE WHEN ROW_NUMBER() OVER w = 1 THEN 1
                 WHEN LAG(cluster) OVER w IS NOT DISTINCT FROM cluster THEN 0 ELSE 1 END AS chg
  FROM known WINDOW w AS (PARTITION BY userId ORDER BY pos)),
k2 AS (SELECT *, SUM(chg) OVER (PARTITION BY userId ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM k1),
k3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY userId, run ORDER BY pos) AS run_idx FROM k2),
surv AS (SELECT * FROM k3 WHERE run_idx <= 5),
slots AS (
  SELECT * FROM (
    SELECT userId, pos, itemId, cluster, watch,
           ROW_NUMBER() OVER (PARTITION BY userId ORDER BY pos) AS slot FROM surv) s
  WHERE slot <= 10),
stats AS (
  SELECT userId, COUNT(*) AS cnt, MAX(CASE WHEN watch < 500 THEN 1 ELSE 0 END) AS has_cold
  FROM slots GROUP BY userId),
maxw AS (
  SELECT userId, slot AS max_slot FROM (
    SELECT userId, slot, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY watch DESC, slot) AS rk FROM slots) x
  WHERE rk = 1),
cold_c AS (
  SELECT userId, itemId AS cc_item, cluster AS cc_cluster, watch AS cc_watch FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY pos) AS rk
    FROM known WHERE pos >= 10 AND watch < 500) x WHERE rk = 1),
s3 AS (
  SELECT s.userId, s.slot, st.cnt,
         CASE WHEN sw THEN cc_item ELSE s.itemId END AS itemId,
         CASE WHEN sw THEN cc_cluster ELSE s.cluster END AS cluster,
         CASE WHEN sw THEN cc_watch ELSE s.watch END AS watch
  FROM (SELECT s.*, (st.cnt = 10 AND st.has_cold = 0 AND c.cc_item IS NOT NULL AND s.slot = mw.max_slot) AS sw,
               c.cc_item, c.cc_cluster, c.cc_watch
        FROM slots s JOIN stats st ON st.userId = s.userId JOIN maxw mw ON mw.userId = s.userId
        LEFT JOIN cold_c c ON c.userId = s.userId) s
  JOIN stats st ON st.userId = s.userId),
s3c AS (SELECT *, COUNT(*) OVER (PARTITION BY userId, cluster) AS cl_count FROM s3),
cl AS (
  SELECT userId, COUNT(DISTINCT cluster) AS n_cl, MIN(CASE WHEN cl_count >= 2 THEN slot END) AS target
  FROM s3c GROUP BY userId),
nc AS (
  SELECT userId, itemId AS nc_item, cluster AS nc_cluster, watch AS nc_watch FROM (
    SELECT k.*, ROW_NUMBER() OVER (PARTITION BY k.userId ORDER BY k.pos) AS rk
    FROM known k JOIN cl ON cl.userId = k.userId AND cl.n_cl + 1 = 3
    WHERE k.pos >= 10 AND NOT EXISTS (
      SELECT 1 FROM s3 WHERE s3.userId = k.userId AND s3.cluster = k.cluster)) x
  WHERE rk = 1),
s4 AS (
  SELECT s.userId, s.slot,
         CASE WHEN s.cnt = 10 AND cl.n_cl < 3 AND nc.nc_item IS NOT NULL AND s.slot = cl.target
              THEN nc.nc_item ELSE s.itemId END AS itemId
  FROM s3c s JOIN cl ON cl.userId = s.userId LEFT JOIN nc ON nc.userId = s.userId)"""

ORACLES["streak_cap"] = f"""WITH {RERANK}
SELECT userId, pos, itemId, CAST(run AS BIGINT) AS run, run_idx FROM surv"""

ORACLES["rerank"] = f"""WITH {RERANK}
SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY slot) AS itemId FROM s4 GROUP BY userId"""

ORACLES["rerank_from_wide"] = ORACLES["rerank"]

# ---- ETL, pages, events, lookups -------------------------------------------

USERS_BODY = """users AS (
  SELECT c_custkey AS userId, lst.itemId, c_name AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'M' WHEN 'MACHINERY' THEN 'M'
                           WHEN 'FURNITURE' THEN 'F' WHEN 'HOUSEHOLD' THEN 'F' END AS gender,
         CAST(COALESCE(o.n_orders, 0) AS BIGINT) AS following,
         CAST(14 + c_custkey % 47 AS INTEGER) AS age,
         CAST(trunc(abs(c_acctbal)) AS BIGINT) AS fans
  FROM customer
  LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY itemId) AS itemId
             FROM fx_inter GROUP BY userId) lst ON lst.userId = c_custkey)"""

ITEMS_BODY = ITEM_COUNTS + """,
items AS (
  SELECT p_partkey AS itemId, CAST(p_size * 60 + p_partkey % 60 AS INTEGER) AS length,
         CAST(COALESCE(n_orders, 0) AS BIGINT) AS comment, CAST(COALESCE(n_lines, 0) AS BIGINT) AS "like",
         m.watch, CAST(COALESCE(n_supp, 0) AS BIGINT) AS share, p_name AS name, aud.userId, p_type AS category
  FROM part
  LEFT JOIN icnt ON l_partkey = p_partkey
  LEFT JOIN fx_meta m ON m.itemId = p_partkey
  LEFT JOIN (SELECT itemId, string_agg(CAST(userId AS VARCHAR), '; ' ORDER BY userId) AS userId
             FROM fx_inter GROUP BY itemId) aud ON aud.itemId = p_partkey)"""

RAW_ITEMS_BODY = """raw_items AS (
  SELECT p_partkey AS key, p_name AS title,
         CASE WHEN p_partkey % 13 = 0 THEN CAST(p_size AS VARCHAR)
              WHEN p_partkey % 17 = 0 THEN '1:' || mmss ELSE mmss END AS duration,
         CAST(COALESCE(n_orders, 0) AS BIGINT) AS comments, CAST(COALESCE(n_lines, 0) AS BIGINT) AS likes,
         m.watch AS plays, CAST(COALESCE(n_supp, 0) AS BIGINT) AS favourites, p_type AS category
  FROM (SELECT *, CAST(p_size AS VARCHAR) || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS mmss
        FROM part) p
  LEFT JOIN icnt ON l_partkey = p_partkey
  LEFT JOIN fx_meta m ON m.itemId = p_partkey)"""

RAW_ITEMS = FX_META + ",\n" + ITEM_COUNTS + ",\n" + RAW_ITEMS_BODY

RAW_USERS = """raw_users AS (
  SELECT c_custkey AS id, 'mid' || CAST(c_custkey AS VARCHAR) AS mid, c_name AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '男' WHEN 'MACHINERY' THEN '男'
                           WHEN 'FURNITURE' THEN '女' WHEN 'HOUSEHOLD' THEN '女' WHEN 'BUILDING' THEN '保密' END AS sex,
         CAST(COALESCE(o.n_orders, 0) AS BIGINT) AS following,
         CAST(trunc(abs(c_acctbal)) AS BIGINT) AS fans,
         CAST(c_nationkey % 8 - 1 AS INTEGER) AS level,
         CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey % 80 AS INTEGER) END AS age
  FROM customer
  LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey)"""


def duration_sql(d: str) -> str:
    sp = f"string_split({d}, ':')"
    return (f"CASE len({sp}) "
            f"WHEN 2 THEN TRY_CAST({sp}[1] AS INTEGER) * 60 + TRY_CAST({sp}[2] AS INTEGER) "
            f"WHEN 3 THEN TRY_CAST({sp}[1] AS INTEGER) * 3600 + TRY_CAST({sp}[2] AS INTEGER) * 60 "
            f"+ TRY_CAST({sp}[3] AS INTEGER) END")


def gender_sql(sex: str, key: str) -> str:
    return (f"CASE {sex} WHEN '男' THEN 'M' WHEN '女' THEN 'F' ELSE "
            f"CASE WHEN substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 1) < '8' THEN 'M' ELSE 'F' END END")


def numeric_tokens_sql(x: str) -> str:
    return (f"list_transform(list_filter(list_transform(string_split({x}, ';'), lambda t: {strip_sql('t')}), "
            f"lambda t: regexp_full_match(t, '[0-9]+')), lambda t: TRY_CAST(t AS BIGINT))")


CLEAN_ITEMS = RAW_ITEMS + f""",
ci0 AS (
  SELECT key, {duration_sql('duration')} AS length, comments AS comment, likes AS "like", plays AS watch,
         favourites AS share, title AS name, category FROM raw_items),
clean_items AS (
  SELECT ROW_NUMBER() OVER (ORDER BY key) AS itemId, length, comment, "like", watch, share, name, category
  FROM ci0 WHERE length IS NOT NULL AND name IS NOT NULL)"""

INVERT = """inv_tok AS (
  SELECT itemId, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS tok
  FROM (SELECT itemId, string_split(userId, ';') AS s FROM items) x),
inverted AS (
  SELECT """ + strip_sql("tok") + """ AS userId,
         string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY itemId, pos) AS itemId
  FROM inv_tok WHERE """ + strip_sql("tok") + """ <> '' GROUP BY 1)"""


def quota_sql(items: str) -> str:
    return f"""tot AS (SELECT CAST(SUM(watch) AS DOUBLE) AS t FROM {items}),
nusers AS (SELECT COUNT(*) AS n FROM customer),
cats AS (
  SELECT category, CAST(SUM(watch) AS BIGINT) AS cat_watch,
         CAST(SUM(watch) AS DOUBLE) / (SELECT t FROM tot) AS share
  FROM {items} GROUP BY category),
pools AS (
  SELECT category, cat_watch,
         greatest(least(CAST(round_even(share * (SELECT n FROM nusers) * 100, 0) AS BIGINT),
                        (SELECT n FROM nusers)), 0) AS pool
  FROM cats),
quota AS (
  SELECT i.itemId, i.category,
         CAST(CASE WHEN p.cat_watch > 0 AND p.pool > 0
                   THEN greatest(20, least(CAST(round_even(p.pool * 100 * (CAST(i.watch AS DOUBLE) / p.cat_watch), 0)
                                                AS BIGINT), 100))
                   ELSE 0 END AS BIGINT) AS k
  FROM {items} i LEFT JOIN pools p ON p.category = i.category)"""


ORACLES["parse_duration"] = f"""WITH {RAW_ITEMS}
SELECT key, duration, {duration_sql('duration')} AS length FROM raw_items"""

ORACLES["normalize_gender"] = f"""WITH {RAW_USERS}
SELECT id, sex, {gender_sql('sex', 'id')} AS gender FROM raw_users"""

ORACLES["column_ops"] = f"""WITH {RAW_USERS}
SELECT id AS userId, name, sex AS gender_raw, following, fans, CAST(1.0 AS DOUBLE) AS rating FROM raw_users"""

ORACLES["drop_null_rows"] = f"""WITH {RAW_ITEMS}
SELECT * FROM (SELECT key, title, {duration_sql('duration')} AS length FROM raw_items) x
WHERE length IS NOT NULL AND title IS NOT NULL"""

ORACLES["casts"] = f"""WITH {RAW_ITEMS}
SELECT key, CAST(plays AS VARCHAR) AS plays_text, TRY_CAST(string_split(duration, ':')[1] AS INTEGER) AS lead_int,
       CAST(plays AS FLOAT) AS plays_f32 FROM raw_items"""

ORACLES["row_ids"] = """SELECT p_partkey, p_name, ROW_NUMBER() OVER (ORDER BY p_partkey) AS row_id FROM part"""

ORACLES["encode_ids"] = f"""WITH {FX_INTER}
SELECT itemId, DENSE_RANK() OVER (ORDER BY itemId) - 1 AS item_idx FROM (SELECT DISTINCT itemId FROM fx_inter) d"""

ORACLES["union_by_name"] = f"""WITH {FX_INTER}
SELECT userId, itemId, CAST(NULL AS VARCHAR) AS src FROM fx_inter WHERE itemId % 2 = 0
UNION ALL SELECT userId, itemId, 'b' FROM fx_inter WHERE itemId % 2 = 1"""

ORACLES["distinct_pairs"] = f"""WITH {FX_INTER} SELECT userId, itemId FROM fx_inter"""

ORACLES["seen_except"] = f"""WITH {FX_INTER}, {FX_EVENTS}
SELECT * FROM fx_events e
WHERE NOT EXISTS (SELECT 1 FROM fx_inter i WHERE i.userId = e.userId AND i.itemId = e.itemId)"""

ORACLES["clean_items"] = f"""WITH {CLEAN_ITEMS} SELECT * FROM clean_items"""

ORACLES["invert_lists"] = f"""WITH {FX_INTER}, {FX_META}, {ITEMS_BODY}, {INVERT}
SELECT * FROM inverted"""

ORACLES["clean_users"] = f"""WITH {FX_INTER}, {FX_META}, {ITEMS_BODY}, {INVERT}, {RAW_USERS}
SELECT CAST(u.id AS VARCHAR) AS userId, l.itemId, u.name, {gender_sql('u.sex', 'u.id')} AS gender, u.following,
       CASE WHEN u.age < 14 THEN 14 WHEN u.age > 60 THEN 60 ELSE u.age END AS age, u.fans
FROM raw_users u JOIN inverted l ON l.userId = CAST(u.id AS VARCHAR)"""

ORACLES["renumber_users"] = f"""WITH {RAW_USERS}
SELECT ROW_NUMBER() OVER (ORDER BY mid) AS id, mid, name,
       CASE WHEN age < 14 THEN 14 WHEN age > 60 THEN 60 ELSE age END AS age
FROM raw_users"""

ORACLES["category_share"] = f"""WITH {CLEAN_ITEMS}
SELECT category, CAST(SUM(watch) AS BIGINT) AS cat_watch,
       round(CAST(SUM(watch) AS DOUBLE) / (SELECT CAST(SUM(watch) AS DOUBLE) FROM clean_items), 6) AS share
FROM clean_items GROUP BY category"""

ORACLES["audience_quota"] = f"""WITH {CLEAN_ITEMS}, {quota_sql('clean_items')}
SELECT itemId, category, k FROM quota"""

ORACLES["stratified_sample"] = f"""WITH {FX_INTER}, {FX_META}, {ITEMS_BODY}, {quota_sql('items')},
aud AS (SELECT f.itemId, f.userId, q.k FROM fx_inter f JOIN quota q ON q.itemId = f.itemId),
r AS (
  SELECT itemId, userId, k,
         ROW_NUMBER() OVER (PARTITION BY itemId ORDER BY md5('42:' || CAST(itemId AS VARCHAR) || ':' || CAST(userId AS VARCHAR)), userId) AS rank
  FROM aud)
SELECT itemId, userId, rank FROM r WHERE rank <= 100 AND rank <= k"""

SKEWED_ITEMS = """sk_items AS (
  SELECT p_partkey AS itemId, CAST((p_partkey % 97) ** 3 AS BIGINT) AS watch,
         CASE WHEN p_partkey % 97 = 0 THEN 'none' WHEN p_partkey % 97 = 1 THEN 'tiny'
              WHEN p_partkey % 97 <> 2 THEN p_brand END AS category
  FROM part)"""

SPREAD = f"""{SKEWED_ITEMS},
tot AS (SELECT SUM(watch) AS t FROM sk_items),
pools AS (
  SELECT category, SUM(watch) AS cw,
         least(CAST(round_even(CAST(SUM(watch) AS DOUBLE) / CAST((SELECT t FROM tot) AS DOUBLE)
                               * (SELECT COUNT(*) FROM customer) * 100, 0) AS BIGINT),
               (SELECT COUNT(*) FROM customer)) AS pool
  FROM sk_items WHERE category IS NOT NULL GROUP BY category),
spread AS (
  SELECT s.itemId, s.category,
         CAST(CASE WHEN cw > 0 AND pool > 0
              THEN least(greatest(round_even(pool * 100 * (CAST(watch AS DOUBLE) / CAST(cw AS DOUBLE)), 0), 20), 100)
              ELSE 0 END AS BIGINT) AS k
  FROM sk_items s LEFT JOIN pools p ON p.category = s.category)"""

ORACLES["audience_quota_spread"] = f"""WITH {SPREAD} SELECT itemId, category, k FROM spread"""

ORACLES["stratified_sample_spread"] = f"""WITH {FX_INTER}, {SPREAD},
draw AS (
  SELECT f.itemId, f.userId, s.k,
         row_number() OVER (PARTITION BY f.itemId
                            ORDER BY md5(concat_ws(':', '42', CAST(f.itemId AS VARCHAR), CAST(f.userId AS VARCHAR)))) AS rank
  FROM fx_inter f JOIN spread s USING (itemId))
SELECT itemId, userId, rank FROM draw WHERE rank <= k"""

ORACLES["category_share_null"] = f"""WITH {SKEWED_ITEMS}
SELECT category, CAST(SUM(watch) AS BIGINT) AS cat_watch,
       round(CAST(SUM(watch) AS DOUBLE) / (SELECT CAST(SUM(watch) AS DOUBLE) FROM sk_items), 6) AS share
FROM sk_items WHERE category IS NOT NULL GROUP BY category"""

ORACLES["popularity_lookup_spread"] = """WITH c AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS itemId, COUNT(DISTINCT event_id) AS n
  FROM events GROUP BY 1)
SELECT p_partkey AS itemId, CAST(COALESCE(n, 0) AS BIGINT) AS user_count,
       format('{:,}', CAST(COALESCE(n, 0) AS BIGINT)) AS user_count_text
FROM part LEFT JOIN c ON c.itemId = p_partkey"""

ORACLES["parse_duration_edges"] = """WITH t AS (
  SELECT p_partkey AS key, CAST(p_partkey AS BIGINT) * 9999 AS h, p_size AS m, p_partkey % 60 AS s FROM part),
x AS (
  SELECT key, CASE key % 6
           WHEN 0 THEN CAST(h AS VARCHAR) || ':' || CAST(m AS VARCHAR) || ':' || CAST(s AS VARCHAR)
           WHEN 1 THEN CAST(h AS VARCHAR) || '99999999999999999999:0:1'
           WHEN 2 THEN CAST(m AS VARCHAR) || ':' WHEN 3 THEN 'x:' || CAST(s AS VARCHAR)
           WHEN 4 THEN '' ELSE CAST(m AS VARCHAR) || ':' || CAST(s AS VARCHAR) END AS duration,
         CASE key % 6 WHEN 0 THEN h * 3600 + m * 60 + s WHEN 5 THEN m * 60 + s END AS secs
  FROM t)
SELECT key, duration, CASE WHEN secs <= 2147483647 THEN CAST(secs AS INTEGER) END AS length FROM x"""

ORACLES["json_fields_missing"] = """SELECT event_id,
       CASE WHEN event_id % 3 = 0 THEN '0' ELSE json_extract_string(props, '$.k') END AS k
FROM events"""

TITLE_SQL = "'<title>(.*?)</title>'"
LANG_SQL = "'<html lang=\"(.*?)\"'"
NUM_SQL = "'/([0-9]+)'"


def or_default(x: str, pat: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {pat}) THEN regexp_extract({x}, {pat}, 1) ELSE '未知' END"


def first_class_sql(x: str, markers: list[str]) -> str:
    parts = " ".join(f"WHEN contains({x}, '{m}') THEN {i}" for i, m in enumerate(markers))
    return f"CASE {parts} ELSE -1 END"


LEVELS = ["lv0", "lv1", "lv2", "lv3", "lv4", "lv5", "lv6"]
SECTIONS_SQL = ["/en/", "/fr/", "/de/", "/es/"]

ORACLES["page_fields"] = f"""SELECT page_id,
  regexp_replace({or_default('html', TITLE_SQL)}, '<[^>]+>', '', 'g') AS title,
  {or_default('html', LANG_SQL)} AS lang,
  {first_class_sql('url', SECTIONS_SQL)} AS section,
  regexp_replace(url, '^https?://[^/]+', '') AS path,
  {or_default('url', NUM_SQL)} AS number,
  {first_class_sql('html', LEVELS)} AS level
FROM pages WHERE contains(html, '<title>')"""

ORACLES["strip_tags"] = """SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages"""

ORACLES["level_class"] = f"""SELECT page_id, {first_class_sql('html', LEVELS)} AS level,
  {first_class_sql('url', SECTIONS_SQL)} AS section FROM pages"""

ORACLES["json_fields"] = """SELECT event_id, COALESCE(json_extract_string(props, '$.k'), '0') AS k FROM events"""

ORACLES["epoch_format"] = """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events"""

ORACLES["popularity_lookup"] = f"""WITH {FX_INTER},
pop AS (SELECT itemId, COUNT(DISTINCT userId) AS c FROM fx_inter GROUP BY itemId)
SELECT p_partkey AS itemId, CAST(COALESCE(c, 0) AS BIGINT) AS user_count,
       format('{{:,}}', CAST(COALESCE(c, 0) AS BIGINT)) AS user_count_text
FROM part LEFT JOIN pop ON pop.itemId = p_partkey"""

_SU = similar_users_sql(FX_INTER, "fx_inter", "cosine", 10)
_SU_CTES, _SU_FINAL = _SU.split("\nSELECT u.userId, COALESCE", 1)

ORACLES["similar_user_cards"] = f"""{_SU_CTES},
su AS (SELECT u.userId, COALESCE{_SU_FINAL}),
{USERS_BODY},
arr AS (SELECT userId, len(string_split(similarUsers, ';')) AS n, {numeric_tokens_sql('similarUsers')} AS a FROM su),
ex AS (SELECT userId, n, generate_subscripts(a, 1) AS rank, unnest(a) AS similarId FROM arr)
SELECT ex.userId, CAST(ex.rank AS BIGINT) AS rank, ex.similarId, u.name, u.gender, u.age, u.fans, u.following,
       ex.n = 10 AS valid
FROM ex LEFT JOIN users u ON u.userId = ex.similarId"""

ORACLES["recommendation_cards"] = f"""WITH {RERANK},
{ITEMS_BODY},
rr AS (SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY slot) AS itemId FROM s4 GROUP BY userId),
arr AS (SELECT userId, len(string_split(itemId, ';')) AS n, {numeric_tokens_sql('itemId')} AS a FROM rr),
ex AS (SELECT userId, n, generate_subscripts(a, 1) AS rank, unnest(a) AS recItem FROM arr)
SELECT ex.userId, CAST(ex.rank AS BIGINT) AS rank, ex.recItem AS itemId, i.length, i.comment, i."like", i.watch,
       i.share, substr(i.name, 1, 35) AS title, ex.n = 10 AS valid
FROM ex LEFT JOIN items i ON i.itemId = ex.recItem"""


def peers_sql(members: str, key: str, k: int = 10) -> str:
    return f"""smp AS (
  SELECT cluster, {key} AS peerId, srank FROM (
    SELECT cluster, {key}, ROW_NUMBER() OVER (PARTITION BY cluster
      ORDER BY md5('7:' || CAST(cluster AS VARCHAR) || ':' || CAST({key} AS VARCHAR)), {key}) AS srank
    FROM {members}) x WHERE srank <= {k + 1}),
pr AS (
  SELECT m.{key}, m.cluster, s.peerId,
         ROW_NUMBER() OVER (PARTITION BY m.{key} ORDER BY s.srank) AS rank
  FROM {members} m JOIN smp s ON s.cluster = m.cluster AND s.peerId <> m.{key}),
peers AS (SELECT * FROM pr WHERE rank <= {k})"""


ORACLES["user_peers"] = f"""WITH {FX_INTER}, {USERS_BODY},
mem AS (SELECT c_custkey AS userId, c_nationkey AS cluster FROM customer),
{peers_sql('mem', 'userId')}
SELECT p.userId, p.cluster, p.rank, p.peerId, u.name, u.gender, u.age, u.fans, u.following
FROM peers p LEFT JOIN users u ON u.userId = p.peerId"""

ORACLES["item_peers"] = f"""WITH {FX_INTER}, {FX_META}, {ITEMS_BODY},
mem AS (SELECT itemId, cluster FROM fx_meta),
{peers_sql('mem', 'itemId')}
SELECT p.itemId, p.cluster, p.rank, p.peerId, i.length, i.comment, i."like", i.watch, i.share,
       substr(i.name, 1, 35) AS title
FROM peers p LEFT JOIN items i ON i.itemId = p.peerId"""

ORACLES["item_peers_long_titles"] = f"""WITH {FX_META},
mem AS (SELECT itemId, cluster FROM fx_meta),
{peers_sql('mem', 'itemId', 3)}
SELECT p.itemId, p.cluster, p.rank, p.peerId,
       substr(p_name || ' / ' || p_type || repeat(' / ' || p_name, CAST(p_partkey % 4 AS INTEGER)), 1, 35) AS title
FROM peers p JOIN part ON p_partkey = p.peerId"""

TITLED_POP = FX_INTER + """,
tpop AS (
  SELECT p.p_partkey AS itemId,
         CASE WHEN p.p_partkey % 2 = 0 THEN p.p_name || ', "' || p.p_type || '"' || chr(10) || 'line 2'
              ELSE p.p_name END AS title,
         c.user_count
  FROM (SELECT itemId, COUNT(DISTINCT userId) AS user_count FROM fx_inter GROUP BY itemId) c
  JOIN part p ON p.p_partkey = c.itemId)"""

ORACLES["csv_round_trip"] = f"""WITH {TITLED_POP} SELECT itemId, title, user_count FROM tpop"""
ORACLES["csv_append"] = ORACLES["csv_round_trip"]
ORACLES["csv_union_files"] = f"""WITH {TITLED_POP}
SELECT itemId, user_count, CASE WHEN itemId % 2 = 1 THEN 'odd' END AS src FROM tpop"""
ORACLES["popularity_stream"] = ORACLES["item_popularity"]
