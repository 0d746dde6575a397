"""DuckDB SQL of sources, sinks and stored pages."""

from __future__ import annotations

from rivulet.plans.oracles import FACTORS, FX_INTER, ORACLES, RAW_USERS

ORACLES["csv_append_replayed"] = ORACLES["csv_append"]
ORACLES["csv_bom"] = f"SELECT *, TRUE AS marked FROM ({ORACLES['csv_round_trip']}) t"
ORACLES["csv_gb18030"] = f"""WITH {RAW_USERS}
SELECT id, sex, '用户, "名"' || chr(10) || '𠀀 ' || name AS name, fans FROM raw_users"""

_RECORDS = """p AS (SELECT p_partkey AS k, p_partkey // 20 AS page_id, * FROM part),
why AS (SELECT page_id, CASE WHEN page_id % 29 = 5 THEN 'status' WHEN page_id % 17 = 3 THEN 'malformed' WHEN page_id % 31 = 6 THEN 'no result'
  WHEN page_id % 23 = 4 AND max(CASE WHEN k % 20 = 7 THEN 1 ELSE 0 END) = 1 THEN 'record' END AS reason FROM p GROUP BY page_id)"""

ORACLES["search_rejects"] = f"""WITH {_RECORDS} SELECT page_id, reason FROM why WHERE reason IS NOT NULL"""

ORACLES["search_items"] = f"""WITH {_RECORDS}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, p_brand || ' ' || p_name AS title,
  'up' || CAST(p_size AS VARCHAR) AS author, 'BV' || CAST(k AS VARCHAR) AS bvid,
  strftime(make_timestamp((1500000000 + k * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS uploaded, CAST(p_size AS VARCHAR) || ':07' AS duration,
  CAST(CASE WHEN k % 5 <> 0 THEN k % 1000 ELSE 0 END AS BIGINT) AS danmaku, CAST(CASE WHEN k % 7 <> 0 THEN k * 3 ELSE 0 END AS BIGINT) AS likes,
  CAST(k * 10 AS BIGINT) AS plays, CAST(k % 100 AS BIGINT) AS favourites, p_type AS category, p_brand || ',' || p_type AS tags,
  '"' || p_name || '"' || chr(10) AS description
FROM p JOIN why USING (page_id) WHERE reason IS NULL"""

ORACLES["keyed_lookup"] = f"""WITH {FACTORS}
SELECT userId, string_agg(CAST(itemId AS VARCHAR), '; ' ORDER BY rank) AS itemId FROM ranked WHERE rank <= 100 AND userId IN (2, -1) GROUP BY userId"""

ORACLES["item_popularity_sketch_facts"] = """SELECT 'all' AS days, COUNT(DISTINCT l_partkey) AS items, CAST(0 AS BIGINT) AS off
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'half', COUNT(DISTINCT l_partkey), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <= DATE '1995-06-30'"""

ORACLES["popularity_late_orders"] = f"""WITH {FX_INTER} SELECT itemId, COUNT(*) AS user_count FROM fx_inter GROUP BY itemId"""
