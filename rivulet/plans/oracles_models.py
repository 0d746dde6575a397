"""DuckDB SQL of the trained models: the same steps written out, or what must hold of the result."""

from __future__ import annotations

from rivulet.plans.oracles import FACTORS, FX_INTER, ORACLES


def minibatch_sql(features_sql: str, key: str, features: list[str], k: int, batch_size: int, batches: int) -> str:
    """Mini-batch k-means from the first keyed rows, one pair of CTEs for each step."""
    dims = range(1, len(features) + 1)
    vec = ", ".join(f'coalesce("{c}", (SELECT coalesce(avg("{c}"), 0) FROM f))' for c in features)
    dist = " + ".join(f"(b.x[{i}] - c.x[{i}]) * (b.x[{i}] - c.x[{i}])" for i in dims)
    sql = f"""WITH f AS MATERIALIZED ({features_sql}),
v AS MATERIALIZED (SELECT {key} AS id, [{vec}] AS x FROM f),
size AS (SELECT greatest(1, CAST(ceil(count(*) / {batch_size}) AS BIGINT)) AS nb FROM v WHERE id IS NOT NULL),
b AS MATERIALIZED (SELECT e * nb + CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':' || CAST(e AS VARCHAR)), 1, 8) AS BIGINT) % nb AS batch, id, x
  FROM v, size, range(0, {batches}) r(e) WHERE id IS NOT NULL),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o) - 1 AS no, x, 0 AS n, [{", ".join("0.0" for _ in dims)}]::DOUBLE[] AS s
  FROM (SELECT x, min(struct_pack(h := md5(CAST(id AS VARCHAR)), id := id)) AS o FROM v WHERE id IS NOT NULL GROUP BY x ORDER BY o LIMIT {k}))"""
    for t in range(batches):
        sums = ", ".join(f"sum(x[{i}])" for i in dims)
        total = ", ".join(f"c.s[{i}] + coalesce(a.s[{i}], 0)" for i in dims)
        mean = ", ".join(f"(c.s[{i}] + a.s[{i}]) / (c.n + a.n)" for i in dims)
        sql += f""",
a{t} AS MATERIALIZED (SELECT no, count(*) AS n, [{sums}] AS s FROM (
  SELECT b.id, any_value(b.x) AS x, min(struct_pack(d := {dist}, no := c.no)).no AS no FROM b, c{t} c WHERE batch = {t} GROUP BY b.id) GROUP BY no),
c{t + 1} AS MATERIALIZED (SELECT c.no, CASE WHEN a.n > 0 THEN [{mean}] ELSE c.x END AS x, c.n + coalesce(a.n, 0) AS n, [{total}] AS s
  FROM c{t} c LEFT JOIN a{t} a ON a.no = c.no)"""
    return sql + f"""
SELECT b.id AS {key}, CAST(min(struct_pack(d := {dist}, no := c.no)).no AS INTEGER) AS cluster FROM v b, c{batches} c GROUP BY b.id"""


ORACLES["kmeans_minibatch_users"] = minibatch_sql(
    ORACLES["user_features"], "userId", ["age", "fans", "gender_code", "num_watched", "num_follow"], 20, 1024, 6)
ORACLES["kmeans_minibatch_items"] = minibatch_sql(
    ORACLES["item_features"], "itemId", ["length", "comment", "like", "watch", "share", "num_viewers"], 50, 4096, 6)
ORACLES["kmeans_minibatch_facts"] = """SELECT 'users' AS side, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_off, CAST(20 AS BIGINT) AS centres, TRUE AS closer FROM customer
UNION ALL SELECT 'items', COUNT(*), CAST(0 AS BIGINT), CAST(50 AS BIGINT), TRUE FROM part"""

ORACLES["factor_train_facts"] = f"""WITH {FX_INTER}
SELECT COUNT(DISTINCT userId) AS users, COUNT(DISTINCT userId) AS whole, COUNT(DISTINCT itemId) AS items, CAST(8 AS BIGINT) AS half_sweeps,
       CAST(0 AS BIGINT) AS rises, TRUE AS learned
FROM fx_inter"""

ORACLES["factor_recommend_pruned_facts"] = f"""WITH {FACTORS}
SELECT CAST(SUM(least(5, (SELECT COUNT(*) FROM itf) - COALESCE(n, 0))) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS off
FROM uf LEFT JOIN (SELECT userId, COUNT(*) AS n FROM seen GROUP BY userId) k ON k.userId = uf.userId"""
