"""SQL for the citation fixture, splits and closed-form forecasters."""

from growthcast.plans.registry import cte

H = range(1, 11)

cte("ev", """
SELECT l_partkey AS pid, l_orderkey AS oid, l_suppkey AS sid, l_returnflag = 'R' AS key,
       CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INT) AS per
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate < TIMESTAMP '2001-07-01'""")

cte("paper", "SELECT pid, min(per) AS p0, "
    + "count(*) FILTER (per <= 15) AS base, count(*) FILTER (per = 15) AS d0, count(*) FILTER (per = 14) AS d1, "
    + "count(*) FILTER (per <= 13) AS base_w, "
    + "count(*) FILTER (per <= 15 AND key) AS kbase, count(*) FILTER (per = 15 AND key) AS kd0, "
    + "count(*) FILTER (per = 14 AND key) AS kd1, count(*) FILTER (per <= 13 AND key) AS kbase_w, "
    + ", ".join(f"count(*) FILTER (per <= {15 + h}) AS y_{h}" for h in H)
    + " FROM ev GROUP BY pid HAVING min(per) <= 15")

cte("ent_all", "SELECT pid AS row_id, base::DOUBLE AS base, d0::DOUBLE AS delta, d1::DOUBLE AS delta_1, "
    "base / (15 - p0 + 1)::DOUBLE AS average, (15 - p0 + 1)::INT AS age, p0, "
    + ", ".join(f"y_{h}::DOUBLE AS y_{h}" for h in H) + " FROM paper")
cte("ent", "SELECT * FROM ent_all WHERE base >= 5")

cte("keyed", "SELECT *, row_number() OVER (ORDER BY md5(row_id || '-12'), row_id) AS rn, "
    "count(*) OVER () AS n_ent FROM ent")
cte("spl", """
SELECT *, CASE WHEN rn <= least(n_ent // 5, 10000) THEN 'test'
  WHEN rn <= least(n_ent // 5, 10000) + least(n_ent // 10, 10000) THEN 'valid' ELSE 'train' END AS split
FROM keyed""")
cte("long", " UNION ALL ".join(
    f"SELECT row_id, split, base, delta, average, age, {h} AS horizon, y_{h} AS y FROM spl" for h in H))
cte("truth", "SELECT row_id, split, horizon, base, y FROM long")

cte("sm_mom", """
SELECT horizon, avg(base) m1, avg(delta) m2, avg(y) my, var_pop(base) s11, var_pop(delta) s22,
  covar_pop(base, delta) s12, covar_pop(base, y) c1, covar_pop(delta, y) c2
FROM long WHERE split = 'train' GROUP BY horizon""")
cte("sm_par", """
SELECT horizon, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *,
  (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM sm_mom)""")
cte("vk_mom", """
SELECT avg(base) m1, avg(x2) m2, avg(y) my, var_pop(base) s11, var_pop(x2) s22,
  covar_pop(base, x2) s12, covar_pop(base, y) c1, covar_pop(x2, y) c2
FROM (SELECT base, horizon * average AS x2, y FROM long WHERE split = 'train')""")
cte("vk_par", """
SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *,
  (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM vk_mom)""")
cte("preds", """
SELECT 'F' AS model, split, row_id, horizon, base AS pred FROM long
UNION ALL SELECT 'SM', split, row_id, long.horizon, greatest(b0 + b1 * base + b2 * delta, base)
FROM long JOIN sm_par ON long.horizon = sm_par.horizon
UNION ALL SELECT 'Variable k', split, row_id, horizon, greatest(b0 + b1 * base + b2 * horizon * average, base)
FROM long CROSS JOIN vk_par""")
cte("scored", """
SELECT p.model, t.split, t.row_id, t.horizon, t.base, s.age, t.y, p.pred
FROM preds p JOIN truth t ON p.row_id = t.row_id AND p.horizon = t.horizon AND p.split = t.split
JOIN spl s ON s.row_id = t.row_id""")
cte("series_all", """
SELECT p.pid AS row_id, p.p0, t.range::INT AS per, t.range::INT - p.p0 + 1 AS t, coalesce(c.n, 0) AS inc,
  sum(coalesce(c.n, 0)) OVER (PARTITION BY p.pid ORDER BY t.range) AS cum
FROM paper p CROSS JOIN range(0, 16) t
LEFT JOIN (SELECT pid, per, count(*) AS n FROM ev GROUP BY pid, per) c ON c.pid = p.pid AND c.per = t.range
WHERE t.range >= p.p0""")
cte("sm_test", "SELECT * FROM scored WHERE model = 'SM' AND split = 'test' AND horizon = 10")
cte("mape_tab", """
SELECT model, split, horizon, avg(abs((pred - y) / y)) AS mape,
  sqrt(var_pop(abs((pred - y) / y)) / count(*)) AS se FROM scored GROUP BY ALL""")
cte("rsq_tab", """
SELECT model, split, horizon, 1 - avg((pred - y) ** 2) / var_pop(y) AS rsq,
  1 - avg((pred - y) ** 2) / var_pop(y - base) AS pa_rsq FROM scored GROUP BY ALL""")
