"""Queries over metrics, selection, diagnostics and closed-form forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthcast.functions import scalars as S
from growthcast.models import baselines as B
from growthcast.operators import diagnostics as DG, metrics as M, ranking as K
from growthcast.plans import frames as fr
from growthcast.plans.registry import query
from growthcast.session import materialise


def r(c: str, alias: str | None = None, digits: int = 6):
    return F.round(F.col(c), digits).alias(alias or c)


@query("a01_mape", "SELECT model, split, horizon, round(mape, 6) AS mape FROM mape_tab")
def a01(spark, sf):
    return M.mape(fr.scored_frame(spark, sf)).select("model", "split", "horizon", r("mape"))


@query("a02_mape_with_error", """
SELECT model, split, horizon, round(avg(abs((pred - y) / y)), 6) AS mape,
  round(sqrt(var_pop(abs((pred - y) / y)) / count(*)), 6) AS se, CAST(count(*) AS BIGINT) AS n_rows
FROM scored GROUP BY ALL""")
def a02(spark, sf):
    return M.mape_with_error(fr.scored_frame(spark, sf)).select("model", "split", "horizon", r("mape"), r("se"), "n_rows")


_YEARS = ", ".join(f"round(max(mape) FILTER (horizon = {h}), 6) AS \"{2005 + h}\"" for h in range(1, 11))


@query("a03_mape_tables", f"SELECT model, split, {_YEARS} FROM mape_tab GROUP BY model, split")
def a03(spark, sf):
    from growthcast.operators.reshape import metric_by_year

    wide = metric_by_year(M.mape(fr.scored_frame(spark, sf)), 10, 2006, "mape", ("model", "split"))
    return wide.select("model", "split", *[r(str(2005 + h)) for h in range(1, 11)])


@query("a04_mape_score", """
SELECT model, round(-avg(abs(pred - y) / y), 6) AS score FROM scored WHERE split = 'valid' AND horizon = 10 GROUP BY model""")
def a04(spark, sf):
    valid = fr.scored_frame(spark, sf).where("split = 'valid' AND horizon = 10")
    return M.mape(valid, ["model"]).select("model", F.round(-F.col("mape"), 6).alias("score"))


@query("a05_r_squared", "SELECT model, split, horizon, round(rsq, 6) AS rsq FROM rsq_tab")
def a05(spark, sf):
    return M.r_squared(fr.scored_frame(spark, sf)).select("model", "split", "horizon", r("rsq"))


@query("a06_past_adjusted_r_squared", "SELECT model, split, horizon, round(pa_rsq, 6) AS pa_rsq FROM rsq_tab")
def a06(spark, sf):
    return M.r_squared(fr.scored_frame(spark, sf)).select("model", "split", "horizon", r("pa_rsq"))


@query("a07_r_squared_tables", """
SELECT 'mape' AS metric, model, split, horizon, round(mape, 6) AS value, round(se, 6) AS se FROM mape_tab
UNION ALL SELECT 'rsq', model, split, horizon, round(rsq, 6), NULL FROM rsq_tab
UNION ALL SELECT 'pa_rsq', model, split, horizon, round(pa_rsq, 6), NULL FROM rsq_tab""")
def a07(spark, sf):
    return M.all_metrics(fr.scored_frame(spark, sf)).select(
        "metric", "model", "split", "horizon", r("value"), r("se"))


@query("a08_r_squared_without_outliers", """
SELECT model, split, horizon, round(1 - avg((pred - y) ** 2) / var_pop(y), 6) AS rsq,
  round(1 - avg((pred - y) ** 2) / var_pop(y - base), 6) AS pa_rsq
FROM scored WHERE (split, row_id) NOT IN (
  SELECT (split, row_id) FROM (SELECT *, row_number() OVER (
    PARTITION BY model, split, horizon ORDER BY (pred - y) ** 2 DESC, row_id) AS k FROM scored) WHERE k = 1)
GROUP BY model, split, horizon""")
def a08(spark, sf):
    scored = materialise(fr.scored_frame(spark, sf), "scored")
    return M.r_squared_without_outliers(scored).select("model", "split", "horizon", r("rsq"), r("pa_rsq"))


@query("a09_trimmed_pa_r_squared", """
SELECT model, split, horizon, round(1 - avg(e) / var_pop(y - base), 6) AS pa_rsq FROM (
  SELECT *, row_number() OVER (PARTITION BY model, split, horizon ORDER BY e DESC, row_id) AS kw,
    row_number() OVER (PARTITION BY model, split, horizon ORDER BY g DESC, row_id) AS kb
  FROM (SELECT *, (y - base - m) ** 2 - e AS g FROM (
    SELECT *, (pred - y) ** 2 AS e, avg(y - base) OVER (PARTITION BY model, split, horizon) AS m FROM scored
    WHERE model IN ('F', 'Variable k'))))
WHERE kw > 50 AND kb > 50 GROUP BY model, split, horizon""")
def a09(spark, sf):
    scored = materialise(fr.scored_frame(spark, sf).where(F.col("model").isin("F", "Variable k")), "scored")
    return M.pa_r_squared_trimmed(scored, 50, 50).select("model", "split", "horizon", r("pa_rsq"))


@query("a10_median_and_mean_ape", """
SELECT model, split, round(median(abs((pred - y) / y)), 6) AS median_ape, round(avg(abs((pred - y) / y)), 6) AS mean_ape
FROM scored WHERE horizon = 10 GROUP BY model, split""")
def a10(spark, sf):
    last = materialise(fr.scored_frame(spark, sf).where("horizon = 10"), "scored")
    return M.median_and_mean_ape(last).select("model", "split", r("median_ape"), r("mean_ape"))


@query("a11_mape_per_group", """
SELECT CAST(base AS DOUBLE) AS base, round(avg(abs((pred - y) / y)), 6) AS mape, CAST(count(*) AS BIGINT) AS n_rows,
  round(count(*) / (SELECT count(*) FROM sm_test)::DOUBLE, 6) AS share FROM sm_test GROUP BY base""")
def a11(spark, sf):
    return DG.mape_per_group(fr.linear_test_frame(spark, sf), "base").select("base", r("mape"), "n_rows", r("share"))


@query("a12_error_labels", """
SELECT age, round(max((pred - y) / y), 6) AS max_pe, round(min((pred - y) / y), 6) AS min_pe,
  round(avg(abs((pred - y) / y)), 6) AS mean_abs_pe, CAST(count(*) AS BIGINT) AS n_rows,
  CAST((row_number() OVER (ORDER BY age) - 1) % 2 AS INT) AS side FROM sm_test GROUP BY age""")
def a12(spark, sf):
    return DG.error_labels(fr.linear_test_frame(spark, sf), "age").select(
        "age", r("max_pe"), r("min_pe"), r("mean_abs_pe"), "n_rows", "side")


@query("a13_error_extent", """
SELECT round(hi, 6) AS max_pe, round(lo, 6) AS min_pe, mg AS max_group, mg + 1 AS "right",
  round(hi + greatest(hi * 0.1e0, 0.3e0), 6) AS top, round(lo + least(lo * 0.2e0, -0.5e0), 6) AS bottom
FROM (SELECT max((pred - y) / y) AS hi, min((pred - y) / y) AS lo, max(age)::DOUBLE AS mg FROM sm_test)""")
def a13(spark, sf):
    return DG.error_extent(fr.linear_test_frame(spark, sf), "age").select(
        r("max_pe"), r("min_pe"), "max_group", "right", r("top"), r("bottom"))


@query("a14_density_by_group", """
SELECT row_id, age, round(density, 6) AS density, round(density / max(density) OVER (PARTITION BY age), 6) AS scaled
FROM (SELECT a.row_id, a.age, CASE WHEN max(b.n) > 1 AND max(b.sd) > 0 THEN
    sum(exp(-0.5e0 * ((a.pe - b.pe) / (b.n ** -0.2e0 * b.sd)) ** 2))
      / (max(b.n) * max(b.n ** -0.2e0 * b.sd) * sqrt(2 * pi())) END AS density
  FROM (SELECT row_id, age, (pred - y) / y AS pe FROM sm_test) a
  JOIN (SELECT age, (pred - y) / y AS pe, count(*) OVER (PARTITION BY age) AS n,
    stddev_samp((pred - y) / y) OVER (PARTITION BY age) AS sd FROM sm_test) b ON a.age = b.age
  GROUP BY a.row_id, a.age)""")
def a14(spark, sf):
    pe = fr.linear_test_frame(spark, sf).select("row_id", "age", S.signed_pe("pred", "y").alias("pe"))
    return DG.density_by_group(pe, "age", "pe").select("row_id", "age", r("density"), r("scaled"))


@query("m01_constant", "SELECT split, row_id, horizon, pred FROM preds WHERE model = 'F'")
def m01(spark, sf):
    return B.Constant().predict(fr.long_frame(spark, sf)).select("split", "row_id", "horizon", "pred")


@query("m02_variable_k", "SELECT split, row_id, horizon, round(pred, 6) AS pred FROM preds WHERE model = 'Variable k'")
def m02(spark, sf):
    frame = fr.long_frame(spark, sf)
    return B.VariableK().fit(fr.train_rows(frame)).predict(frame).select("split", "row_id", "horizon", r("pred"))


@query("m03_plus_k", """
SELECT split, row_id, horizon, round(base + horizon * k, 5) AS pred FROM long CROSS JOIN (
  SELECT min(k0 + g0 / -slope0) AS k FROM (
    SELECT k, lag(k) OVER w AS k0, lag(g) OVER w AS g0, lag(slope) OVER w AS slope0, g FROM (
      SELECT k, slope, (SELECT sum(horizon) FROM long WHERE split = 'train')
        + coalesce(sum(slope_before * (k - kp)) OVER (ORDER BY k), 0) AS g
      FROM (SELECT k, slope, lag(slope) OVER (ORDER BY k) AS slope_before, lag(k) OVER (ORDER BY k) AS kp FROM (
        SELECT k, sum(sum(ds)) OVER (ORDER BY k) AS slope FROM (
          SELECT (y - base - 1) / horizon AS k, -horizon * horizon::DOUBLE AS ds FROM long WHERE split = 'train'
          UNION ALL SELECT (y - base + 1) / horizon, horizon * horizon::DOUBLE FROM long WHERE split = 'train')
        GROUP BY k)))
    WINDOW w AS (ORDER BY k))
  WHERE g <= 0 AND g0 > 0)""")
def m03(spark, sf):
    frame = fr.long_frame(spark, sf)
    return B.PlusK().fit(fr.train_rows(frame)).predict(frame).select("split", "row_id", "horizon", r("pred", digits=5))


@query("m04_simple_linear", "SELECT split, row_id, horizon, round(pred, 6) AS pred FROM preds WHERE model = 'SM'")
def m04(spark, sf):
    frame = fr.long_frame(spark, sf)
    return B.SimpleLinear().fit(fr.train_rows(frame)).predict(frame).select("split", "row_id", "horizon", r("pred"))


@query("t01_largest", """
SELECT model, split, horizon, row_id, err FROM (SELECT *, row_number() OVER (
  PARTITION BY model, split, horizon ORDER BY err DESC, row_id) AS k
  FROM (SELECT model, split, horizon, row_id, abs(pred - y) AS err FROM scored WHERE model = 'F')) WHERE k <= 10""")
def t01(spark, sf):
    frame = fr.long_frame(spark, sf).select(
        F.lit("F").alias("model"), "split", "horizon", "row_id", F.abs(F.col("base") - F.col("y")).alias("err"))
    return K.largest(frame, 10, "err", ["model", "split", "horizon"])


@query("t02_smallest", """
SELECT model, split, horizon, row_id, err FROM (SELECT *, row_number() OVER (
  PARTITION BY model, split, horizon ORDER BY err, row_id) AS k
  FROM (SELECT model, split, horizon, row_id, abs(pred - y) AS err FROM scored WHERE model = 'F')) WHERE k <= 10""")
def t02(spark, sf):
    frame = fr.long_frame(spark, sf).select(
        F.lit("F").alias("model"), "split", "horizon", "row_id", F.abs(F.col("base") - F.col("y")).alias("err"))
    return K.smallest(frame, 10, "err", ["model", "split", "horizon"])


@query("t03_argmax_row", """
SELECT model, split, horizon, arg_max(row_id, row((pred - y) ** 2, -row_id)) AS row_id, round(max((pred - y) ** 2), 6) AS err
FROM scored GROUP BY model, split, horizon""")
def t03(spark, sf):
    return M.worst_rows(fr.scored_frame(spark, sf)).select("model", "split", "horizon", "row_id", r("err"))


@query("t04_pooled_outliers", """
SELECT DISTINCT split, row_id FROM (
  SELECT split, arg_max(row_id, row((pred - y) ** 2, -row_id)) AS row_id FROM scored GROUP BY model, split, horizon)""")
def t04(spark, sf):
    return M.pooled_outliers(fr.scored_frame(spark, sf))


@query("t05_best_by_mape", """
SELECT model, split, horizon, round(mape, 6) AS mape FROM mape_tab
WHERE split = 'valid' AND horizon = 10 AND model IN ('SM', 'Variable k') ORDER BY mape LIMIT 1""")
def t05(spark, sf):
    best = M.best_model(M.mape(fr.scored_frame(spark, sf)), "mape", 10, False, ["SM", "Variable k"])
    return best.select("model", "split", "horizon", r("mape"))


@query("t06_best_by_pa_r_squared", """
SELECT model, split, horizon, round(pa_rsq, 6) AS pa_rsq FROM rsq_tab
WHERE split = 'valid' AND horizon = 10 AND model IN ('SM', 'Variable k') ORDER BY pa_rsq DESC LIMIT 1""")
def t06(spark, sf):
    best = M.best_model(M.r_squared(fr.scored_frame(spark, sf)), "pa_rsq", 10, True, ["SM", "Variable k"])
    return best.select("model", "split", "horizon", r("pa_rsq"))


@query("t07_group_values", "SELECT DISTINCT base FROM ent ORDER BY base")
def t07(spark, sf):
    return DG.group_values(fr.entities(spark, sf), "base")


@query("t08_model_ranking", """
SELECT split, model, round(mape, 6) AS mape, CAST(row_number() OVER (PARTITION BY split ORDER BY mape, model) AS INT) AS place
FROM mape_tab WHERE horizon = 10""")
def t08(spark, sf):
    ranked = M.model_ranking(M.mape(fr.scored_frame(spark, sf)), "mape", 10)
    return ranked.select("split", "model", r("mape"), "place")


@query("u01_user_model", """
SELECT split, row_id, horizon, round(base + horizon * g, 6) AS pred FROM long CROSS JOIN
  (SELECT avg((y - base) / horizon) AS g FROM long WHERE split = 'train')""")
def u01(spark, sf):
    class MeanGrowth:
        name = "mean growth"

        def fit(self, train):
            self.g = train.agg(F.avg((F.col("y") - F.col("base")) / F.col("horizon")).alias("_g")).withColumn("_one", F.lit(1))
            return self

        def predict(self, frame, out="pred"):
            both = frame.withColumn("_one", F.lit(1)).join(F.broadcast(self.g), "_one")
            return both.withColumn(out, F.col("base") + F.col("horizon") * F.col("_g")).drop("_one", "_g")

    frame = fr.long_frame(spark, sf)
    preds = B.predict_all(frame, [MeanGrowth().fit(fr.train_rows(frame))])
    return preds.select("split", "row_id", "horizon", r("pred"))
