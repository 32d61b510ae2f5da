"""Queries over fitted forecasters, their kernels and the whole comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from growthcast.features import tables as FT
from growthcast.functions import scalars as S, special as sp
from growthcast.models import baselines as B, rpp as RP
from growthcast.models.lasso import Lasso
from growthcast.models.trees import SEARCH, GradientBoost, MapeEvaluator, MedianBoost, RandomForest, grid_scores, label_of, options_of, staged_search
from growthcast.operators import metrics as M, reshape as R
from growthcast.operators.split import contiguous_folds
from growthcast.operators.standardise import moments
from growthcast.plans import compare as CM, fixture as fx, frames as fr
from growthcast.plans.queries_metrics import r
from growthcast.plans.registry import cte, query
from growthcast.session import materialise

def model_table(spark, sf):
    """Split entities with all features of papers, their authors and venues, written once."""
    feats = FT.paper_table(fx.authorship(spark, sf), fx.papers(spark, sf), fx.venues(spark, sf), fx.QUARTERS).withColumnRenamed("pid", "row_id")
    return materialise(fr.split_wide(spark, sf).join(feats, "row_id"), "wide")


def features_of(wide):
    """Names of the features in ``model_table``: what isn't a key, role, series or response."""
    other = {"row_id", "split", "inc", "delta_1", *CM.ROLE_COLUMNS}
    return [c for c in wide.columns if c not in other and not c.startswith("y_")]


def facts(wide, preds, start=None):
    """What SQL can state of a learned forecaster: rows per split and horizon, none below the base, and a MAPE below the constant's.

    The constant is the base or, if ``start`` gives a number for each horizon, that number where it is above the base.
    """
    kept = wide.select("row_id", "base", *[f"y_{h}" for h in range(1, 11)])
    scored = R.score_against(preds, R.stack_horizons(kept).select("row_id", "horizon", "base", "y"), ["row_id", "horizon"])
    constant = F.col("base") if start is None else F.greatest("base", F.element_at(F.array(*[F.lit(x) for x in start]), F.col("horizon").cast("int")))
    return scored.groupBy("model", "split", "horizon").agg(
        F.count("*").alias("n_rows"), (F.count_if(F.coalesce(F.col("pred"), F.lit(-1.0)) < F.col("base") - 1e-9) == 0).alias("none_below_base"),
        (F.avg(S.ape("pred", "y")) < F.avg(S.ape(constant, "y"))).alias("better_than_constant"))


def fact_sql(*models: str) -> str:
    """The same from the tables."""
    return f"""
SELECT m.model, split, horizon, count(*) AS n_rows, true AS none_below_base, true AS better_than_constant
FROM truth CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in models)}) m(model) GROUP BY ALL"""


def train_of(wide):
    return wide.where(F.col("split") == "train")


# ---- special functions and the point process at its starting state

def _cdf(z: str) -> str:
    """Normal cdf in SQL: power series near 0, continued fraction in the tails."""
    a = f"abs({z})"
    frac = a
    for k in range(50, 0, -1):
        frac = f"({a} + {k}e0 / {frac})"
    tail = f"exp(-0.5e0 * {a} * {a}) / sqrt(2 * pi()) / {frac}"
    series = (f"list_sum(list_transform(range(0, 60), lambda k: exp((2 * k + 1) * ln(greatest({a}, 1e-300)) "
              f"- (k + 1) * ln(2e0) - lgamma(k + 1.5e0) + 0.5e0 * ln(pi()))))")
    centre = f"exp(-0.5e0 * {a} * {a}) / sqrt(2 * pi()) * {series}"
    return (f"CASE WHEN {a} >= 3 THEN CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END "
            f"WHEN {z} < 0 THEN 0.5e0 - {centre} ELSE 0.5e0 + {centre} END")


cte("st", """
SELECT row_id, n, len, alpha, 12e0 AS beta, ln(a) AS mu, sqrt(2e0) * sqrt(ln(mid / a)) AS sigma FROM (
  SELECT *, sqrt(mid ** 4 / (mid ** 2 + greatest(mid, 1e0))) AS a FROM (
    SELECT row_id, sum(inc)::DOUBLE AS n, max(t) AS len, 10e0 + sum(inc) FILTER (t = 1) AS alpha,
      (min(t) FILTER (inc <> 0) + max(t) FILTER (inc <> 0)) / 2e0 AS mid FROM series_all GROUP BY row_id))""")
cte("grid", f"""
SELECT *, {_cdf('z')} AS cdf, exp(-0.5e0 * z * z) / (sigma * sqrt(2 * pi())) AS pdf FROM (
  SELECT s.*, g.range AS t, (ln(g.range::DOUBLE) - mu) / sigma AS z FROM st s CROSS JOIN range(1, 27) g WHERE g.range <= len + 10)""")
cte("cells", """
SELECT *, cdf - coalesce(lag(cdf) OVER w, 0) AS mass, pdf - coalesce(lag(pdf) OVER w, 0) AS dpdf,
  z * pdf - coalesce(lag(z * pdf) OVER w, 0) AS dscaled FROM grid WINDOW w AS (PARTITION BY row_id ORDER BY t)""")
cte("hcells", """
SELECT c.*, s.inc AS h, 10 + (s.cum - s.inc)::DOUBLE AS c FROM cells c JOIN series_all s ON s.row_id = c.row_id AND s.t = c.t""")
cte("terms", """
SELECT row_id, n, alpha, beta, sum(c * mass) AS x, sum(CASE WHEN h > 0 THEN h * ln(mass) ELSE 0 END) AS logs,
  sum(h * ln(c)) AS hc, sum(lgamma(h + 1e0)) AS hf FROM hcells GROUP BY row_id, n, alpha, beta""")
cte("loglik", """
SELECT *, hc - hf + logs + alpha * ln(beta) - lgamma(alpha) + lgamma(alpha + n) - (alpha + n) * ln(beta + x) AS value FROM terms""")


def increments(spark, sf):
    return fr.fixture.paper_entities(spark, sf).select("row_id", F.col("inc").cast("array<double>").alias("inc"))


def at_start(spark, sf, kernel, schema):
    """Run a kernel at alpha = 10 + first count, beta = 12 and the initial (mu, sigma)."""
    def run(pdf, hist):
        mu, sd = hist.start()
        return kernel(pdf["row_id"].to_numpy(), hist, 10.0 + hist.h[:, 0], np.full(len(mu), 12.0), mu, sd)

    return RP.map_histories(increments(spark, sf), run, schema)


@query("x03_lognormal_mass", "SELECT row_id, t::BIGINT AS t, round(cdf, 7) AS cdf, round(mass, 7) AS mass, round(pdf, 7) AS pdf FROM cells WHERE t <= len")
def x03(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        z = (hist.log_t[None, 1:] - mu[:, None]) / sd[:, None]
        rows, pos = np.nonzero(hist.mask)
        return pd.DataFrame({"row_id": ids[rows], "t": pos + 1, "cdf": sp.normal_cdf(z)[rows, pos],
                             "mass": hist.masses(mu, sd)[rows, pos],
                             "pdf": sp.normal_pdf(hist.log_t[None, 1:], mu[:, None], sd[:, None])[rows, pos]})

    out = at_start(spark, sf, kernel, "row_id bigint, t bigint, cdf double, mass double, pdf double")
    return out.select("row_id", "t", r("cdf", digits=7), r("mass", digits=7), r("pdf", digits=7))


@query("w03_grid_differences", "SELECT row_id, t::BIGINT AS t, round(dpdf, 7) AS dpdf, round(dscaled, 7) AS dscaled FROM cells WHERE t <= len")
def w03(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        z = (hist.log_t[None, 1:] - mu[:, None]) / sd[:, None]
        pdf = sp.normal_pdf(hist.log_t[None, 1:], mu[:, None], sd[:, None])
        rows, pos = np.nonzero(hist.mask)
        d = [np.diff(v, axis=1, prepend=0.0)[rows, pos] for v in (pdf, z * pdf)]
        return pd.DataFrame({"row_id": ids[rows], "t": pos + 1, "dpdf": d[0], "dscaled": d[1]})

    out = at_start(spark, sf, kernel, "row_id bigint, t bigint, dpdf double, dscaled double")
    return out.select("row_id", "t", r("dpdf", digits=7), r("dscaled", digits=7))


cte("harmonic", """
SELECT k.range AS k, sum(1e0 / k.range) OVER (ORDER BY k.range) AS h
FROM range(1, (SELECT max(base)::BIGINT FROM ent_all)) k""")


@query("x04_gamma_functions", """
SELECT row_id, round(lgamma(base + 0.5e0), 6) AS log_gamma, round(coalesce(h, 0) - 0.5772156649015329e0, 6) AS digamma
FROM ent_all LEFT JOIN harmonic ON k = base - 1""")
def x04(spark, sf):
    def kernel(pdf, hist):
        return pd.DataFrame({"row_id": pdf["row_id"], "log_gamma": sp.lgamma(hist.n + 0.5), "digamma": sp.digamma(hist.n)})

    out = RP.map_histories(increments(spark, sf), kernel, "row_id bigint, log_gamma double, digamma double")
    return out.select("row_id", r("log_gamma"), r("digamma"))


@query("m09_log_likelihood", "SELECT row_id, round(value, 5) AS log_likelihood, round(x, 6) AS x FROM loglik")
def m09(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        x, _ = hist.sums(hist.masses(mu, sd))
        return pd.DataFrame({"row_id": ids, "log_likelihood": hist.log_likelihood(alpha, beta, mu, sd), "x": x})

    out = at_start(spark, sf, kernel, "row_id bigint, log_likelihood double, x double")
    return out.select("row_id", r("log_likelihood", digits=5), r("x"))


cte("harmonic_wide", """
SELECT k.range AS k, sum(1e0 / k.range) OVER (ORDER BY k.range) AS total
FROM range(1, (SELECT 2 * max(base)::BIGINT + 20 FROM ent_all)) k""")


@query("m11_gradients", """
SELECT h.row_id, round(max(ln(t.beta) - ln(t.beta + t.x) + up.total - lo.total), 6) AS by_alpha,
  round(max(t.alpha / t.beta - (t.alpha + t.n) / (t.beta + t.x)), 6) AS by_beta, round(max((t.alpha + t.n) / (t.beta + t.x)), 6) AS rate,
  round(sum(dpdf * ((t.alpha + t.n) / (t.beta + t.x) * c - CASE WHEN h > 0 THEN h / mass ELSE 0 END)), 4) AS by_mu,
  round(sum(dscaled * ((t.alpha + t.n) / (t.beta + t.x) * c - CASE WHEN h > 0 THEN h / mass ELSE 0 END)), 4) AS by_sd
FROM hcells h JOIN terms t ON t.row_id = h.row_id JOIN harmonic_wide up ON up.k = (t.alpha + t.n)::BIGINT - 1
  JOIN harmonic_wide lo ON lo.k = t.alpha::BIGINT - 1 GROUP BY h.row_id""")
def m11(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        x, _ = hist.sums(hist.masses(mu, sd))
        g_mu, g_sd = hist.gradient(alpha, beta, mu, sd)
        rate = (alpha + hist.n) / (beta + x)
        by_alpha = np.log(beta) - np.log(beta + x) + sp.digamma(alpha + hist.n) - sp.digamma(alpha)
        return pd.DataFrame({"row_id": ids, "by_alpha": by_alpha, "by_beta": alpha / beta - rate, "rate": rate, "by_mu": g_mu, "by_sd": g_sd})

    out = at_start(spark, sf, kernel, "row_id bigint, by_alpha double, by_beta double, rate double, by_mu double, by_sd double")
    return out.select("row_id", r("by_alpha"), r("by_beta"), r("rate"), r("by_mu", digits=4), r("by_sd", digits=4))


@query("m14_expected_counts", """
SELECT row_id, round((10 + n) * (1 + d1 * m1) - 10, 6) AS h1,
  round((10 + n) * (1 + (d1 + d2) * m1 + d1 * d2 * m2) - 10, 6) AS h2,
  round((10 + n) * (1 + (d1 + d2 + d3) * m1 + (d1 * d2 + d1 * d3 + d2 * d3) * m2 + d1 * d2 * d3 * m3) - 10, 6) AS h3
FROM (SELECT t.row_id, t.n, (alpha + n) / (beta + x) AS m1, (alpha + n) * (alpha + n + 1) / (beta + x) ** 2 AS m2,
    (alpha + n) * (alpha + n + 1) * (alpha + n + 2) / (beta + x) ** 3 AS m3, d1, d2, d3
  FROM terms t JOIN (SELECT row_id, max(mass) FILTER (t = len + 1) AS d1, max(mass) FILTER (t = len + 2) AS d2,
    max(mass) FILTER (t = len + 3) AS d3 FROM cells GROUP BY row_id) d ON d.row_id = t.row_id)""")
def m14a(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        x, _ = hist.sums(hist.masses(mu, sd))
        p = RP.expected_counts(alpha, beta, hist.n, x, RP.future_masses(hist, mu, sd, 3))
        return pd.DataFrame({"row_id": ids, "h1": p[:, 0], "h2": p[:, 1], "h3": p[:, 2]})

    out = at_start(spark, sf, kernel, "row_id bigint, h1 double, h2 double, h3 double")
    return out.select("row_id", r("h1"), r("h2"), r("h3"))


@query("m15_reported_loss", """
SELECT round(avg(-value), 6) AS neg_log_likelihood, round(0.1e0 * avg((alpha / beta) ** 2), 8) AS penalty,
  round(avg(-value) + 0.1e0 * avg((alpha / beta) ** 2), 6) AS loss FROM loglik""")
def m15(spark, sf):
    def kernel(ids, hist, alpha, beta, mu, sd):
        return pd.DataFrame({"nll": -hist.log_likelihood(alpha, beta, mu, sd), "alpha": alpha, "beta": beta})

    states = at_start(spark, sf, kernel, "nll double, alpha double, beta double")
    penalty = 0.1 * F.avg(F.pow(F.col("alpha") / F.col("beta"), 2))
    return states.agg(F.round(F.avg("nll"), 6).alias("neg_log_likelihood"), F.round(penalty, 8).alias("penalty"),
                      F.round(F.avg("nll") + penalty, 6).alias("loss"))


@query("f03_sampled_counts", """
SELECT row_id, round((10 + n) * (1 + d1 * m1) - 10, 6) AS h1, round((10 + n) * (1 + (d1 + d2) * m1 + d1 * d2 * m2) - 10, 6) AS h2,
  10 AS horizons_near
FROM (SELECT t.row_id, t.n, (alpha + n) / (beta + x) AS m1, (alpha + n) * (alpha + n + 1) / (beta + x) ** 2 AS m2, d1, d2
  FROM terms t JOIN (SELECT row_id, max(mass) FILTER (t = len + 1) AS d1, max(mass) FILTER (t = len + 2) AS d2 FROM cells GROUP BY row_id) d
  ON d.row_id = t.row_id)""")
def f03(spark, sf):
    """Exact expectations, and how many of the ten sampled horizons lie within five standard errors of them."""
    def kernel(ids, hist, alpha, beta, mu, sd):
        x, _ = hist.sums(hist.masses(mu, sd))
        future = RP.future_masses(hist, mu, sd, 10)
        exact = RP.expected_counts(alpha, beta, hist.n, x, future)
        drawn, error = RP.sampled_counts(ids, alpha, beta, hist.n, x, future)
        near = (np.abs(drawn - exact) <= 5 * error + 1e-9).sum(1)
        return pd.DataFrame({"row_id": ids, "h1": exact[:, 0], "h2": exact[:, 1], "horizons_near": near})

    out = at_start(spark, sf, kernel, "row_id bigint, h1 double, h2 double, horizons_near int")
    return out.select("row_id", r("h1"), r("h2"), "horizons_near")


def _lognormal_optima(spark, sf, kernel, schema):
    """The reference's descent and, from where it stops, the certified optimum of every entity."""
    def run(ids, hist, alpha, beta, mu, sd):
        found = RP.optimal_lognormal(hist, alpha, beta, *RP.fit_lognormal(hist, alpha, beta, mu.copy(), sd.copy(), RP.PREDICT_STEPS))
        return kernel(ids, hist, alpha, beta, mu, sd, found)

    return at_start(spark, sf, run, schema)


@query("m12_lognormal_fit", "SELECT row_id, true AS certified, true AS better_than_start, true AS in_bounds FROM ent_all")
def m12(spark, sf):
    """Per entity: no ascent direction is left within the bounds, by gradient and curvature, and the fit beats its start (which fails all that)."""
    def kernel(ids, hist, alpha, beta, mu, sd, found):
        start = hist.log_likelihood(alpha, beta, np.maximum(mu, RP.MU_MIN), np.maximum(sd, RP.SD_MIN))
        return pd.DataFrame({"row_id": ids, "certified": found.holds(hist.n), "better_than_start": hist.log_likelihood(alpha, beta, found.mu, found.sd) > start,
                             "in_bounds": (found.mu >= RP.MU_MIN) & (found.sd >= RP.SD_MIN)})

    return _lognormal_optima(spark, sf, kernel, "row_id bigint, certified boolean, better_than_start boolean, in_bounds boolean")


@query("m12_parameters")
def m12_parameters(spark, sf):
    """The parameters with their certificate."""
    def kernel(ids, hist, alpha, beta, mu, sd, found):
        return pd.DataFrame({"row_id": ids, **found._asdict(), "projected_gradient": found.projected(),
                             "log_likelihood": hist.log_likelihood(alpha, beta, found.mu, found.sd)})

    return _lognormal_optima(spark, sf, kernel, "row_id bigint, mu double, sd double, by_mu double, by_sd double, at_mu boolean, at_sd boolean, "
                             "curvature double, projected_gradient double, log_likelihood double")


def _layer_rows(spark, model):
    """One row for each input of the layer: its weights, the loss, what is left of the gradient, and whether the first weights were worse."""
    rows = [(model.name, i, float(a), float(b), float(model.loss), float(model.gradient), bool(model.certified), bool(model.loss < model.first_loss))
            for i, (a, b) in enumerate(model.weights)]
    return spark.createDataFrame(rows, "model string, input int, alpha_weight double, beta_weight double, loss double, gradient double, certified boolean, "
                                 "better_than_start boolean")


def bias_layer(spark, sf):
    train = materialise(fr.split_wide(spark, sf).where("split = 'train'").select("row_id", "inc"), "train")
    return _layer_rows(spark, RP.PointProcess(gamma=0.7, rounds=4).fit(train))


FACTS = ["model", "input", "certified", "better_than_start"]


@query("m13_layer_bias_only", "SELECT 'RPP' AS model, 0 AS input, true AS certified, true AS better_than_start")
def m13a(spark, sf):
    return bias_layer(spark, sf).select(FACTS)


@query("m13_layer_features", "SELECT 'RPPNet' AS model, range::INTEGER AS input, true AS certified, true AS better_than_start FROM range(64)")
def m13b(spark, sf):
    """63 features and the constant, 17 rounds."""
    wide = model_table(spark, sf)
    return _layer_rows(spark, RP.PointProcess(features_of(wide), gamma=0.1, rounds=17).fit(train_of(wide))).select(FACTS)


@query("m13_layer_weights")
def m13_weights(spark, sf):
    """Weights, loss and gradient of the layer without features."""
    return bias_layer(spark, sf)


@query("m14_rpp_prediction", fact_sql("RPP"))
def m14b(spark, sf):
    wide = materialise(fr.split_wide(spark, sf), "wide")
    return facts(wide, RP.PointProcess(gamma=0.7, rounds=4).fit(train_of(wide)).predict(wide))


# ---- linear and tree learners

@query("a16_column_moments", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({e}), 6) AS mean, round(CASE WHEN stddev_pop({e}) = 0 THEN 1 ELSE stddev_pop({e}) END, 6) AS sd FROM paper"
    for c, e in (("paper_citations", "base"), ("paper_key_citations", "kbase"), ("paper_citations_delta_0", "d0"),
                 ("paper_age", "(15 - p0 + 1)"))))
def a16(spark, sf):
    own = FT.paper_own_features(fx.papers(spark, sf), fx.venues(spark, sf), fx.QUARTERS)
    return moments(own, ["paper_citations", "paper_key_citations", "paper_citations_delta_0", "paper_age"]).select(
        "column", r("mean"), r("sd"))


@query("m05_lasso", fact_sql("LAS"))
def m05(spark, sf):
    wide = model_table(spark, sf)
    return facts(wide, Lasso(features_of(wide)).fit(train_of(wide)).predict(wide))


@query("m06_random_forest", fact_sql("RF"))
def m06(spark, sf):
    wide = model_table(spark, sf)
    return facts(wide, RandomForest(features_of(wide)).fit(train_of(wide)).predict(wide))


@query("m07_gradient_boost", fact_sql("GBRT"))
def m07(spark, sf):
    wide = model_table(spark, sf)
    boost = GradientBoost(features_of(wide)).fit(train_of(wide))
    return facts(wide, boost.predict(wide), [m.start for m in boost.models])


cte("fs_own", """
SELECT t.row_id, horizon, y::DOUBLE AS y, [p.base::DOUBLE, p.kbase::DOUBLE, p.d0::DOUBLE, (15 - p.p0 + 1)::DOUBLE] AS x
FROM truth t JOIN paper p ON p.pid = t.row_id WHERE split = 'train'""")
cte("fs_vals", "SELECT f.range AS f, x[f.range + 1] AS v FROM fs_own, range(4) f WHERE horizon = 1")
cte("fs_edges", f"""
SELECT e.f, edge FROM (SELECT DISTINCT f, unnest(quantile_disc(v, [{', '.join(f'{i / 64!r}' for i in range(1, 64))}])) AS edge FROM fs_vals GROUP BY f) e
JOIN (SELECT f, max(v) AS top FROM fs_vals GROUP BY f) m ON m.f = e.f WHERE edge < top""")
cte("fs_signs", """
SELECT fs_own.horizon, start, y, x, sign(y - start)::DOUBLE AS g
FROM fs_own JOIN (SELECT horizon, quantile_disc(y, 0.5) AS start FROM fs_own GROUP BY horizon) s ON s.horizon = fs_own.horizon""")
cte("fs_sums", """
SELECT horizon, any_value(start) AS start, f, edge, count(*)::DOUBLE AS n, sum(g) AS s,
  count(*) FILTER (x[f + 1] <= edge)::DOUBLE AS ln, coalesce(sum(g) FILTER (x[f + 1] <= edge), 0) AS ls FROM fs_signs, fs_edges GROUP BY horizon, f, edge""")
cte("fs_best", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ls ** 2 / ln + (s - ls) ** 2 / (n - ln) - s ** 2 / n DESC, f, edge) AS r
  FROM fs_sums WHERE ln >= 2 AND n - ln >= 2) WHERE r = 1""")


@query("m07_first_split", """
SELECT b.horizon::INTEGER AS horizon, any_value(b.start) AS start, any_value(b.f)::INTEGER AS feature, any_value(b.edge) AS threshold,
  quantile_disc(y - b.start, 0.5) FILTER (x[b.f + 1] <= b.edge) AS left_step, quantile_disc(y - b.start, 0.5) FILTER (x[b.f + 1] > b.edge) AS right_step
FROM fs_best b JOIN fs_signs g ON g.horizon = b.horizon GROUP BY b.horizon""")
def m07_first(spark, sf):
    """Start, best split on signs and median steps of every horizon's first tree, of all splits of four features."""
    names = ["paper_citations", "paper_key_citations", "paper_citations_delta_0", "paper_age"]
    own = FT.paper_own_features(fx.papers(spark, sf), fx.venues(spark, sf), fx.QUARTERS).withColumnRenamed("pid", "row_id")
    train = train_of(fr.split_wide(spark, sf)).join(own.select("row_id", *names), "row_id")
    models = MedianBoost(names, stages=1, depth=1).fit_all(materialise(train, "train"), [f"y_{h}" for h in range(1, 11)])
    rows = [(h, m.start, m.trees[0].feature[0], m.trees[0].threshold[0], m.trees[0].value[1], m.trees[0].value[2]) for h, m in enumerate(models, 1)]
    return spark.createDataFrame(rows, "horizon int, start double, feature int, threshold double, left_step double, right_step double")


@query("m08_staged_search", f"""
SELECT stage, params, fold, true AS better_than_constant FROM (VALUES {', '.join(f"({i}, '{label_of(o)}')" for i, grid in enumerate(SEARCH) for o in options_of(grid))}) p(stage, params),
  (VALUES (0), (1), (2), (3), (4)) f(fold)""")
def m08(spark, sf):
    """All options and folds; each beats the constant on its fold by cross-validated MAPE."""
    wide = model_table(spark, sf)
    train = train_of(wide)
    _, scores = staged_search(train, MedianBoost(features_of(wide)), "y_10")
    folds = contiguous_folds(train.select("row_id", "base", "y_10"), 5).groupBy("fold").agg((-F.avg(S.ape("base", "y_10"))).alias("constant"))
    return scores.join(folds, "fold").select("stage", "params", "fold", (F.col("score") > F.col("constant")).alias("better_than_constant"))


@query("m08_search_scores")
def m08_scores(spark, sf):
    """The scores themselves, on the entities' own four features."""
    names = ["base", "delta", "average", "age"]
    return staged_search(train_of(fr.split_wide(spark, sf)), MedianBoost(names), "y_10")[1]


KS = (0.2, 0.5, 0.8, 1.1)


@query("a17_grid_scores", f"""
SELECT params, round(avg(score), 6) AS mean_score, CAST(count(*) AS BIGINT) AS folds FROM (
  SELECT k.p AS params, fold, -avg(abs(base + 10 * k.v - y_10) / y_10) AS score FROM (
    SELECT base, y_10, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
    FROM (SELECT base, y_10, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM spl WHERE split = 'train'))
  CROSS JOIN (VALUES {', '.join(f"('k={k}', {k}e0)" for k in KS)}) k(p, v) GROUP BY k.p, fold) GROUP BY params""")
def a17(spark, sf):
    train = contiguous_folds(fr.split_wide(spark, sf).where("split = 'train'").select("row_id", "base", "y_10"), 5)
    grid = F.inline(F.array(*[F.struct(F.lit(f"k={k}").alias("params"), F.lit(k).alias("k")) for k in KS]))
    preds = train.select("fold", "base", F.col("y_10").alias("y"), grid).withColumn("pred", F.col("base") + 10 * F.col("k"))
    scores = M.mape(preds, ["params", "fold"]).select("params", "fold", (-F.col("mape")).alias("score"))
    return grid_scores(scores).select("params", r("mean_score"), "folds")


# ---- user hooks and the comparison

@query("u02_metric_evaluator", """
SELECT model, round(-avg(abs(pred - y) / y), 6) AS score FROM scored WHERE split = 'test' GROUP BY model""")
def u02(spark, sf):
    """The evaluator's metric as an aggregate: all models in one job."""
    test = fr.scored_frame(spark, sf).where(F.col("split") == "test")
    return MapeEvaluator().by(test, "model").select("model", r("score"))


@query("u04_entity_kernel", "SELECT row_id, round(sum(t * inc) / sum(inc)::DOUBLE, 6) AS mean_time FROM series_all GROUP BY row_id")
def u04(spark, sf):
    def kernel(pdf, hist):
        t = np.arange(1, hist.h.shape[1] + 1)
        return pd.DataFrame({"row_id": pdf["row_id"], "mean_time": hist.h @ t / hist.n})

    return RP.map_histories(increments(spark, sf), kernel, "row_id bigint, mean_time double").select("row_id", r("mean_time"))


@query("m16_comparison", """
SELECT 'mape' AS metric, model, split, horizon, round(mape, 6) AS value, round(se, 6) AS se FROM mape_tab
UNION ALL SELECT 'rsq', model, split, horizon, round(rsq, 6), NULL FROM rsq_tab
UNION ALL SELECT 'pa_rsq', model, split, horizon, round(pa_rsq, 6), NULL FROM rsq_tab""")
def m16(spark, sf):
    wide = materialise(fr.split_wide(spark, sf), "wide")
    models = [CM.OnHorizons(m) for m in (B.Constant(), B.SimpleLinear(), B.VariableK())]
    done = CM.compare(wide, models, focus="SM")
    return done.metrics.select("metric", "model", "split", "horizon", r("value"), r("se"))


@query("m16_all_models")
def m16_all(spark, sf):
    wide = model_table(spark, sf)
    return CM.compare(wide, CM.standard_models(features_of(wide), train_of(wide), True)).metrics
