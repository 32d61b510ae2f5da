import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthcast.functions import special as sp
from growthcast.models import baselines as B, lasso as LA, rpp as RP
from growthcast.models.trees import GradientBoost, MedianBoost, RandomForest, staged_search
from growthcast.operators.metrics import mape
from growthcast.sources.stored import Run


def _wide(spark, n=400, horizons=2, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base, delta, noise = rng.randint(5, 40), rng.randint(0, 6), rng.gauss(0, 1)
        ys = [base + h * (0.5 * delta + 0.05 * base) + abs(rng.gauss(0, 0.5)) for h in range(1, horizons + 1)]
        split = "test" if i % 5 == 0 else "train"
        rows.append((i, split, float(base), float(delta), base / 10.0, 5.0, noise, 3.0, [1, delta, base - 1 - delta], *ys))
    cols = "row_id bigint, split string, base double, delta double, average double, age double, noise double, flat double, inc array<int>"
    return spark.createDataFrame(rows, cols + "".join(f", y_{h} double" for h in range(1, horizons + 1)))


@pytest.fixture(scope="module")
def wide(spark):
    return _wide(spark).persist()


def _train(df):
    return df.where("split = 'train'")


def _long(wide):
    from growthcast.operators.reshape import stack_horizons
    return stack_horizons(wide.drop("inc"))


def test_linear_models_equal_least_squares(spark, wide):
    long = _long(wide)
    pdf = _train(long).toPandas()
    sm = {r.horizon: r for r in B.SimpleLinear().fit(_train(long)).params.collect()}
    for h, g in pdf.groupby("horizon"):
        a = np.column_stack([np.ones(len(g)), g.base, g.delta])
        want = np.linalg.lstsq(a, g.y.to_numpy(), rcond=None)[0]
        assert np.allclose([sm[h].b0, sm[h].b1, sm[h].b2], want, atol=1e-8)
    vk = B.VariableK().fit(_train(long)).params.first()
    a = np.column_stack([np.ones(len(pdf)), pdf.base, pdf.horizon * pdf.average])
    assert np.allclose([vk.b0, vk.b1, vk.b2], np.linalg.lstsq(a, pdf.y.to_numpy(), rcond=None)[0], atol=1e-8)


def test_singular_regressors(spark):
    rows = [(i, 1, float(i % 7), float(i % 7), float(2 * (i % 7) + 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id int, horizon int, base double, delta double, y double")
    p = B.SimpleLinear().fit(df).params.first()
    assert np.allclose([p.b0, p.b1, p.b2], [1.0, 1.0, 1.0], atol=1e-9)
    p = B.SimpleLinear().fit(df.withColumn("base", F.lit(4.0)).withColumn("delta", F.lit(2.0))).params.first()
    assert (p.b1, p.b2) == (0.0, 0.0) and np.isclose(p.b0, df.agg(F.avg("y")).first()[0])


def test_huber_slope_is_a_sign_change(spark, wide):
    long = _train(_long(wide))
    k = B.huber_slope(long)
    hist = long.groupBy("horizon", (F.col("y") - F.col("base")).alias("d")).agg(F.count("*").alias("n"))
    left, mid, right = B.huber_score(hist, [k - 1e-4, k, k + 1e-4])
    assert left > 0 > right and abs(mid) < 1e-3
    assert B.PlusK(k=0.25).fit(long).k == 0.25


def test_clamp_and_coverage(spark, wide):
    long = _long(wide)
    out = B.predict_all(long, [B.Constant(), B.SimpleLinear().fit(_train(long))])
    assert out.count() == 2 * long.count()
    assert out.where(F.col("pred") < F.col("base")).isEmpty()


def test_lasso_satisfies_optimality(spark, wide):
    feats = ["base", "delta", "average", "noise", "flat"]
    model = LA.Lasso(feats, horizons=2).fit(_train(wide))
    pdf = _train(wide).orderBy("row_id").toPandas()
    x = pdf[feats].to_numpy(float)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd == 0, 1.0, sd)
    for row in model.params:
        y = pdf[f"y_{row['horizon']}"].to_numpy()
        w = np.array(row["coef"])
        grad = z.T @ (y - row["intercept"] - z @ w) / len(y)
        assert np.all(np.abs(grad) <= row["alpha"] * (1 + 1e-3) + 1e-6)
        on = w != 0
        assert np.allclose(grad[on], row["alpha"] * np.sign(w[on]), atol=1e-3 * row["alpha"] + 1e-6)
        # cross-validated choice, from scratch
        top = np.max(np.abs(z.T @ (y - y.mean()) / len(y)))
        alphas = np.geomspace(top, 1e-3 * top, 100)
        cuts = np.array_split(np.arange(len(y)), 10)
        errs = []
        for cut in cuts:
            tr = np.setdiff1d(np.arange(len(y)), cut)
            zc, yc = z[tr] - z[tr].mean(0), y[tr] - y[tr].mean()
            path = LA.descend((zc.T @ zc / len(tr))[None], (zc.T @ yc / len(tr))[None], alphas, 1e-7)[0]
            errs.append([np.mean((y[cut] - y[tr].mean() - (z[cut] - z[tr].mean(0)) @ b) ** 2) for b in path])
        assert np.isclose(alphas[np.argmin(np.mean(errs, 0))], row["alpha"])
    assert model.predict(wide).count() == 2 * wide.count()


def test_trees_learn(spark, wide):
    feats = ["base", "delta", "noise"]
    truth = _long(wide)
    base = truth.withColumn("pred", F.col("base")).withColumn("model", F.lit("F"))
    score = lambda p: mape(p.join(truth, ["row_id", "split", "horizon"]).where("split = 'train'"), ["model"]).first().mape
    flat = mape(base.where("split = 'train'"), ["model"]).first().mape
    rf = RandomForest(feats, 2, trees=60, min_leaf=5, max_depth=6).fit(_train(wide)).predict(wide)
    gb = GradientBoost(feats, 2, MedianBoost(feats, stages=25, rate=0.3)).fit(_train(wide)).predict(wide)
    assert score(rf) < flat and score(gb) < flat
    for p in (rf, gb):
        assert p.join(wide.select("row_id", "base"), "row_id").where(F.col("pred") < F.col("base") - 1e-9).isEmpty()


def test_boosting_takes_median_steps(spark, wide):
    rows = _train(wide)
    boost = MedianBoost(["base", "delta"], stages=2, depth=2).fit(rows, "y_1")
    pdf = rows.select("y_1", boost.prediction().alias("f"), *[F.expr(tree.leaf(["base", "delta"])).alias(f"l{i}") for i, tree in enumerate(boost.trees)]).toPandas()
    f = np.full(len(pdf), np.sort(pdf.y_1)[(len(pdf) - 1) // 2])
    for i in range(2):
        r = pdf.y_1 - f
        step = r.groupby(pdf[f"l{i}"]).transform(lambda v: np.sort(v)[(len(v) - 1) // 2])
        f = f + 0.1 * step
    assert np.allclose(f, pdf.f)


def test_many_stages_score_without_nulls(spark, wide):
    from growthcast.models.trees import FlatTree
    tree = FlatTree([0, -1, 1, -1, -1], [5.0, 0, 2.0, 0, 0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 1.0, 0.0, -2.0, 3.0])
    model = GradientBoost(["base", "delta"], 2, models=[MedianBoost(["base", "delta"], start=float(h), trees=[tree] * 500) for h in (1, 2)])
    for r in model.predict(wide).join(wide.select("row_id", "base", "delta"), "row_id").collect():
        leaf = 1.0 if r.base <= 5 else -2.0 if r.delta <= 2 else 3.0
        assert np.isclose(r.pred, max(r.base, r.horizon + 500 * 0.1 * leaf))


def test_staged_search(spark, wide):
    best, scores = staged_search(_train(wide), MedianBoost(["base", "delta"], stages=1), "y_1",
                                 ({"depth": [1, 3]}, {"min_leaf": [1, 2]}), folds=2)
    rows = scores.collect()
    assert len(rows) == 8 and all(r.score < 0 for r in rows)
    mean = {d: np.mean([r.score for r in rows if r.params == f"depth={d}"]) for d in (1, 3)}
    assert best.depth == max(mean, key=mean.get)


def test_special_functions():
    x = np.linspace(-6, 25, 5001)
    assert np.max(np.abs(sp.erfc(x) / np.array([math.erfc(v) for v in x]) - 1)) < 1e-12
    y = np.linspace(0.01, 50, 3001)
    assert np.allclose(sp.lgamma(y), [math.lgamma(v) for v in y], rtol=1e-12, atol=1e-12)
    assert np.isclose(sp.digamma(np.array([1.0]))[0], -0.5772156649015329)
    assert np.isclose(sp.trigamma(np.array([1.0]))[0], math.pi ** 2 / 6)
    deep = sp.interval_mass(np.array([[8.0, 8.1, 9.0], [-9.0, -8.1, -8.0]]))
    assert np.allclose(deep[0], deep[1][::-1], rtol=1e-10) and (deep > 0).all()


def _histories(n=60, seed=2):
    rng = np.random.default_rng(seed)
    rows = [rng.poisson(rng.uniform(0, 4), rng.integers(1, 17)) for _ in range(n)]
    rows += [np.zeros(5, int), np.array([0, 0, 0, 9]), np.array([4]), np.array([0])]
    return rows


def test_likelihood_and_gradient():
    rows = _histories()
    hist = RP.Histories(rows)
    b = len(rows)
    rng = np.random.default_rng(0)
    alpha, beta, mu, sd = rng.uniform(1, 12, b), rng.uniform(1, 12, b), rng.uniform(0, 2, b), rng.uniform(0.6, 1.5, b)
    ll = hist.log_likelihood(alpha, beta, mu, sd)
    for i, h in enumerate(rows):
        cum, total, x = 10.0, 0.0, 0.0
        cdf = lambda t: 0.0 if t == 0 else 0.5 * math.erfc(-(math.log(t) - mu[i]) / sd[i] / math.sqrt(2))
        for t, k in enumerate(h, 1):
            d = cdf(t) - cdf(t - 1)
            total += k * math.log(cum) - math.lgamma(k + 1) + (k * math.log(d) if k else 0.0)
            x += cum * d
            cum += k
        n = sum(h)
        total += alpha[i] * math.log(beta[i]) - math.lgamma(alpha[i]) + math.lgamma(alpha[i] + n) - (alpha[i] + n) * math.log(beta[i] + x)
        assert math.isclose(total, ll[i], rel_tol=1e-9, abs_tol=1e-9)
    g_mu, g_sd = hist.gradient(alpha, beta, mu, sd)
    e = 1e-6
    f = lambda m, s: hist.log_likelihood(alpha, beta, m, s)
    assert np.allclose(g_mu, (f(mu + e, sd) - f(mu - e, sd)) / (2 * e), rtol=1e-4, atol=1e-4)
    assert np.allclose(g_sd, (f(mu, sd + e) - f(mu, sd - e)) / (2 * e), rtol=1e-4, atol=1e-4)


def test_lognormal_fit_improves_within_bounds():
    hist = RP.Histories(_histories())
    b = len(hist.n)
    alpha, beta = np.full(b, 10.0), np.full(b, 12.0)
    mu0, sd0 = hist.start()
    before = hist.log_likelihood(alpha, beta, np.maximum(mu0, -0.99), np.maximum(sd0, 0.51))
    mu, sd = RP.fit_lognormal(hist, alpha, beta, mu0.copy(), sd0.copy(), 500)
    after = hist.log_likelihood(alpha, beta, mu, sd)
    assert (after >= before - 1e-9).all() and (mu >= -1).all() and (sd >= 0.5).all()
    # batch composition does not matter
    for i in (0, 7, b - 1):
        one = RP.Histories([hist.h[i][hist.mask[i]]])
        m, s = RP.fit_lognormal(one, alpha[:1], beta[:1], mu0[i:i + 1].copy(), sd0[i:i + 1].copy(), 500)
        assert np.isclose(m[0], mu[i]) and np.isclose(s[0], sd[i])


def test_expected_counts_match_sampling():
    hist = RP.Histories(_histories(8))
    b = len(hist.n)
    alpha, beta = np.full(b, 5.0), np.full(b, 9.0)
    mu, sd = hist.start()
    x, _ = hist.sums(hist.masses(mu, sd))
    future = RP.future_masses(hist, mu, sd, 10)
    exact = RP.expected_counts(alpha, beta, hist.n, x, future)
    drawn, _ = RP.sampled_counts(range(b), alpha, beta, hist.n, x, future, draws=200_000)
    assert np.allclose(exact, drawn, rtol=2e-2)
    assert (np.diff(exact, axis=1) >= -1e-12).all() and (exact[:, 0] >= hist.n - 1e-9).all()
    again, error = RP.sampled_counts(range(b), alpha, beta, hist.n, x, future)
    assert (again == RP.sampled_counts(range(b), alpha, beta, hist.n, x, future)[0]).all()
    assert (np.abs(again - exact) <= 5 * error).all()


def test_layer_objective_derivatives():
    rng = np.random.default_rng(3)
    z = np.column_stack([rng.normal(size=(50, 2)), np.ones(50)])
    n, x, w = rng.integers(0, 20, 50).astype(float), rng.uniform(1, 30, 50), rng.normal(size=(3, 2))
    loss, gu, gv, *_ = RP._objective(w, 0.3, z, n, x)
    grad = np.column_stack([z.T @ gu, z.T @ gv])
    for i in range(3):
        for j in range(2):
            d = np.zeros_like(w)
            d[i, j] = 1e-6
            num = (RP._objective(w + d, 0.3, z, n, x)[0].sum() - RP._objective(w - d, 0.3, z, n, x)[0].sum()) / 2e-6
            assert math.isclose(num, grad[i, j], rel_tol=1e-5, abs_tol=1e-5)


@pytest.mark.parametrize("features", [(), ("delta", "noise")])
def test_point_process_fit_and_predict(spark, wide, features):
    few = wide.where("row_id < 120")
    start = RP.PointProcess(features, 2, gamma=0.1, rounds=1).fit(_train(few))
    more = RP.PointProcess(features, 2, gamma=0.1, rounds=2).fit(_train(few))
    assert np.isfinite(start.loss) and np.isfinite(more.loss)
    out = more.predict(few)
    assert out.count() == 240 and out.select("model").first().model == ("RPPNet" if features else "RPP")
    assert out.join(few.select("row_id", "base"), "row_id").where(F.col("pred") < F.col("base") - 1e-6).isEmpty()


def test_layer_certificate(spark, wide):
    """The gradient that is said to be left is the loss's, and small; entities that grow alike have a finite best."""
    alike = spark.createDataFrame([(i, [2, 2, 2, 2]) for i in range(40)], "row_id bigint, inc array<int>")
    for train, features in ((alike, ()), (_train(wide.where("row_id < 200")), ["delta", "noise"])):
        model = RP.PointProcess(features, 2, gamma=0.3, rounds=2)
        fitted, states = model.first_states(train)
        states = RP.fitted_states(states, model.first_weights(), RP.FIT_STEPS).checkpoint()
        fit = RP.fit_layer(states, model.first_weights(), 0.3)
        pdf = states.toPandas()
        z, n, x = np.array(pdf.z.tolist()), pdf.n.to_numpy(), pdf.x.to_numpy()

        def loss(w):
            a, b = RP.layer(z, w)
            return np.mean(-RP.gamma_terms(a, b, n, x) + 0.3 * (a / b) ** 2) + RP.RIDGE / 2 * (w ** 2).sum()

        assert np.isclose(loss(fit.weights), fit.loss) and loss(fit.weights) < loss(model.first_weights())
        grad = np.zeros_like(fit.weights)
        for i in np.ndindex(*grad.shape):
            step = np.zeros_like(grad)
            step[i] = 1e-5
            grad[i] = (loss(fit.weights + step) - loss(fit.weights - step)) / 2e-5
        assert fit.certified and fit.gradient <= 1e-5 * (1 + abs(fit.loss))
        assert np.linalg.norm(grad) < 1e-4 and np.isfinite(fit.weights).all()
        assert not RP.fit_layer(states, model.first_weights(), 0.3, passes=0).certified


def test_lognormal_certificate():
    """Optima beat a fine grid around them; a fit that stays at its start has no certificate."""
    rows = [r for r in _histories(80) if r.sum() >= 4]
    hist = RP.Histories(rows)
    mu, sd = hist.start()
    alpha, beta = 10 + hist.h[:, 0], np.full(len(mu), 12.0)
    found = RP.optimal_lognormal(hist, alpha, beta, mu.copy(), sd.copy())
    assert found.holds(hist.n).mean() > 0.95
    good = np.flatnonzero(found.holds(hist.n))
    part = hist.take(good)
    best = part.log_likelihood(alpha[good], beta[good], found.mu[good], found.sd[good])
    for dm in (-0.02, 0.0, 0.02):
        for ds in (-0.02, 0.0, 0.02):
            m, s = np.maximum(found.mu[good] + dm, RP.MU_MIN), np.maximum(found.sd[good] + ds, RP.SD_MIN)
            assert (part.log_likelihood(alpha[good], beta[good], m, s) <= best + 1e-7).all()
    idle = RP.optimal_lognormal(hist, alpha, beta, mu.copy(), sd.copy(), steps=0)
    assert idle.holds(hist.n).mean() < 0.2


def test_comparison_of_all_models(spark, wide):
    from growthcast.plans import compare as CM

    feats = ["base", "delta", "noise"]
    data = wide.withColumn("split", F.when(F.col("row_id") % 10 == 1, "valid").otherwise(F.col("split"))).persist()
    models = [CM.OnHorizons(B.PlusK()), CM.OnHorizons(B.SimpleLinear()), LA.Lasso(feats, 2),
              GradientBoost(feats, 2, MedianBoost(feats, stages=2)), RP.PointProcess((), 2, rounds=1)]
    done = CM.compare(data, models, horizons=2, trim=3)
    names = {"PK", "SM", "LAS", "GBRT", "RPP"}
    assert {r.model for r in done.metrics.select("model").distinct().collect()} == names
    assert done.predictions.count() == len(names) * 2 * data.count()
    best = done.best_by_mape.first()
    assert best.split == "valid" and best.horizon == 2 and best.model in names - {"PK", "SM"}
    assert done.best_by_pa_r_squared.count() == 1 and done.trimmed.count() == 2 * len(names)
    assert done.median_ape.first().model == "GBRT" and done.per_age.count() == 1 and done.labels.count() == 1
    assert done.density.count() == data.where("split = 'test'").count()


def test_kept_models_predict_alike(spark, wide):
    from growthcast.plans import compare as CM
    from growthcast.session import new_table_path

    run = Run(spark, new_table_path(spark, "models"), "paper-citation-5")
    feats = ["base", "delta", "noise"]
    few = wide.where("row_id < 150")
    models = [CM.OnHorizons(B.SimpleLinear()), CM.OnHorizons(B.VariableK()), LA.Lasso(feats, 2), RandomForest(feats, 2, trees=2, max_depth=3),
              GradientBoost(feats, 2, MedianBoost(feats, stages=2)), RP.PointProcess(("delta",), 2, rounds=1)]
    for m in models:
        first = CM.fit_or_load(m, _train(few), run).predict(few)
        again = CM.fit_or_load(m, _train(few).limit(0), run).predict(few)  # would fail if it had to train
        key = ["split", "row_id", "horizon"]
        both = first.join(again.withColumnRenamed("pred", "p2"), key)
        assert both.count() == first.count() and both.where(F.abs(F.col("pred") - F.col("p2")) > 1e-9).isEmpty(), m.name


def test_a_run_that_was_cut_goes_on(spark):
    """Stopped while a model is written, between model and manifest, and after some of the models."""
    from growthcast.config import PAPER_CITATION, YEARS
    from growthcast.session import new_table_path

    folder, fits = new_table_path(spark, "runs"), []
    identity = YEARS.run_id(PAPER_CITATION, "paper_citations:5")
    run = Run(spark, folder, identity)

    def save(model, path, stop=None):
        spark.range(model).write.parquet(f"{path}/part")
        if stop:
            raise RuntimeError(stop)

    def train():
        fits.append(1)
        return 3

    load = lambda path: spark.read.parquet(f"{path}/part").count()
    with pytest.raises(RuntimeError):
        run.model("M 1", load, train, lambda m, p: save(m, p, "cut"))
    commit, run.commit = run.commit, lambda *a: (_ for _ in ()).throw(RuntimeError("cut"))
    with pytest.raises(RuntimeError):
        run.model("M 1", load, train, save)
    run.commit = commit
    assert run.manifest("M_1") is None
    assert run.model("M 1", load, train, save) == 3 and len(fits) == 3
    assert Run(spark, folder, identity).model("M 1", load, train, save) == 3 and len(fits) == 3
    # another filter is another run
    other = Run(spark, folder, YEARS.run_id(PAPER_CITATION, "paper_citations:10"))
    assert other.folder != run.folder and other.model("M 1", load, train, save) == 3 and len(fits) == 4
    with pytest.raises(ValueError):
        Run(spark, folder, "")


def test_a_stopped_comparison_goes_on(spark, wide):
    from growthcast.plans import compare as CM
    from growthcast.session import new_table_path

    data = wide.withColumn("split", F.when(F.col("row_id") % 10 == 1, "valid").otherwise(F.col("split")))
    run, fits = Run(spark, new_table_path(spark, "runs"), "author-citation-5"), []

    class Counted(CM.OnHorizons):
        def fit(self, train):
            fits.append(self.name)
            if stop and self.name == stop[0]:
                raise RuntimeError("cut")
            return CM.OnHorizons.fit(self, train)

    models, stop = [Counted(B.SimpleLinear()), Counted(B.VariableK())], ["Variable k"]
    with pytest.raises(RuntimeError):
        CM.compare(data, models, horizons=2, focus="SM", run=run)
    stop.clear()
    done = CM.compare(data, models, horizons=2, focus="SM", run=run)
    assert fits == ["SM", "Variable k", "Variable k"]
    plain = CM.compare(data, models, horizons=2, focus="SM")
    rows = lambda c: sorted((r.metric, r.model, r.split, r.horizon, round(r.value, 9)) for r in c.metrics.collect())
    assert rows(done) == rows(plain)


def test_prepare_aligns_filters_and_splits(spark):
    from growthcast.config import PAPER_CITATION
    from growthcast.plans import compare as CM

    n = 100
    feats = spark.createDataFrame([(i, float(i % 20 + 1), 1.0, 0.5, 4.0) for i in range(n)],
                                  "row_id bigint, paper_citations double, paper_citations_delta_0 double, "
                                  "paper_mean_citations_per_year double, paper_age double")
    resp = spark.createDataFrame([(i, i + 30, i + 40, 7) for i in range(n)], "row_id bigint, Citation_in_1 int, citation_in_2 int, other int")
    hist = spark.createDataFrame([(i, [1, 3, 3]) for i in range(n)], "row_id bigint, hist array<int>")
    wide = CM.prepare(feats, resp, hist, PAPER_CITATION, "paper_citations:5")
    rows = wide.collect()
    assert len(rows) == 80 and all(r.paper_citations >= 5 and r.base == r.paper_citations for r in rows)
    assert all(r.y_1 == r.row_id + 30 and r.y_2 == r.row_id + 40 and list(r.inc) == [1, 2, 0] for r in rows)
    assert sorted((s, sum(r.split == s for r in rows)) for s in ("train", "valid", "test")) == [("test", 16), ("train", 56), ("valid", 8)]


def _table(spark, n=600, seed=4, horizons=2):
    """Entities with whole-number labels, ties, a constant, a null and a NaN feature."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = int(rng.integers(0, 40)), int(rng.integers(0, 5)), float(rng.normal())
        ys = [float(a + h * b + int(rng.integers(0, 4)) + 1) for h in range(1, horizons + 1)]
        rows.append((i, "train", float(a), float(b), c, 3.0, None if i % 7 == 0 else float(b * i), float("nan") if i % 11 == 0 else c * b, float(a), *ys))
    cols = "row_id bigint, split string, a double, b double, c double, flat double, gaps double, holes double, base double"
    return spark.createDataFrame(rows, cols + "".join(f", y_{h} double" for h in range(1, horizons + 1)))


FEATS = ["a", "b", "c", "flat", "gaps", "holes"]


def _plain_tree(x, target, weight, depth, min_leaf, min_split):
    """Leaves (as row sets) of a tree by trying every split of codes one after another."""
    n, s = weight.sum(), (weight * target).sum()
    best = (1e-9 * max(1.0, abs(s)), None)
    if depth > 0 and n >= min_split:
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= cut
                ln, ls = weight[left].sum(), (weight * target)[left].sum()
                if ln >= min_leaf and n - ln >= min_leaf:
                    gain = ls ** 2 / ln + (s - ls) ** 2 / (n - ln) - s ** 2 / n
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, left)
    if best[1] is None:
        return [np.arange(len(x))]
    out = []
    for side in (best[1], ~best[1]):
        at = np.flatnonzero(side)
        out += [at[r] for r in _plain_tree(x[at], target[at], weight[at], depth - 1, min_leaf, min_split)]
    return out


def _codes(spark, df):
    from growthcast.models import fitting
    data = fitting.training(df, FEATS, ["y_1", "y_2"], 64)
    return data, data.arrays()


def test_boosting_against_plain_python(spark):
    """Every stage: the best tree on signs by trying all splits, lower medians, a step of the rate."""
    df = _table(spark, 300)
    _, held = _codes(spark, df)
    boost = MedianBoost(FEATS, stages=6, depth=2, min_leaf=3, min_split=30).fit(df, "y_1")
    y = held.y[:, 0]
    f = np.full(len(y), np.sort(y)[(len(y) - 1) // 2])
    x = held.x.astype(int)
    for _ in range(6):
        rest = y - f
        for leaf in _plain_tree(x, np.sign(rest), np.ones(len(y)), 2, 3, 30):
            f[leaf] += 0.1 * np.sort(rest[leaf])[(len(leaf) - 1) // 2]
    got = {r.row_id: r.f for r in df.select("row_id", boost.prediction().alias("f")).collect()}
    assert np.allclose([got[i] for i in held.ids.tolist()], f)


def test_forest_against_plain_python(spark):
    """With all features tried, each tree's leaf means are those of plain splits on its bootstrap weights."""
    from growthcast.models import binned, fitting
    df = _table(spark, 200)
    data, held = _codes(spark, df)
    out = fitting.forest(data, 3, binned.Rule(1_000, 10), seed=5).collect()
    assert len(out) == 6
    raw = {r.row_id: r for r in df.collect()}
    x = np.array([[np.nan if raw[i][c] is None else raw[i][c] for c in FEATS] for i in held.ids.tolist()])
    for r in out:
        i = r.tree * 2 + r.horizon - 1
        w, y = binned.bootstrap(held.ids, i, 5), held.y[:, r.horizon - 1]
        rows = np.flatnonzero(w)
        pred = binned.FlatTree(*(r[c] for c in binned.FlatTree._fields)).score(x[rows])
        for leaf in _plain_tree(held.x[rows].astype(int), y[rows], w[rows], 1_000, 10, 2):
            assert np.allclose(pred[leaf], np.average(y[rows][leaf], weights=w[rows][leaf]))


@pytest.mark.parametrize("share,split", [(1.0, 2), (0.7, 25)])
def test_models_do_not_depend_on_where_rows_lie(spark, monkeypatch, share, split):
    """A table that isn't broadcast gives the same trees, from sums over tasks."""
    from growthcast.models import fitting
    df = _table(spark, 500).withColumn("fold", (F.col("row_id") % 3).cast("int")).repartition(5)
    boost = MedianBoost(FEATS, stages=4, depth=3, subsample=share, min_split=split)
    jobs = [boost.job(label, fold) for label in (0, 1) for fold in (None, 1)]
    near = fitting.training(df, FEATS, ["y_1", "y_2"], 64)
    monkeypatch.setattr(fitting, "LOCAL_BYTES", 0)
    far = fitting.training(df, FEATS, ["y_1", "y_2"], 64)
    assert near.small and not far.small
    for (s1, t1), (s2, t2) in zip(fitting.boosted(near, jobs), fitting.boosted(far, jobs), strict=True):
        assert s1 == s2 and len(t1) == len(t2) == 4
        for one, two in zip(t1, t2):
            assert one == two
    assert np.allclose(fitting.held_out_scores(near, [jobs[1], jobs[3]]), fitting.held_out_scores(far, [jobs[1], jobs[3]]))


def test_forests_do_not_depend_on_where_rows_lie(spark, monkeypatch):
    from growthcast.models import fitting
    df = _table(spark, 400).repartition(3)
    forest = RandomForest(FEATS, 2, trees=3, min_leaf=8)
    near = sorted(tuple(r) for r in forest.fit(df).predict(df).collect())
    monkeypatch.setattr(fitting, "LOCAL_BYTES", 0)
    monkeypatch.setattr(fitting, "SUBTREE_ROWS", 90)
    monkeypatch.setattr(fitting, "TREES_A_PASS", 4)
    far = sorted(tuple(r) for r in forest.fit(df).predict(df).collect())
    assert [r[:3] for r in near] == [r[:3] for r in far] and len(near) == 800
    assert np.allclose([r[3] for r in near], [r[3] for r in far])


def test_forest_scores_in_several_passes(spark, monkeypatch):
    from growthcast.models import trees as TR
    df = _table(spark, 200)
    model = RandomForest(FEATS, 2, trees=7, min_leaf=8).fit(df)
    one = sorted(tuple(r) for r in model.predict(df).collect())
    monkeypatch.setattr(TR, "NODES_A_PASS", 40)
    several = sorted(tuple(r) for r in model.predict(df).collect())
    assert [r[:3] for r in one] == [r[:3] for r in several] and np.allclose([r[3] for r in one], [r[3] for r in several])


def test_trees_of_empty_and_constant_tables(spark):
    df = _table(spark, 50)
    none = MedianBoost(FEATS, stages=3).fit(df.limit(0), "y_1")
    assert none.start == 0 and none.trees == []
    flat = df.withColumn("y_1", F.lit(7.0)).withColumn("y_2", F.lit(None).cast("double"))
    assert {r.pred for r in RandomForest(FEATS, 2, trees=2, min_leaf=5).fit(flat).predict(flat.withColumn("base", F.lit(0.0))).collect()} == {7.0, 0.0}
    one, two = MedianBoost(FEATS, stages=3).fit_all(flat, ["y_1", "y_2"])
    assert {r.f for r in flat.select(one.prediction().alias("f")).collect()} == {7.0} and two.trees == []


def test_search_takes_the_best_of_each_group(spark):
    from growthcast.models.trees import SEARCH
    best, scores = staged_search(_table(spark, 240), MedianBoost(FEATS, stages=3), "y_2")
    rows = scores.collect()
    assert len(rows) == (5 + 6 + 5) * 5 and all(r.score < 0 for r in rows)
    chosen = {"depth": best.depth, "min_split": best.min_split, "min_leaf": best.min_leaf, "subsample": best.subsample}
    for stage, grid in enumerate(SEARCH):
        mean = {}
        for r in rows:
            if r.stage == stage:
                mean.setdefault(r.params, []).append(r.score)
        top = max(mean, key=lambda p: np.mean(mean[p]))
        assert top == ",".join(f"{k}={chosen[k]}" for k in grid)


def test_growth_counts_no_more_rows_than_it_must(monkeypatch):
    from growthcast.models import binned as T
    seen, plain = [], T.histogram

    def counted(*args):
        seen.append(len(args[2]))
        return plain(*args)

    rng = np.random.default_rng(3)
    x, n = rng.integers(0, 16, (3_000, 5)).astype(np.uint8), 3_000
    target = np.sign(x[:, 0] - 7.3 + 3 * rng.normal(size=n) + x[:, 1] % 3)
    monkeypatch.setattr(T, "histogram", counted)
    exact, place = T.grow(x, None, target, None, T.Rule(3, 2, bins=16), 1)
    # the root, and the smaller of each two children of two levels
    assert sum(seen) <= 2 * n and len(exact.feature) == 15
    seen.clear()
    forest, leaf = T.grow(x, None, target, np.ones(n, np.int64), T.Rule(50, 200, features=2, bins=16), 1)
    sizes = np.bincount(leaf)
    assert sizes[sizes > 0].min() >= 200 and sum(seen) <= n * (1 + max(_depths(forest))) - sizes[(sizes > 0) & (sizes < 400)].sum()
    # sums that aren't whole are taken node by node and give the same splits
    broken, there = T.grow(x, None, target * (1 + 2.0 ** -40), None, T.Rule(3, 2, bins=16), 1)
    assert (broken.feature, broken.threshold) == (exact.feature, exact.threshold) and (there == place).all()
    assert np.allclose(broken.value, exact.value)


def _depths(tree):
    at = [0] * len(tree.feature)
    for i, f in enumerate(tree.feature):
        if f >= 0:
            at[tree.left[i]] = at[tree.right[i]] = at[i] + 1
    return at


def test_search_fits_equal_options_once(spark, monkeypatch):
    """A leaf of two rows makes 2, 3 and 4 the same smallest split, and each group has what the one before has chosen."""
    from growthcast.models import fitting
    from growthcast.operators.split import contiguous_folds
    df, fits, plain = _table(spark, 240), [], fitting.in_tasks

    def counted(spark, n, *args):
        fits.append(n)
        return plain(spark, n, *args)

    monkeypatch.setattr(fitting, "in_tasks", counted)
    _, scores = staged_search(df, MedianBoost(FEATS, stages=2), "y_2")
    rows = scores.collect()
    assert len(rows) == 80 and fits[:2] == [25, 15] and fits[2] in (20, 25)
    found = {(r.stage, r.params, r.fold): r.score for r in rows}
    assert all(found[1, f"min_split={s},min_leaf=2", f] == found[1, "min_split=2,min_leaf=2", f] for s in (3, 4) for f in range(5))
    # an option that was not fitted has the score that its own fit gives
    data = fitting.training(contiguous_folds(df, 5), FEATS, ["y_2"], 64)
    best = max(range(2, 7), key=lambda d: np.mean([found[0, f"depth={d}", f] for f in range(5)]))
    booster = MedianBoost(FEATS, stages=2, depth=best, min_split=4)
    assert fitting.held_out_scores(data, [booster.job(0, f) for f in range(5)]) == [found[1, "min_split=4,min_leaf=2", f] for f in range(5)]


def _whole_table(rng, n=4_000):
    """Codes of few and many values, a constant among them."""
    sizes = [64, 1, 3, 50, 7, 64, 2, 20]
    return np.column_stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)


@pytest.mark.parametrize("few", [0, 50_000])
def test_features_counted_together(monkeypatch, few):
    from growthcast.models import binned as T
    monkeypatch.setattr(T, "FEW_CODES", few)
    monkeypatch.setattr(T, "ROWS_TOGETHER", 300)
    rng = np.random.default_rng(8)
    x = _whole_table(rng)
    table, value = T.Together(x, 64), rng.integers(-2, 3, len(x)).astype(float)
    assert len(table.groups) < 6 and sorted(f for g in table.groups for f in g) == [0, 2, 3, 4, 5, 6, 7]
    for rows in (None, np.flatnonzero(rng.random(len(x)) < 0.3), np.arange(0)):
        own = x if rows is None else x[rows]
        part = value if rows is None else value[rows]
        assert (table.sums(value, rows) == [np.bincount(own[:, j], part, minlength=64) for j in range(x.shape[1])]).all()


@pytest.mark.parametrize("share,depth,without", [(1.0, 4, 1), (0.7, 5, None), (1.0, 6, None)])
def test_boosting_counts_changed_signs_and_smaller_children(monkeypatch, share, depth, without):
    """Trees are those of whole counts at each stage; behind the first, the root takes the rows whose sign changed."""
    from growthcast.models import binned as T, fitting
    rng = np.random.default_rng(9)
    x, n = _whole_table(rng), 4_000
    y = (x[:, 0] + 3.0 * x[:, 4] * (x[:, 3] > 20) + rng.integers(0, 15, n))[:, None]
    data = fitting.Arrays(rng.permutation(n), x, rng.integers(0, 3, n), y)
    job = fitting.BoostJob(12, 0.1, share, 5, T.Rule(depth, 2), 0, without)
    seen, plain = [], T.Together.sums

    def counted(self, value, rows=None):
        seen.append(len(value) if rows is None else len(rows))
        return plain(self, value, rows)

    monkeypatch.setattr(T.Together, "sums", counted)
    start, trees, f = fitting.boost(data, job)
    if share == 1.0:
        assert sum(seen) <= n * (1 + (depth - 1) / 2 * 12) + 11 * n / 3
    monkeypatch.setattr(fitting, "DEPTH_BY_NODES", 0)
    whole = fitting.boost(data, job)
    assert start == whole[0] and trees == whole[1] and (f == whole[2]).all() and len(trees) == 12


def test_forest_trees_are_those_of_plain_counts():
    """Nodes that lie together, some small ones at a time, split like nodes that are looked up row by row."""
    from growthcast.models import binned as T
    rng = np.random.default_rng(10)
    x = _whole_table(rng)
    weight = T.bootstrap(np.arange(len(x)), 3, 1)
    y = x[:, 0] + 2.0 * x[:, 5] + rng.integers(0, 9, len(x))
    rows = np.flatnonzero(weight)
    some, place = T.grow(x[rows], None, y[rows], weight[rows], T.Rule(1_000, 12, features=3), 77)
    # targets that are not whole are summed feature by feature, node by node, as before
    plain, there = T.grow(x[rows], None, y[rows] * (1 + 2.0 ** -40), weight[rows], T.Rule(1_000, 12, features=3), 77)
    assert (some.feature, some.threshold, some.left, some.right) == (plain.feature, plain.threshold, plain.left, plain.right)
    assert len(some.feature) > 100 and (place == there).all() and np.allclose(some.value, plain.value)
    drawn = np.bincount(place, weight[rows])
    assert drawn[drawn > 0].min() >= 12 and set(np.flatnonzero(drawn)) == {k for k, f in enumerate(some.feature) if f < 0}
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(T, "ROWS_OF_NODES", 100)
        m.setattr(T, "NODES_OF_ROWS", 5)
        sums = T._sums_of_nodes
        m.setattr(T, "_sums_of_nodes", lambda *a: seen.append(len(a[3])) or sums(*a))
        again, _ = T.grow(x[rows], None, y[rows], weight[rows], T.Rule(1_000, 12, features=3), 77)
    assert again == some and max(seen) <= 5 and sum(seen) < len(some.feature)


@pytest.mark.parametrize("groups", [3, 2_000])
def test_lower_medians_of_few_and_many_groups(groups):
    from growthcast.models import binned as T
    rng = np.random.default_rng(5)
    group, value = rng.integers(0, groups - 1, 5_000), np.round(rng.normal(size=5_000), 1)
    found = T.lower_medians(group, value, groups)
    for g in range(groups):
        own = sorted(value[group == g])
        assert found[g] == (own[(len(own) - 1) // 2] if own else 0.0)


def test_rows_go_down_forests_by_whole_numbers():
    """Sums over trees of thresholds and values that meet exactly, NaN and none."""
    import pandas as pd

    from growthcast.models import trees as TR
    from growthcast.models.binned import FlatTree
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, (50, 2)) / 2
    x[::9, 1] = np.nan
    trees = [FlatTree([0, -1, 1, -1, -1], [float(t), 0.0, 1.5, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 0.5, 0.0, 1.25, 4.0]) for t in (0.5, 1.0, 2.0)]
    held = pd.DataFrame([{"horizon": 1 + i % 2, **{k: np.array(v) for k, v in t._asdict().items()}} for i, t in enumerate([*trees, FlatTree([-1], [0.0], [-1], [-1], [7.0])])])
    pdf = pd.DataFrame({"row_id": range(50), "split": "test", "base": 1.0, "x": list(x)})
    want = np.zeros((50, 2))
    for h, t in zip(held["horizon"], [*trees, None]):
        want[:, h - 1] += 7.0 if t is None else t.score(x)
    code, cut = TR._codes_of(x, np.array([0, 0, 1, -1]), np.array([0.5, 2.0, 1.5, 0.0]))
    assert code.dtype == cut.dtype == np.uint8 and cut[:3].tolist() == [0, 1, 0] and ((code[:, 1] > 0) == ~(x[:, 1] <= 1.5)).all()
    for rows in (1_000, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(TR, "ROWS_DOWN", rows)
            assert (np.array(TR._sums_of(2)(pdf, held)["sums"].tolist()) == want).all()
    assert len(TR._sums_of(2)(pdf.iloc[:0], held)) == 0


def test_forest_is_scored_without_the_driver(spark, monkeypatch):
    """Trees meet rows in a shuffle; the driver gets numbers of nodes and rows only."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from growthcast.models import trees as TR
    df = _table(spark, 200)
    model = RandomForest(FEATS, 2, trees=7, min_leaf=8).fit(df)
    rows = {r.row_id: r for r in df.collect()}
    forest = model.forest.collect()
    monkeypatch.setattr(TR, "NODES_A_PASS", 40)
    monkeypatch.setattr(TR, "ROWS_A_BLOCK", 60, raising=False)
    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas"):
            m.setattr(Classic, name, lambda *_: pytest.fail("trees on the driver"))
        plain = Classic.collect

        def one_number(self):
            got = plain(self)
            assert len(got) == 1 and len(got[0]) == 1 and isinstance(got[0][0], int)
            return got

        m.setattr(Classic, "collect", one_number)
        found = model.predict(df)
    preds = found.collect()
    assert len(preds) == 400

    def leaf(tree, x):
        at = 0
        while tree.feature[at] >= 0:
            at = (tree.left if x[tree.feature[at]] <= tree.threshold[at] else tree.right)[at]
        return tree.value[at]

    for p in preds[::37]:
        x = [math.nan if rows[p.row_id][c] is None else float(rows[p.row_id][c]) for c in FEATS]
        mean = sum(leaf(t, x) for t in forest if t.horizon == p.horizon) / 7
        assert math.isclose(p.pred, max(mean, rows[p.row_id].base), rel_tol=1e-12)
