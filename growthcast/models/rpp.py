"""Reinforced Poisson process forecaster.

Entity i gains counts at rate lambda_i * f(t; mu_i, sigma_i) * (m + count so
far), f lognormal, lambda_i ~ Gamma(alpha_i, beta_i). (alpha, beta) follow
from features through a softplus layer shared by all entities; (mu, sigma) are
fitted per entity. Histories are processed in Arrow batches, padded to the
longest in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from growthcast.functions import scalars as S, special as sp
from growthcast.operators.partials import TASKS, array_sums
from growthcast.operators.standardise import Scaler, fit_scaler
from growthcast.session import shared_dir

PRIOR = 10.0                   # m
FLOOR = 0.001                  # added to the softplus
MU_MIN, SD_MIN = -1.0, 0.5     # bounds of the per-entity fit
FIT_STEPS, PREDICT_STEPS = 10, 10_000
RIDGE = 1e-3                   # penalty on squared layer weights, so that a finite best exists


class Histories:
    """A batch of increment series with the terms that do not depend on parameters."""

    def __init__(self, series: Sequence):
        arrays = [np.asarray(s, dtype=float) for s in series]
        lens = np.array([len(a) for a in arrays])
        b, width = len(arrays), int(lens.max()) if len(arrays) else 0
        self.mask = np.arange(width)[None, :] < lens[:, None]
        self.h = np.zeros((b, width))
        self.h[self.mask] = np.concatenate(arrays) if b else []
        self.len = lens
        self.n = self.h.sum(1)
        self.c = PRIOR + np.cumsum(self.h, 1) - self.h
        self.const = (self.h * np.log(self.c)).sum(1) - np.where(self.mask, sp.lgamma(self.h + 1), 0.0).sum(1)
        with np.errstate(divide="ignore"):
            self.log_t = np.log(np.arange(width + 1, dtype=float))

    def take(self, rows: np.ndarray) -> "Histories":
        out = object.__new__(Histories)
        for name in ("mask", "h", "len", "n", "c", "const"):
            setattr(out, name, getattr(self, name)[rows])
        out.log_t = self.log_t
        return out

    def masses(self, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
        """D_t: lognormal mass of period t."""
        z = (self.log_t[None, :] - mu[:, None]) / sd[:, None]
        return np.where(self.mask, sp.interval_mass(z), 0.0)

    def sums(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X = sum C_t D_t and sum of h_t ln D_t over the periods with counts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(self.h > 0, self.h * np.log(d), 0.0)
        return (self.c * d).sum(1), logs.sum(1)

    def log_likelihood(self, alpha, beta, mu, sd) -> np.ndarray:
        x, logs = self.sums(self.masses(mu, sd))
        return self.const + logs + gamma_terms(alpha, beta, self.n, x)

    def gradient(self, alpha, beta, mu, sd) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives of the log-likelihood by mu and sigma."""
        d = self.masses(mu, sd)
        x, _ = self.sums(d)
        rate = (alpha + self.n) / (beta + x)
        pdf = np.zeros((len(mu), len(self.log_t)))
        z = (self.log_t[None, 1:] - mu[:, None]) / sd[:, None]
        pdf[:, 1:] = np.exp(-0.5 * z * z) / (sd[:, None] * np.sqrt(2 * np.pi))
        scaled = pdf.copy()
        scaled[:, 1:] *= z
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = rate[:, None] * self.c - np.where(self.h > 0, self.h / d, 0.0)
        pull = np.where(self.mask, pull, 0.0)
        with np.errstate(invalid="ignore"):
            return (np.diff(pdf, axis=1) * pull).sum(1), (np.diff(scaled, axis=1) * pull).sum(1)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Lognormal whose mean is the middle of the non-zero span."""
        pos = np.arange(1, self.h.shape[1] + 1)[None, :]
        some = (self.h != 0).any(1)
        lo = np.where(some, np.where(self.h != 0, pos, 10 ** 9).min(1), 1)
        hi = np.where(some, np.where(self.h != 0, pos, 0).max(1), self.len)
        m = (lo + hi) / 2.0
        a = np.sqrt(m ** 4 / (m * m + np.maximum(m, 1.0)))
        return np.log(a), np.sqrt(2.0) * np.sqrt(np.log(m / a))


def gamma_terms(alpha, beta, n, x):
    """The part of the log-likelihood that depends on alpha and beta."""
    return (alpha * np.log(beta) - sp.lgamma(alpha) + sp.lgamma(alpha + n) - (alpha + n) * np.log(beta + x))


def fit_lognormal(hist: Histories, alpha, beta, mu, sd, steps: int, tol: float = 1e-4, eta: float = 0.1):
    """Bounded descent on (mu, sigma), all rows of a batch together.

    A row moves along its normalised gradient: the step is halved up to 20
    times until it is in bounds and no worse, then doubled up to 20 times
    while it helps. A row rests once the relative gain is at most ``tol``.
    """
    mu, sd = np.maximum(mu, -0.99), np.maximum(sd, 0.51)

    def cost(rows, m, s):
        return -hist.take(rows).log_likelihood(alpha[rows], beta[rows], m, s)

    rows = np.arange(len(mu))
    cur, last = cost(rows, mu, sd), np.full(len(mu), np.inf)
    for _ in range(steps):
        with np.errstate(invalid="ignore"):
            rows = rows[1.0 - cur[rows] / last[rows] > tol]
        if not len(rows):
            break
        sub = hist.take(rows)
        g_mu, g_sd = sub.gradient(alpha[rows], beta[rows], mu[rows], sd[rows])
        norm = np.hypot(g_mu, g_sd)
        last[rows] = cur[rows]
        fine = np.isfinite(norm) & (norm > 0)
        rows, g_mu, g_sd, norm = rows[fine], g_mu[fine], g_sd[fine], norm[fine]
        d_mu, d_sd = eta * g_mu / norm, eta * g_sd / norm
        m0, s0, ref = mu[rows], sd[rows], cur[rows]
        best = np.full(len(rows), np.nan)
        open_ = np.arange(len(rows))
        for _ in range(20):
            m, s = m0[open_] + d_mu[open_], s0[open_] + d_sd[open_]
            inside = (m >= MU_MIN) & (s >= SD_MIN)
            value = np.full(len(open_), np.inf)
            if inside.any():
                value[inside] = cost(rows[open_[inside]], m[inside], s[inside])
            good = np.isfinite(value) & (value <= ref[open_])
            best[open_[good]] = value[good]
            open_ = open_[~good]
            if not len(open_):
                break
            d_mu[open_] /= 2.0
            d_sd[open_] /= 2.0
        grow = np.flatnonzero(np.isfinite(best))
        for _ in range(20):
            if not len(grow):
                break
            m, s = m0[grow] + 2 * d_mu[grow], s0[grow] + 2 * d_sd[grow]
            inside = (m >= MU_MIN) & (s >= SD_MIN)
            value = np.full(len(grow), np.inf)
            if inside.any():
                value[inside] = cost(rows[grow[inside]], m[inside], s[inside])
            good = np.isfinite(value) & (value <= best[grow])
            grow = grow[good]
            best[grow] = value[good]
            d_mu[grow] *= 2.0
            d_sd[grow] *= 2.0
        moved = np.isfinite(best)
        mu[rows[moved]] = m0[moved] + d_mu[moved]
        sd[rows[moved]] = s0[moved] + d_sd[moved]
        cur[rows[moved]] = best[moved]
    return mu, sd


class Certificate(NamedTuple):
    """Bounded optimum of each row's (mu, sigma): the gradient that is left, which bounds hold, and the least curvature of what is free."""

    mu: np.ndarray
    sd: np.ndarray
    by_mu: np.ndarray
    by_sd: np.ndarray
    at_mu: np.ndarray
    at_sd: np.ndarray
    curvature: np.ndarray

    def projected(self) -> np.ndarray:
        """Norm of the gradient of the log-likelihood without the parts that push against a bound."""
        g_mu = np.where(self.at_mu & (self.by_mu < 0), 0.0, self.by_mu)
        g_sd = np.where(self.at_sd & (self.by_sd < 0), 0.0, self.by_sd)
        return np.hypot(g_mu, g_sd)

    def holds(self, n: np.ndarray, tol: float = 1e-4) -> np.ndarray:
        """A maximum: no ascent direction is left, by ``tol`` for each count, and the free curvature is not negative by more."""
        return (self.projected() <= tol * (1 + n)) & (self.curvature >= -tol * (1 + n))


def optimal_lognormal(hist: Histories, alpha, beta, mu, sd, steps: int = 60) -> Certificate:
    """From a start, bounded Newton steps on (mu, sigma) until none helps, and what proves the point.

    Curvature comes from differences of the gradient; it is made positive by its
    absolute eigenvalues. A row's step is halved until it is no worse.
    """
    mu, sd = np.maximum(mu, MU_MIN), np.maximum(sd, SD_MIN)

    def slopes(rows, m, s):
        with np.errstate(all="ignore"):
            g = hist.take(rows).gradient(alpha[rows], beta[rows], m, s)
        return np.nan_to_num(np.array(g), nan=0.0)

    def curved(rows, m, s):
        """Second derivatives of minus the log-likelihood: (mu mu, mu sd, sd sd)."""
        h = 1e-5 * (1 + np.abs(m))
        k = 1e-5 * (1 + s)
        by_m = (slopes(rows, m + h, s) - slopes(rows, m - h, s)) / (2 * h)
        by_s = (slopes(rows, m, s + k) - slopes(rows, m, s - k)) / (2 * k)
        return -by_m[0], -(by_m[1] + by_s[0]) / 2, -by_s[1]

    def cost(rows, m, s):
        with np.errstate(all="ignore"):
            v = -hist.take(rows).log_likelihood(alpha[rows], beta[rows], m, s)
        return np.where(np.isfinite(v), v, np.inf)

    rows = np.arange(len(mu))
    for _ in range(steps):
        m, s = mu[rows], sd[rows]
        g_mu, g_sd = slopes(rows, m, s)
        fixed_mu, fixed_sd = (m <= MU_MIN) & (g_mu <= 0), (s <= SD_MIN) & (g_sd <= 0)
        a, b, c = curved(rows, m, s)
        b = np.where(fixed_mu | fixed_sd, 0.0, b)
        mid, half = (a + c) / 2, np.hypot((a - c) / 2, b)
        t = 0.5 * np.arctan2(2 * b, a - c)
        cos, sin = np.cos(t), np.sin(t)
        floor = 1e-8 * (1 + hist.n[rows])
        e1, e2 = np.maximum(np.abs(mid + half), floor), np.maximum(np.abs(mid - half), floor)
        g1, g2 = np.where(fixed_mu, 0.0, g_mu), np.where(fixed_sd, 0.0, g_sd)
        p, q = (cos * g1 + sin * g2) / e1, (-sin * g1 + cos * g2) / e2
        d_mu, d_sd = np.where(fixed_mu, 0.0, cos * p - sin * q), np.where(fixed_sd, 0.0, sin * p + cos * q)
        reach = np.minimum(1.0, 2.0 / np.maximum(np.hypot(d_mu, d_sd), 1e-300))  # a trust region of radius 2
        d_mu, d_sd, ref, open_ = d_mu * reach, d_sd * reach, cost(rows, m, s), np.arange(len(rows))
        gained = np.zeros(len(rows), bool)
        for _ in range(30):
            if not len(open_):
                break
            m2, s2 = np.maximum(m[open_] + d_mu[open_], MU_MIN), np.maximum(s[open_] + d_sd[open_], SD_MIN)
            better = cost(rows[open_], m2, s2) < ref[open_]
            done = open_[better]
            mu[rows[done]], sd[rows[done]] = m2[better], s2[better]
            gained[done] = True
            open_ = open_[~better]
            d_mu[open_] /= 2
            d_sd[open_] /= 2
        rows = rows[gained]
        if not len(rows):
            break
    rows = np.arange(len(mu))
    by_mu, by_sd = slopes(rows, mu, sd)
    at_mu, at_sd = mu <= MU_MIN, sd <= SD_MIN
    a, b, c = curved(rows, mu, sd)
    held_mu, held_sd = at_mu & (by_mu < 0), at_sd & (by_sd < 0)
    both = (a + c) / 2 - np.hypot((a - c) / 2, b)
    curvature = np.where(held_mu & held_sd, 0.0, np.where(held_mu, c, np.where(held_sd, a, both)))
    return Certificate(mu, sd, by_mu, by_sd, at_mu, at_sd, curvature)


def expected_counts(alpha, beta, n, x, future: np.ndarray) -> np.ndarray:
    """E[count] after each future period, lambda integrated out under its posterior.

    The path is (m + n) * prod(1 + lambda D_i) - m; its powers of lambda have
    gamma moments a (a+1) ... / b^k.
    """
    a, b = alpha + n, beta + x
    rows, horizons = future.shape
    poly = np.zeros((rows, horizons + 1))
    poly[:, 0] = 1.0
    moments = np.ones((rows, horizons + 1))
    for k in range(1, horizons + 1):
        moments[:, k] = moments[:, k - 1] * (a + k - 1) / b
    out = np.empty((rows, horizons))
    for i in range(horizons):
        poly[:, 1:] = poly[:, 1:] + future[:, i:i + 1] * poly[:, :-1]
        out[:, i] = (PRIOR + n) * (poly * moments).sum(1) - PRIOR
    return out


def future_masses(hist: Histories, mu, sd, horizons: int) -> np.ndarray:
    steps = hist.len[:, None] + np.arange(horizons + 1)[None, :]
    return sp.interval_mass((np.log(steps) - mu[:, None]) / sd[:, None])


def layer(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta) from features with a trailing 1; weights (q, 2)."""
    u = z @ weights
    return sp.softplus(u[:, 0]) + FLOOR, sp.softplus(u[:, 1]) + FLOOR


def map_histories(df: DataFrame, kernel: Callable[[pd.DataFrame, Histories], pd.DataFrame], schema: str,
                  series: str = "inc") -> DataFrame:
    """Run a batch kernel over (columns, histories); the hook for per-entity code."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield kernel(pdf, Histories(pdf[series]))

    return df.mapInPandas(run, schema)


def _objective(weights: np.ndarray, gamma: float, z, n, x):
    """Mean-able loss, gradient, curvature and a positive semidefinite curvature of the layer weights."""
    u = z @ weights
    sa, sb = sp.sigmoid(u[:, 0]), sp.sigmoid(u[:, 1])
    a, b = sp.softplus(u[:, 0]) + FLOOR, sp.softplus(u[:, 1]) + FLOOR
    loss = -gamma_terms(a, b, n, x) + gamma * (a / b) ** 2
    la = -(np.log(b) - sp.digamma(a) + sp.digamma(a + n) - np.log(b + x)) + 2 * gamma * a / b ** 2
    lb = -(a / b - (a + n) / (b + x)) - 2 * gamma * a ** 2 / b ** 3
    laa = sp.trigamma(a) - sp.trigamma(a + n) + 2 * gamma / b ** 2
    lab = -(1 / b - 1 / (b + x)) - 4 * gamma * a / b ** 3
    lbb = a / b ** 2 - (a + n) / (b + x) ** 2 + 6 * gamma * a ** 2 / b ** 4
    gu, gv = la * sa, lb * sb
    huu = laa * sa * sa + la * sa * (1 - sa)
    huv = lab * sa * sb
    hvv = lbb * sb * sb + lb * sb * (1 - sb)
    # beside the curvature itself, one whose per-row eigenvalues below zero are raised to zero
    mid, half = (huu + hvv) / 2, np.hypot((huu - hvv) / 2, huv)
    e1, e2 = np.maximum(mid + half, 0.0), np.maximum(mid - half, 0.0)
    t = 0.5 * np.arctan2(2 * huv, huu - hvv)
    c, s = np.cos(t), np.sin(t)
    return loss, gu, gv, (huu, huv, hvv), (e1 * c * c + e2 * s * s, (e1 - e2) * c * s, e1 * s * s + e2 * c * c)


def _z(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["z"].tolist(), dtype=float)


class LayerFit(NamedTuple):
    """Weights, the loss there, the norm of the gradient that is left, and whether that is small enough."""

    weights: np.ndarray
    loss: float
    gradient: float
    certified: bool


def fit_layer(states: DataFrame, weights: np.ndarray, gamma: float, ridge: float = RIDGE, tol: float = 1e-5, passes: int = 200) -> LayerFit:
    """Minimum of the layer's mean loss plus ``ridge`` / 2 times the squared weights, from distributed sums.

    Entities that grow alike have no finite best (alpha, beta); the ridge makes
    one. Every pass sums loss, gradient and curvature; a second one prices
    steps of several trust regions at once, and the best is taken. It ends when the
    gradient's norm is at most ``tol`` times 1 + loss: that is the certificate. A fit
    that finds no better step, or needs more passes, is returned without one.
    """
    q = weights.shape[0]
    few = states.rdd.getNumPartitions() <= TASKS  # states are checkpointed: no job runs

    def full(w):
        def part(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
            z = _z(pdf)
            loss, gu, gv, *curved = _objective(w, gamma, z, pdf["n"].to_numpy(float), pdf["x"].to_numpy(float))
            return {0: np.concatenate([[len(pdf), loss.sum()], z.T @ gu, z.T @ gv, *[((z * h[:, None]).T @ z).ravel() for c in curved for h in c]])}

        v = array_sums(states.select("z", "n", "x"), part, few)[0]
        count, g, rest = v[0], v[2:2 + 2 * q], v[2 + 2 * q:].reshape(2, 3, q, q)
        own, raised = (np.block([[c[0], c[1]], [c[1].T, c[2]]]) / count + ridge * np.eye(2 * q) for c in rest)
        flat = w.T.ravel()
        return v[1] / count + ridge / 2 * flat @ flat, g / count + ridge * flat, own, raised

    def losses(options):
        def part(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
            z, n, x = _z(pdf), pdf["n"].to_numpy(float), pdf["x"].to_numpy(float)
            out = [float(len(pdf))]
            for w in options:
                a, b = layer(z, w)
                out.append(float((-gamma_terms(a, b, n, x) + gamma * (a / b) ** 2).sum()))
            return {0: np.array(out)}

        v = array_sums(states.select("z", "n", "x"), part, few)[0]
        return v[1:] / v[0] + [ridge / 2 * (w ** 2).sum() for w in options]

    for _ in range(passes):
        loss, grad, own, raised = full(weights)
        left = float(np.linalg.norm(grad))
        if left <= tol * (1 + abs(loss)):
            return LayerFit(weights, float(loss), left, True)
        scale = float(np.trace(raised)) / (2 * q)
        steps = [_step(own, grad, damp * scale) for damp in (0.0, 1e-3, 1e-1, 1e1)]
        whole = _step(raised, grad, 1e-9 * scale)
        steps += [whole / 4.0 ** i for i in range(6)]
        options = [weights - s.reshape(2, q).T for s in steps]
        found = losses(options)
        best = int(np.nanargmin(np.where(np.isfinite(found), found, np.inf)))
        if not found[best] < loss:
            break
        weights = options[best]
    loss, grad, _, _ = full(weights)
    left = float(np.linalg.norm(grad))
    return LayerFit(weights, float(loss), left, left <= tol * (1 + abs(loss)))


def _step(curvature: np.ndarray, grad: np.ndarray, damping: float) -> np.ndarray:
    """Newton step with damping beyond the most negative eigenvalue."""
    values, vectors = np.linalg.eigh(curvature)
    values = np.maximum(np.abs(values), 1e-12) + damping
    return vectors @ ((vectors.T @ grad) / values)


@dataclass
class PointProcess:
    """RPP (bias only) or, with feature columns, RPPNet."""

    features: Sequence[str] = ()
    horizons: int = 10
    gamma: float = 0.7
    rounds: int = 4
    scaler: Scaler | None = None
    weights: np.ndarray | None = None
    loss: float | None = None
    first_loss: float | None = None  # of the weights that the fit began with, on the same entities and (mu, sigma)
    gradient: float | None = None    # norm of what is left of the layer's gradient after the last round
    certified: bool | None = None    # whether that is as small as asked for

    @property
    def name(self) -> str:
        return "RPPNet" if self.features else "RPP"

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, float(a), float(b), float(self.loss)) for i, (a, b) in enumerate(self.weights)]
        spark.createDataFrame(rows, "i int, a double, b double, loss double").write.mode("overwrite").parquet(f"{path}/layer")
        if self.scaler:
            self.scaler.save(spark, f"{path}/scaler")

    def load(self, spark: SparkSession, path: str) -> "PointProcess":
        rows = sorted(spark.read.parquet(f"{path}/layer").collect())
        scaler = Scaler.load(spark, f"{path}/scaler") if self.features else None
        return replace(self, scaler=scaler, weights=np.array([[r["a"], r["b"]] for r in rows]), loss=rows[0]["loss"])

    def inputs(self, df: DataFrame, *keep: str) -> DataFrame:
        """(row_id, z, inc): scaled features with a trailing 1, and the history."""
        bias = F.array(F.lit(1.0))
        z = F.concat(self.scaler.array(), bias) if self.features else bias
        return df.select("row_id", *keep, z.alias("z"), F.col("inc").cast("array<double>").alias("inc"))

    def first_weights(self) -> np.ndarray:
        return np.full((len(self.features) + 1, 2), 0.1)

    def first_states(self, train: DataFrame) -> tuple["PointProcess", DataFrame]:
        """With its scaler, and every entity at its starting (mu, sigma)."""
        shared_dir(train.sparkSession)
        model = replace(self, scaler=fit_scaler(train, self.features) if self.features else None)
        lo, hi = S.history_span("inc")
        mu, sd = S.lognormal_start(S.span_mid(lo, hi))
        return model, model.inputs(train).select("row_id", "z", "inc", mu.alias("mu"), sd.alias("sd")).checkpoint()

    def fit(self, train: DataFrame) -> "PointProcess":
        """train: (row_id, inc, features). Alternates per-entity and shared parameters."""
        model, states = self.first_states(train)
        fit = LayerFit(self.first_weights(), None, None, None)
        for _ in range(self.rounds):
            states = fitted_states(states, fit.weights, FIT_STEPS).checkpoint()
            fit = fit_layer(states, fit.weights, self.gamma)
        first = fit_layer(states, self.first_weights(), self.gamma, passes=0).loss
        return replace(model, weights=fit.weights, loss=fit.loss, first_loss=first, gradient=fit.gradient, certified=fit.certified)

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows: (row_id, split, inc, features) -> long predictions."""
        weights, horizons = self.weights, self.horizons

        def kernel(pdf: pd.DataFrame, hist: Histories) -> pd.DataFrame:
            alpha, beta = layer(_z(pdf), weights)
            mu, sd = fit_lognormal(hist, alpha, beta, *hist.start(), PREDICT_STEPS)
            x, _ = hist.sums(hist.masses(mu, sd))
            preds = expected_counts(alpha, beta, hist.n, x, future_masses(hist, mu, sd, horizons))
            return pd.DataFrame({"row_id": pdf["row_id"], "split": pdf["split"], "preds": list(preds)})

        arrays = map_histories(self.inputs(rows, "split"), kernel, "row_id bigint, split string, preds array<double>")
        return arrays.select(F.lit(self.name).alias("model"), "split", "row_id",
                             F.posexplode("preds").alias("_i", "pred")).select(
            "model", "split", "row_id", (F.col("_i") + 1).alias("horizon"), "pred")


def fitted_states(states: DataFrame, weights: np.ndarray, steps: int) -> DataFrame:
    """Per-entity (mu, sigma) for the current layer, with the sums the layer fit needs."""
    def kernel(pdf: pd.DataFrame, hist: Histories) -> pd.DataFrame:
        alpha, beta = layer(_z(pdf), weights)
        mu, sd = fit_lognormal(hist, alpha, beta, pdf["mu"].to_numpy(float), pdf["sd"].to_numpy(float), steps)
        x, logs = hist.sums(hist.masses(mu, sd))
        return pd.DataFrame({"row_id": pdf["row_id"], "z": pdf["z"], "inc": pdf["inc"], "mu": mu, "sd": sd,
                             "alpha": alpha, "beta": beta, "n": hist.n, "x": x, "fixed": hist.const + logs})

    return map_histories(states, kernel,
                         "row_id bigint, z array<double>, inc array<double>, mu double, sd double, "
                         "alpha double, beta double, n double, x double, fixed double")


def sampled_counts(row_ids, alpha, beta, n, x, future: np.ndarray, draws: int = 500, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Monte Carlo version of ``expected_counts`` and its standard errors.

    A row's draws depend on its id only: the id starts a counter whose mixed
    values are the uniforms, and rates are their gamma quantiles by the cube
    root approximation with one accept-reject test, all rows at a time.
    """
    ids, mean, error = np.asarray(row_ids, np.int64), np.empty(future.shape), np.empty(future.shape)
    step = max(1, 2_000_000 // (draws * future.shape[1]))
    for k in range(0, len(ids), step):
        part = slice(k, k + step)
        lam = _gammas(ids[part], (alpha + n)[part, None], draws, seed) / (beta + x)[part, None]
        grown = np.cumprod(1 + lam[:, :, None] * future[part, None, :], axis=2) * (PRIOR + n)[part, None, None] - PRIOR
        mean[part], error[part] = grown.mean(1), grown.std(1, ddof=1) / np.sqrt(draws)
    return mean, error


def _uniforms(ids: np.ndarray, draws: int, stream: int) -> np.ndarray:
    """(rows, draws) numbers in (0, 1): a mixed counter that starts at the id."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(draws, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        z = z + np.uint64(stream) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mul)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _gammas(ids: np.ndarray, shape: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Gamma draws of shapes above 1 by Marsaglia and Tsang's method; rejected ones are drawn from the next streams."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, stream = np.full((len(ids), draws), np.nan), 3 * seed
    while (open_ := np.isnan(out)).any():
        u, v, w = (_uniforms(ids, draws, stream + k) for k in range(3))
        normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + c * normal) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = open_ & (cube > 0) & (np.log(w) < 0.5 * normal ** 2 + d - d * cube + d * np.log(cube))
        out[ok] = (d * cube)[ok]
        stream += 3
    return out
