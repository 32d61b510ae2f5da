"""Column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed_pe(pred, y) -> Column:
    return (_c(pred) - _c(y)) / _c(y)


def ape(pred, y) -> Column:
    return F.abs(signed_pe(pred, y))


def squared_error(pred, y) -> Column:
    d = _c(pred) - _c(y)
    return d * d


def centred_square(x, mean) -> Column:
    d = _c(x) - _c(mean)
    return d * d


def normal_pdf(x, mean, sd) -> Column:
    z = (_c(x) - _c(mean)) / _c(sd)
    return F.exp(-0.5 * z * z) / (_c(sd) * F.lit(math.sqrt(2 * math.pi)))


def softplus(x) -> Column:
    """ln(1 + e^x) + .001 without overflow."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + F.lit(0.001)


def is_bad(x) -> Column:
    """NaN or infinite."""
    x = _c(x)
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def span_mid(lo, hi) -> Column:
    return (_c(lo) + _c(hi)) / F.lit(2.0)


def lognormal_start(mean) -> tuple[Column, Column]:
    """(mu, sigma) whose lognormal has this mean and variance max(mean, 1)."""
    m = _c(mean)
    v = F.greatest(m, F.lit(1.0))
    a = F.sqrt(F.pow(m, 4) / (m * m + v))
    return F.log(a), F.lit(math.sqrt(2.0)) * F.sqrt(F.log(m / a))


def array_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def name_has(name, part: str) -> Column:
    return F.lower(_c(name)).contains(part.lower())


def normalise_label(label) -> Column:
    return F.translate(_c(label), ":,", "__")


def clamp_to_base(pred, base) -> Column:
    """A cumulative measure never falls below its value at the source period."""
    return F.greatest(_c(pred), _c(base))


def cumulative_to_increments(history) -> Column:
    """[1,1,2,3] -> [1,0,1,1]; the first element is kept."""
    h = _c(history)
    return F.transform(h, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(h, i - 1)))


def shifted_running_sum(increments, prior: float = 10.0) -> Column:
    """C_t = prior + sum of the increments before t, as an array."""
    # one fold: the sums so far, the last of them being the next to shift
    sums = F.aggregate(_c(increments), F.array(F.lit(float(prior))), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return F.slice(sums, F.lit(1), F.size(_c(increments)))


def history_span(increments) -> tuple[Column, Column]:
    """1-based first and last non-zero position; (1, T) when all are zero."""
    h = _c(increments)
    at = F.filter(F.transform(h, lambda x, i: F.when(x != 0, i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.array_min(at), F.lit(1)), F.coalesce(F.array_max(at), F.size(h))


def history_log_term(increments, prior: float = 10.0) -> Column:
    """sum h_t ln C_t in one fold over the series."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float(prior)).alias("c"))
    return F.aggregate(
        _c(increments), start,
        lambda acc, h: F.struct((acc["s"] + h * F.log(acc["c"])).alias("s"), (acc["c"] + h).alias("c")),
        lambda acc: acc["s"])
