"""Augmented Dickey-Fuller test of one series (numpy, used inside grouped tasks)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# MacKinnon (1994) response surface, constant, one variable.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefs = SMALL_P if tau <= TAU_STAR else LARGE_P
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(coefs)))


def _design(x: np.ndarray, lags: int, drop: int):
    """Level, lagged differences and constant against the difference, first ``drop`` rows cut."""
    d = np.diff(x)
    n = len(d)
    cols = [x[drop:n]] + [d[drop - k:n - k] for k in range(1, lags + 1)] + [np.ones(n - drop)]
    return np.column_stack(cols), d[drop:]


def adf(series, max_lag: int | None = None) -> tuple[float, float, int]:
    """(statistic, p-value, lag) with the lag chosen by AIC on a common sample."""
    x = np.asarray(series, dtype=float)
    n = len(x)
    if max_lag is None:
        max_lag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    max_lag = max(0, min(n // 2 - 2, max_lag))
    full, y = _design(x, max_lag, max_lag)
    rows = len(y)
    # Moments once, then every nested lag length is a sub-block of the same normal equations.
    scale = np.sqrt((full * full).sum(0))
    scale[scale == 0] = 1.0
    z = full / scale
    g, b, yy = z.T @ z, z.T @ y, float(y @ y)
    const = max_lag + 1
    best, lag = math.inf, 0
    for k in range(max_lag + 1):
        idx = [0, *range(1, k + 1), const]
        coef = np.linalg.lstsq(g[np.ix_(idx, idx)], b[idx], rcond=1e-12)[0]
        sse = max(yy - float(coef @ b[idx]), 1e-300)
        aic = rows * (math.log(2 * math.pi) + math.log(sse / rows) + 1) + 2 * len(idx)
        if aic < best:
            best, lag = aic, k
    a, y = _design(x, lag, lag)
    coef, *_ = np.linalg.lstsq(a, y, rcond=None)
    res = y - a @ coef
    dof = len(y) - a.shape[1]
    if dof <= 0:
        return math.nan, math.nan, lag
    cov = np.linalg.pinv(a.T @ a) * float(res @ res) / dof
    if cov[0, 0] <= 0:
        return math.nan, math.nan, lag
    tau = float(coef[0] / math.sqrt(cov[0, 0]))
    return tau, mackinnon_p(tau), lag
