"""Resampling statistics on numpy: BCa intervals, permutation tests, ratios of means."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np

DRAWS, LEVEL, SEED, EXACT_LIMIT = 9999, 0.95, 42, 20000


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection to the last bit that matters."""
    if p <= 0 or p >= 1:
        return float("-inf") if p <= 0 else float("inf")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def bca_interval(theta: float, draws: np.ndarray, jackknife: np.ndarray, level: float = LEVEL) -> tuple[float, float]:
    """Bias-corrected and accelerated ends from bootstrap and jackknife values of a statistic."""
    share = ((draws < theta).sum() + (draws <= theta).sum()) / (2 * len(draws))
    z0 = normal_quantile(share)
    u = jackknife.mean() - jackknife
    spread = (u**2).sum()
    a = (u**3).sum() / (6 * spread**1.5) if spread > 0 else 0.0
    ends = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal_quantile(tail)
        p = normal_cdf(z0 + z / (1 - a * z)) if np.isfinite(z) else float(z > 0)
        ends.append(float(np.percentile(draws, 100 * min(1.0, max(0.0, p)))))
    return ends[0], ends[1]


def _indices(n: int, draws: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, n, (draws, n))


def mean_interval(values: np.ndarray, draws: int = DRAWS, level: float = LEVEL, seed: int = SEED) -> dict:
    """n, mean, ci_low, ci_high, method. No values give nulls; one or constant values a degenerate point."""
    x = np.asarray(values, float)
    x = x[~np.isnan(x)]
    n = len(x)
    if not n:
        return {"n": 0, "mean": None, "ci_low": None, "ci_high": None, "method": "none"}
    mean = float(x.mean())
    if n < 2 or np.all(x == x[0]):
        return {"n": n, "mean": mean, "ci_low": mean, "ci_high": mean, "method": "degenerate"}
    boot = np.concatenate([x[block].mean(axis=1) for block in np.array_split(_indices(n, draws, seed), max(1, draws * n // 4_000_000))])
    jack = (x.sum() - x) / (n - 1)
    lo, hi = bca_interval(mean, boot, jack, level)
    return {"n": n, "mean": mean, "ci_low": lo, "ci_high": hi, "method": "BCa"}


def paired_delta(a: np.ndarray, b: np.ndarray, **kw) -> dict:
    """Interval of the mean difference of aligned values; constant differences are degenerate and not significant."""
    out = mean_interval(np.asarray(a, float) - np.asarray(b, float), **kw)
    out["delta"] = out.pop("mean")
    sure = out["method"] == "BCa" and (out["ci_low"] > 0 or out["ci_high"] < 0)
    return out | {"significant": bool(sure)}


def sign_flip_p(diffs: np.ndarray, draws: int = DRAWS, seed: int = SEED) -> float | None:
    """Two-sided permutation p of a mean difference under flipped signs; exact while 2**n fits the draws."""
    d = np.asarray(diffs, float)
    n = len(d)
    if n < 2 or not d.any():
        return None
    if 2**n <= draws:
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        t, extra = signs @ d / n, 0
    else:
        t, extra = (1 - 2 * np.random.RandomState(seed).randint(0, 2, (draws, n))) @ d / n, 1
    obs, tol = d.mean(), 1e-12
    less, more = ((t <= obs + tol).sum() + extra) / (len(t) + extra), ((t >= obs - tol).sum() + extra) / (len(t) + extra)
    return float(min(1.0, 2 * min(less, more)))


def _ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den == 0, np.inf, num / np.where(den == 0, 1, den))


def ratio_interval(num: np.ndarray, den: np.ndarray, draws: int = DRAWS, level: float = LEVEL, seed: int = SEED) -> dict:
    """BCa interval of mean(num) / mean(den), pairs resampled together; null ends where draws met a zero denominator."""
    num, den = np.asarray(num, float), np.asarray(den, float)
    n = len(num)
    if not n or den.sum() == 0:
        return {"n": n, "ratio": None, "ci_low": None, "ci_high": None, "zero_draws": 0, "method": "none"}
    theta = float(num.sum() / den.sum())
    if n < 2 or (np.all(num == num[0]) and np.all(den == den[0])):
        return {"n": n, "ratio": theta, "ci_low": theta, "ci_high": theta, "zero_draws": 0, "method": "degenerate"}
    idx = _indices(n, draws, seed)
    boot = _ratio(num[idx].mean(axis=1), den[idx].mean(axis=1))
    jack = _ratio((num.sum() - num) / (n - 1), (den.sum() - den) / (n - 1))
    zero = int(np.isinf(boot).sum())
    if zero or np.isinf(jack).any():
        return {"n": n, "ratio": theta, "ci_low": None, "ci_high": None, "zero_draws": zero, "method": "unbounded"}
    lo, hi = bca_interval(theta, boot, jack, level)
    return {"n": n, "ratio": theta, "ci_low": lo, "ci_high": hi, "zero_draws": 0, "method": "BCa"}


def ratio_delta(num_a, den_a, num_b, den_b, **kw) -> dict:
    """Difference of two ratios with the ends [low_a - high_b, high_a - low_b]; a constant difference counts as significant."""
    a, b = ratio_interval(num_a, den_a, **kw), ratio_interval(num_b, den_b, **kw)
    if a["ratio"] is None or b["ratio"] is None:
        return {"n": a["n"], "delta": None, "ci_low": None, "ci_high": None, "significant": False, "method": "none"}
    delta = a["ratio"] - b["ratio"]
    if a["ci_low"] is None or b["ci_low"] is None:
        return {"n": a["n"], "delta": delta, "ci_low": None, "ci_high": None, "significant": False, "method": "unbounded"}
    lo, hi = a["ci_low"] - b["ci_high"], a["ci_high"] - b["ci_low"]
    both = a["method"] == b["method"] == "degenerate"
    return {"n": a["n"], "delta": delta, "ci_low": lo, "ci_high": hi, "significant": bool(lo > 0 or hi < 0), "method": "degenerate" if both else "BCa"}


def ratio_swap_p(num_a, den_a, num_b, den_b, draws: int = DRAWS, seed: int = SEED, exact_limit: int = EXACT_LIMIT, tol: float = 1e-12) -> float | None:
    """Permutation p of a difference of ratios: pairs (num, den) of a question swap cells; non-finite draws count as extreme."""
    na, da, nb, db = (np.asarray(v, float) for v in (num_a, den_a, num_b, den_b))
    n = len(na)
    if n < 2:
        return None
    exact = 2**n <= exact_limit
    swap = ((np.arange(2**n)[:, None] >> np.arange(n)) & 1).astype(bool) if exact else np.random.RandomState(seed).rand(draws, n) < 0.5
    pick = lambda x, y: np.where(swap, y, x).mean(axis=1)
    with np.errstate(invalid="ignore"):
        t = _ratio(pick(na, nb), pick(da, db)) - _ratio(pick(nb, na), pick(db, da))
        obs = float(_ratio(na.mean(), da.mean()) - _ratio(nb.mean(), db.mean()))
    if not np.isfinite(obs):
        return None
    extreme = int((~np.isfinite(t) | (np.abs(t) >= abs(obs) - tol)).sum())
    return extreme / len(t) if exact else (extreme + 1) / (len(t) + 1)
