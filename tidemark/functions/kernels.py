"""Numerical kernels on small arrays, for grouped Python functions. numpy only; every random one takes a generator."""

from __future__ import annotations

import math

import numpy as np


def seeded(*parts: object) -> np.random.Generator:
    """A generator that depends on the parts only, not on partitioning."""
    import hashlib

    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big"))


# ---- alignment --------------------------------------------------------------------------------


def dtw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cumulative cost matrix of dynamic time warping; row by row, the running minimum along a row resolved by prefix sums."""
    cost = np.abs(np.subtract.outer(np.asarray(x, float), np.asarray(y, float)))
    n, m = cost.shape
    total = np.empty((n, m))
    total[0] = np.cumsum(cost[0])
    for i in range(1, n):
        enter = total[i - 1].copy()
        enter[1:] = np.minimum(enter[1:], total[i - 1][:-1])
        run = np.cumsum(cost[i])
        # entering at k and walking right to j costs enter[k] + run[j] - run[k - 1]
        total[i] = run + np.minimum.accumulate(enter - np.concatenate([[0.0], run[:-1]]))
    return total


def dtw_path(total: np.ndarray, end: int | None = None) -> list[tuple[int, int]]:
    """The cheapest path back from the last row; on ties the diagonal wins."""
    i, j = total.shape[0] - 1, total.shape[1] - 1 if end is None else end
    path = [(i, j)]
    while i or j:
        steps = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        i, j = min((s for s in steps if s[0] >= 0 and s[1] >= 0), key=lambda s: total[s])
        path.append((i, j))
    return path[::-1]


def open_end(total: np.ndarray) -> int:
    """The column at which the last row is cheapest per step."""
    n, m = total.shape
    return int(np.argmin(total[-1] / (n + np.arange(m) + 1)))


def k_medoids(features: np.ndarray, k: int, sweeps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and medoids without randomness: robust scaling, squared distances, a start nearest the centre and then farthest first, ties to the lowest index."""
    x = np.asarray(features, float)
    med = np.median(x, axis=0)
    iqr = np.subtract(*np.percentile(x, [75, 25], axis=0))
    # a normal spread's quartiles lie 1.349 of it apart
    x = (x - med) / np.maximum(iqr / 1.349, 1e-8)
    n = len(x)
    k = min(k, n)
    apart = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    chosen = [int(np.argmin((x**2).sum(1)))] if n else []
    while len(chosen) < k:
        free = apart[:, chosen].min(1)
        free[chosen] = -1.0
        chosen.append(int(np.argmax(free)))
    medoids = np.array(chosen)
    for _ in range(sweeps):
        labels = np.argmin(apart[:, medoids], axis=1)
        fresh = medoids.copy()
        for c in range(k):
            members = np.flatnonzero(labels == c)
            if len(members):
                fresh[c] = members[np.argmin(apart[np.ix_(members, members)].sum(1))]
        if (fresh == medoids).all():
            break
        medoids = fresh
    return np.argmin(apart[:, medoids], axis=1), medoids


# ---- simulation -------------------------------------------------------------------------------


def stationary_indices(rng: np.random.Generator, rows: int, length: int, mean_block: float) -> np.ndarray:
    """Positions of a stationary bootstrap: blocks of geometric length, wrapping round."""
    fresh = rng.random(length) < 1.0 / mean_block
    fresh[0] = True
    starts = np.where(fresh, rng.integers(0, rows, length), 0)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(length), 0))
    return (starts[begin] + np.arange(length) - begin) % rows


def gaussian_copula(samples: np.ndarray, correlation: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Draws with the samples' marginals (columns) and the rank order of correlated normals."""
    z = rng.standard_normal((count, samples.shape[1])) @ np.linalg.cholesky(correlation + 1e-10 * np.eye(len(correlation))).T
    ranks = (np.argsort(np.argsort(z, axis=0), axis=0) + 0.5) / count
    return np.column_stack([np.quantile(samples[:, j], ranks[:, j]) for j in range(samples.shape[1])])


def bridge(end: float, noise: np.ndarray) -> np.ndarray:
    """A path of cumulative steps like the noise that ends exactly at ``end``."""
    path = np.cumsum(noise)
    n = len(noise)
    return path + (end - path[-1]) * np.arange(1, n + 1) / n


def systematic(weights: np.ndarray, count: int, u: float) -> np.ndarray:
    """Positions resampled in proportion to the weights from one uniform number."""
    edges = np.cumsum(weights) / np.sum(weights)
    edges[-1] = 1.0
    return np.searchsorted(edges, (np.arange(count) + u) / count, side="right")


def baselines(returns: np.ndarray, horizon: int, count: int, rng_of) -> dict[str, np.ndarray]:
    """Sums of the next ``horizon`` returns by six simple models; ``rng_of(name)`` gives each its generator."""
    r = np.asarray(returns, float)
    n = len(r)
    if n < 3:
        return {}
    mean, sd = r.mean(), r.std(ddof=1)
    base = float(r[:-1] @ r[:-1])
    phi = float(r[:-1] @ r[1:]) / base if base > 1e-16 else 0.0
    rest = r[1:] - phi * r[:-1]
    state, total = np.full(count, r[-1]), np.zeros(count)
    for shock in rng_of("ar1").choice(rest, size=(horizon, count)):
        state = phi * state + shock
        total += state
    g = rng_of("blocks")
    blocks = np.stack([(r - mean)[stationary_indices(g, n, horizon, min(10, horizon))].sum() for _ in range(count)])
    return {
        "walk": np.zeros(count), "drift": np.full(count, mean * horizon), "ar1": total, "normal": rng_of("normal").normal(mean * horizon, sd * math.sqrt(horizon), count),
        "history": rng_of("history").choice(r, size=(count, horizon)).sum(1), "blocks": blocks + mean * horizon,
    }


# ---- fits -------------------------------------------------------------------------------------


def garch11(returns: np.ndarray) -> tuple[float, float, float]:
    """(omega, alpha, beta) by likelihood with the long-run variance kept: a grid, refined around its best point."""
    r = np.asarray(returns, float)
    r = r - r.mean()
    long_run = float((r * r).mean()) or 1e-12

    def loss(a: float, b: float) -> float:
        h, total, omega = long_run, 0.0, long_run * (1 - a - b)
        for x in r:
            total += math.log(h) + x * x / h
            h = omega + a * x * x + b * h
        return total

    best, step = (0.05, 0.9), 0.08
    grid = [(a, b) for a in (0.02, 0.05, 0.1, 0.2) for b in (0.5, 0.7, 0.8, 0.9, 0.95) if a + b < 0.999]
    best = min(grid, key=lambda p: loss(*p))
    while step > 0.002:
        near = [(a, b) for da in (-step, 0, step) for db in (-step, 0, step) if (a := best[0] + da) >= 0 and (b := best[1] + db) >= 0 and a + b < 0.999]
        fresh = min(near, key=lambda p: loss(*p))
        best, step = (fresh, step) if fresh != best else (best, step / 2)
    return long_run * (1 - sum(best)), best[0], best[1]


def lppl(logs: np.ndarray, rng: np.random.Generator, rounds: int = 60, people: int = 24) -> dict[str, float]:
    """Log-periodic power law: critical time, exponent and frequency by differential evolution, the linear part by least squares."""
    y = np.asarray(logs, float)
    n = len(y)
    t = np.arange(n)
    low, high = np.array([n + 1.0, 0.1, 4.0]), np.array([n + 0.8 * n, 0.9, 15.0])

    def fit(p: np.ndarray) -> float:
        d = p[0] - t
        f = d ** p[1]
        g = np.column_stack([np.ones(n), f, f * np.cos(p[2] * np.log(d)), f * np.sin(p[2] * np.log(d))])
        rest = y - g @ np.linalg.lstsq(g, y, rcond=None)[0]
        return float(rest @ rest)

    crowd = low + rng.random((people, 3)) * (high - low)
    costs = np.array([fit(p) for p in crowd])
    for _ in range(rounds):
        for i in range(people):
            a, b, c = crowd[rng.choice(people, 3, replace=False)]
            trial = np.where(rng.random(3) < 0.8, a + 0.7 * (b - c), crowd[i])
            trial = np.clip(trial, low, high)
            if (cost := fit(trial)) < costs[i]:
                crowd[i], costs[i] = trial, cost
    best = crowd[int(np.argmin(costs))]
    return {"critical": float(best[0]), "exponent": float(best[1]), "frequency": float(best[2]), "rmse": math.sqrt(costs.min() / n)}


def critical_walk(logs: np.ndarray, first: int, rng_of, rounds: int = 20, tolerance: float = 3.0) -> dict[str, float]:
    """Critical times fitted at each end from ``first`` on, and the longest suffix of ends whose estimates stay within ``tolerance`` of the last one's."""
    found = [lppl(logs[:end], rng_of(end), rounds)["critical"] for end in range(first, len(logs) + 1)]
    if not found:
        return {"fits": 0.0, "median": float("nan"), "last": float("nan"), "stable": 0.0}
    stable = 0
    for c in reversed(found):
        if abs(c - found[-1]) > tolerance:
            break
        stable += 1
    return {"fits": float(len(found)), "median": float(np.median(found)), "last": found[-1], "stable": float(stable)}


def entropy_pool(views: np.ndarray, targets: np.ndarray, prior: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Weights nearest to the prior in entropy whose means of the views are the targets, by Newton on the dual."""
    n, k = views.shape
    log_prior = np.log(np.full(n, 1.0 / n) if prior is None else prior)
    scale = views.std(0)
    scale[scale == 0] = 1.0
    a, b = views / scale, targets / scale
    x = np.zeros(k)

    def weights(x: np.ndarray) -> tuple[np.ndarray, float]:
        logs = log_prior + a @ x
        top = logs.max()
        w = np.exp(logs - top)
        return w / w.sum(), math.log(w.sum()) + top - x @ b

    w, value = weights(x)
    for _ in range(steps):
        mean = w @ a
        slope = mean - b
        if np.abs(slope).max() < 1e-10:
            break
        curve = (a * w[:, None]).T @ a - np.outer(mean, mean) + 1e-12 * np.eye(k)
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-8:
            fresh, better = weights(x - size * move)
            if better < value:
                x, w, value = x - size * move, fresh, better
                break
            size /= 2
        else:
            break
    return w


def one_factor(panel: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Filtered factor and loadings of a one-factor model with an AR(1) factor; missing values are NaN. EM-like updates."""
    x = np.asarray(panel, float)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = (x - mean) / np.where(sd > 0, sd, 1.0)
    t, k = z.shape
    load, noise, phi = np.ones(k), np.full(k, 0.5), 0.7
    f = np.zeros(t)
    for _ in range(rounds):
        state, spread, variances = 0.0, 1.0, np.zeros(t)
        for i in range(t):
            state, spread = phi * state, phi * phi * spread + (1 - phi * phi)
            seen = ~np.isnan(z[i])
            if seen.any():
                info = (load[seen] ** 2 / noise[seen]).sum()
                gain = spread / (1 + spread * info)
                state += gain * (load[seen] * (z[i, seen] - load[seen] * state) / noise[seen]).sum()
                spread = gain
            f[i], variances[i] = state, spread
        second = f * f + variances
        for j in range(k):
            seen = ~np.isnan(z[:, j])
            load[j] = (f[seen] @ z[seen, j]) / second[seen].sum()
            noise[j] = max(0.05, ((z[seen, j] - load[j] * f[seen]) ** 2 + load[j] ** 2 * variances[seen]).mean())
        phi = float(np.clip((f[1:] @ f[:-1]) / max(second[:-1].sum(), 1e-9), -0.98, 0.98))
    return f, load


def aligned(states: np.ndarray, loadings: np.ndarray, reference: list[int], period: slice, before: np.ndarray | None = None, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, int]:
    """A factor's states and loadings with a fixed sign and scale, and the sign.

    The sign makes the mean loading of the reference series positive, then that of the correlation with
    the loadings ``before``, if given, which must reach ``least``; states have mean zero and unit spread
    over the ``period``. Raises if that can't be.
    """
    s, load = np.asarray(states, float), np.asarray(loadings, float)
    sign = 1 if load[reference].mean() >= 0 else -1
    if before is not None:
        r = np.corrcoef(load * sign, before)[0, 1]
        sign, r = (-sign, -r) if r < 0 else (sign, r)
        if not r >= least:
            raise ValueError("the loadings are not those of the factor before")
    seen = (s * sign)[period]
    seen = seen[np.isfinite(seen)]
    if len(seen) < 5 or not seen.std(ddof=1) > 1e-12:
        raise ValueError("the period is too short or flat")
    return (s * sign - seen.mean()) / seen.std(ddof=1), load * sign * seen.std(ddof=1), sign


def call_density(strikes: np.ndarray, calls: np.ndarray, rate: float, years: float) -> np.ndarray:
    """Risk-neutral density at the inner strikes: the second difference of call prices, negative parts cut, mass one."""
    k, c = np.asarray(strikes, float), np.asarray(calls, float)
    left, right = k[1:-1] - k[:-2], k[2:] - k[1:-1]
    bend = 2 * ((c[2:] - c[1:-1]) / right - (c[1:-1] - c[:-2]) / left) / (left + right)
    density = np.maximum(bend * math.exp(rate * years), 0.0)
    mass = (density * (left + right) / 2).sum()
    return density / mass if mass > 0 else density
