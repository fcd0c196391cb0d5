import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.backtest import select_lags, walk_forward

HOW = {"lags": (1, 2, 3), "alphas": (0.01, 1.0), "purge": 10, "embargo": 5, "most": 4, "least": 60}


def series(n, seed):
    g = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 0.05 + 0.5 * y[t - 1] - 0.3 * y[t - 2] + g.normal()
    return y


def fit(y, lag, alpha, most=3):
    """By the rows themselves."""
    x = np.array([[*(y[t - k] for k in range(1, lag + 1)), 1.0] for t in range(most, len(y))])
    penalty = alpha * np.eye(lag + 1)
    penalty[-1, -1] = 0
    b = np.linalg.solve(x.T @ x + penalty, x.T @ y[most:])
    return b, float(((y[most:] - x @ b) ** 2).mean())


def errors(y, upto):
    origins = [o for o in range(60, upto, 21) if o - 10 > 3][-4:]
    return {c: np.mean([(y[o] - fit(y[: o - 10], *c)[0] @ [*(y[o - k] for k in range(1, c[0] + 1)), 1.0]) ** 2 for o in origins]) for c in [(lag, a) for lag in (1, 2, 3) for a in (0.01, 1.0)]}, len(origins)


@pytest.fixture(scope="module")
def frame(spark):
    data = {"a": series(230, 1), "b": series(150, 2), "short": series(40, 3)}
    return data, spark.createDataFrame([(k, t, float(v), "x") for k, y in data.items() for t, v in enumerate(y)] + [("a", 999, None, "x")], "k string, t int, v double, no string")


def test_selection_like_refits_from_the_rows(frame):
    data, df = frame
    got = {}
    for r in select_lags(df, "k", "t", "v", **HOW).collect():
        got.setdefault(r["k"], {})[r["lag"], r["alpha"]] = (r["mse"], r["origins"], r["best"])
    assert set(got) == {"a", "b"}
    for k in got:
        want, n = errors(data[k], len(data[k]))
        assert all(math.isclose(got[k][c][0], want[c], rel_tol=1e-8) and got[k][c][1] == n for c in want)
        assert [c for c in got[k] if got[k][c][2]] == [min(want, key=lambda c: (want[c], c))]


def test_walk_forward_like_refits_from_the_rows(frame):
    data, df = frame
    out = walk_forward(df.drop("no"), "k", "t", "v", F.pmod(F.col("no"), F.lit(7)) == 0, horizons=(1, 5), **HOW).collect()
    got = {(r["k"], r["t"], r["horizon"]): r for r in out}
    assert {k for k, _, _ in got} == {"a", "b"} and min(t for _, t, _ in got) == 63 and max(t for k, t, h in got if k == "a" and h == 5) == 224
    g = np.random.default_rng(0)
    for k, t in [("a", 63), ("a", 147), ("b", 98)]:
        y = data[k]
        want, _ = errors(y, t)
        best = min(want, key=lambda c: (want[c], c))
        b, variance = fit(y[:t], *best)
        # the sum's spread by simulation
        x = np.tile(y[t - best[0] : t][::-1], (40_000, 1))
        total = np.zeros(40_000)
        path = [*y[t - best[0] : t][::-1]]
        mean = 0.0
        for _ in range(5):
            v = x @ b[:-1] + b[-1] + g.normal(size=40_000) * variance**0.5
            x, total = np.column_stack([v, x[:, :-1]]), total + v
            step = float(np.dot(b[:-1], path) + b[-1])
            path, mean = [step, *path[:-1]], mean + step
        r = got[k, t, 5]
        assert (r["lag"], r["alpha"]) == best and math.isclose(r["mean"], mean, rel_tol=1e-7, abs_tol=1e-9) and abs(r["sd"] / total.std() - 1) < 0.02
        assert math.isclose(r["actual"], y[t : t + 5].sum(), rel_tol=1e-9) and math.isclose(r["crps_walk"], abs(y[t : t + 5].sum()), rel_tol=1e-9)
        assert math.isclose(r["crps_drift"], abs(y[t : t + 5].sum() - 5 * y[3:t].mean()), rel_tol=1e-7)
        draws, a = np.sort(total), r["actual"]
        n = len(draws)
        crps = np.abs(draws - a).mean() - (draws * (2 * np.arange(1, n + 1) - n - 1)).sum() / n**2
        assert abs(crps - r["crps"]) < 0.05


def test_empty_and_short_series(spark, frame):
    _, df = frame
    none = df.limit(0).drop("no")
    assert rows(select_lags(none, "k", "t", "v", **HOW)) == [] and rows(walk_forward(none, "k", "t", "v", F.lit(True), **HOW)) == []
    assert walk_forward(df.where("k = 'short'").drop("no"), "k", "t", "v", F.lit(True), **HOW).count() == 0
