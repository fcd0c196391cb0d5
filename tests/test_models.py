import math

import numpy as np
import pytest

from tidemark.functions import kernels as K
from tidemark.operators import models as M


def test_dtw_like_the_plain_recursion():
    g = np.random.default_rng(1)
    for _ in range(10):
        x, y = g.normal(size=g.integers(1, 12)), g.normal(size=g.integers(1, 12))
        want = np.full((len(x), len(y)), np.inf)
        for i in range(len(x)):
            for j in range(len(y)):
                before = 0 if i == j == 0 else min(want[i - 1, j - 1] if i and j else np.inf, want[i - 1, j] if i else np.inf, want[i, j - 1] if j else np.inf)
                want[i, j] = abs(x[i] - y[j]) + before
        total = K.dtw(x, y)
        assert np.allclose(total, want)
        path = K.dtw_path(total)
        assert path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1) and sum(abs(x[i] - y[j]) for i, j in path) == pytest.approx(total[-1, -1])


def test_medoids_are_members_and_repeatable():
    g = np.random.default_rng(2)
    x = np.vstack([g.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    labels, medoids = K.k_medoids(x, 3)
    assert len({tuple(set(labels[i : i + 30])) for i in (0, 30, 60)}) == 3 and (labels[medoids] == np.arange(3)).all()
    assert (K.k_medoids(x, 3)[0] == labels).all() and len(K.k_medoids(x[:2], 5)[1]) == 2


def test_entropy_pooling_and_resampling():
    x = np.random.default_rng(3).normal(size=(500, 2))
    w = K.entropy_pool(x, np.array([0.2, -0.1]))
    assert w.sum() == pytest.approx(1) and (w > 0).all() and np.allclose(w @ x, [0.2, -0.1], atol=1e-8)
    counts = np.bincount(K.systematic(np.array([0.5, 0.25, 0.25]), 8, 0.5), minlength=3)
    assert list(counts) == [4, 2, 2]


def test_fits_find_what_was_put_in():
    g = np.random.default_rng(4)
    h, r = 1e-4, []
    for _ in range(3000):
        r.append(g.normal() * h**0.5)
        h = 1e-6 + 0.1 * r[-1] ** 2 + 0.88 * h
    omega, a, b = K.garch11(np.array(r))
    assert 0.03 < a < 0.2 and 0.75 < b < 0.97 and omega > 0
    t = np.arange(100)
    d = 120.0 - t
    y = 5 - 0.3 * d**0.5 * (1 + 0.1 * np.cos(7 * np.log(d)))
    assert abs(K.lppl(y, K.seeded("t"))["critical"] - 120) < 8
    k, c = np.linspace(50, 150, 101), None
    c = np.maximum(100 - k, 0) + 5 * np.exp(-(((k - 100) / 15) ** 2))
    density = K.call_density(k, c, 0.0, 1.0)
    assert density.min() >= 0 and (density * 1.0).sum() == pytest.approx(1)
    f, load = K.one_factor(np.column_stack([np.sin(t / 9), -np.sin(t / 9), np.where(t % 3, np.sin(t / 9), np.nan)]))
    assert load[0] * load[1] < 0 < load[0] * load[2] and abs(np.corrcoef(f, np.sin(t / 9))[0, 1]) > 0.95


def test_bridges_end_and_copulas_keep_marginals():
    g = np.random.default_rng(5)
    assert K.bridge(0.3, g.normal(size=20))[-1] == pytest.approx(0.3)
    s = g.exponential(size=(400, 2))
    joint = K.gaussian_copula(s, np.array([[1, 0.8], [0.8, 1]]), 2000, g)
    assert np.corrcoef(joint.T)[0, 1] > 0.5 and np.allclose(np.quantile(joint, 0.5, 0), np.quantile(s, 0.5, 0), atol=0.02)


def test_ridge_is_least_squares_and_selection_uses_the_past(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(300, 2))
    y = 2 * x[:, 0] - x[:, 1] + 3 + g.normal(size=300) * 0.01
    df = spark.createDataFrame([(float(a), float(b), float(c), n // 30) for n, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(None, 1.0, 1.0, 0)], "a double, b double, y double, f int")
    fit = M.ridge(df, ["a", "b"], "y", 0.0)
    assert [round(fit[k], 1) for k in ("a", "b", "const")] == [2.0, -1.0, 3.0]
    errors = M.select_ridge(df, ["a", "b"], "y", "f", [0.0, 1000.0])
    assert errors[0.0] < 0.001 < errors[1000.0]
    with pytest.raises(ValueError, match="rows"):
        M.ridge(df.limit(0), ["a", "b"], "y", 0.0)


def test_paths_do_not_depend_on_partitioning(spark):
    history = np.random.default_rng(7).normal(size=300)
    one = M.block_paths(spark, history, paths=50, horizon=20, seed="s")
    again = M.block_paths(spark, history, paths=50, horizon=20, seed="s").repartition(7)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(one) == key(again) and one.count() == 1000 and {r["r"] for r in one.collect()} <= set(history)
    assert key(M.block_paths(spark, history, paths=50, horizon=20, seed="other")) != key(one)
    ar = M.autoregressive_paths(spark, np.array([[0.5]]), np.array([1.0]), np.array([2.0]), np.zeros((5, 1)), paths=3, horizon=4)
    assert {r["x"] for r in ar.collect()} == {2.0}


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([("a", n, float(n % 7)) for n in range(200)] + [("b", 0, None), ("c", 0, 1.0)], "k string, o int, v double")
    got = {r["k"]: r for r in M.bootstrap_mean(df, "k", "o", "v", replicates=100).collect()}
    assert got["a"]["lo"] <= got["a"]["mean"] <= got["a"]["hi"] and got["c"]["lo"] == 1.0 and "b" not in got


def test_walk_forward_uses_the_whole_history(spark, monkeypatch):
    import datetime as dt

    from tidemark.plans import modelled, views

    g = np.random.default_rng(7)
    x = 100 * np.exp(np.cumsum(np.r_[g.normal(0, 0.05, 400), g.normal(0, 0.001, 900)]))
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=k) for k in range(len(x))]
    p = spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, x, strict=True)], "series string, date date, close double")
    monkeypatch.setattr(views, "prices", lambda *_: p)
    y, losses = np.log(x), []
    for i in range(21, len(x) - 21):
        hist = np.sort(y[21 : i + 1] - y[: i - 20])
        if (days[i].weekday() == 6 or i == len(x) - 1) and len(hist) >= 100:
            real = y[i + 21] - y[i]
            losses.append(np.mean([max(q * (real - f), (q - 1) * (real - f)) for q in (0.1, 0.5, 0.9) for f in [hist[int(np.floor(len(hist) * q))]]]))
    got = modelled.ev07_walk_forward(spark, "").collect()[0]
    assert got["origins"] == len(losses) and got["loss"] == pytest.approx(np.mean(losses), abs=2e-6)


def test_pooling_like_the_kernel_and_without_a_limit(spark):
    g = np.random.default_rng(4)
    x = np.column_stack([g.normal(100, 3, 400), g.random(400)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "path_id long, a double, b double")
    got = M.entropy_pooled(df, ["a", "b"], [101.0, 0.45], keep=["path_id"]).orderBy("path_id").toPandas()["weight"].to_numpy()
    assert np.allclose(got, K.entropy_pool(x, np.array([101.0, 0.45])), atol=1e-9) and abs(got.sum() - 1) < 1e-9
    with pytest.raises(ValueError, match="no weights"):
        M.entropy_pooled(df, ["b"], [1.5], keep=["path_id"])
    assert M.entropy_pooled(df.limit(0), ["a"], [1.0], keep=["path_id"]).collect() == []


def test_systematic_resampling_keeps_the_number_and_the_shares(spark):
    g = np.random.default_rng(5)
    w = g.random(300) ** 3
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "path_id long, weight double")
    copies = M.resampled(df, "path_id", "weight", 0.3).orderBy("path_id").toPandas()["copies"].to_numpy()
    want = np.bincount(K.systematic(w, 300, 0.3), minlength=300)
    assert copies.sum() == 300 and (copies == want).all() and (np.abs(copies - 300 * w / w.sum()) < 1).all()


def test_soft_regimes_and_analogs_like_numpy(spark):
    g = np.random.default_rng(6)
    x, y = g.normal(size=(120, 2)), g.normal(size=120)
    data = [("s", t, float(a), float(b), float(v) if t < 110 else None) for t, ((a, b), v) in enumerate(zip(x, y, strict=True))] + [("s", -1, None, 0.5, None)]
    df = spark.createDataFrame(data, "k string, t int, f double, h double, y double")
    f, h = x[:, 0], np.append(x[:, 1], 0.5)
    q = lambda v: np.quantile(v, [0.25, 0.5, 0.75])
    zf, zh = (f - q(f)[1]) / (q(f)[2] - q(f)[0]), (h[:-1] - q(h)[1]) / (q(h)[2] - q(h)[0])
    p = M.soft_regimes(df, "k", ["f", "h"], {"a": [1.0, 0.0], "b": [0.0, 0.0], "c": [-9.0, 9.0]}, floor=0.02).orderBy("t").toPandas()
    logits = np.column_stack([-0.5 * ((zf - a) ** 2 + (zh - b) ** 2) / 2 for a, b in ((1, 0), (0, 0), (-9, 9))])
    e = np.exp(logits - logits.max(1, keepdims=True))
    e = np.maximum(e / e.sum(1, keepdims=True), 0.02)
    assert np.allclose(p[["a", "b", "c"]].to_numpy()[1:], e / e.sum(1, keepdims=True)) and np.allclose(p[["a", "b", "c"]].sum(1), 1)
    far = ((zf - zf[-1]) ** 2 + (zh - zh[-1]) ** 2)[:110] / 2
    near = y[:110][np.argsort(far, kind="stable")[:15]]
    r = M.analog_quantiles(df, "k", "t", ["f", "h"], "y", [0.2, 0.8], neighbours=15, bound=0.1).first()
    delta = np.median(near) - np.median(y[:110])
    shift = np.clip(delta, -0.1 * y[:110].std(ddof=1), 0.1 * y[:110].std(ddof=1))
    assert r["n"] == 15 and math.isclose(r["shift"], shift, rel_tol=1e-9) and np.allclose(r["q"], np.quantile(near, [0.2, 0.8]) + shift - delta)


def test_horizon_scale_and_baselines(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=500)
    df = spark.createDataFrame([("s", t, float(v), float(np.exp(0.4 * v) * (1 if t % 2 else -1)), 1.0) for t, v in enumerate(x)], "k string, t int, f double, y double, anchor double")
    got = M.horizon_scale(df, "k", ["f"], "y", "anchor", alpha=1e-6).orderBy("t").toPandas()
    assert np.allclose(got["ratio"], np.clip(np.exp(0.4 * x), 0.5, 2.5), atol=1e-3)
    base = {r["baseline"]: r for r in M.baseline_samples(df, "k", "t", "f", horizon=5, count=4000, seed=1).collect()}
    assert set(base) == {"walk", "drift", "ar1", "normal", "history", "blocks"} and base["walk"]["sd"] == 0 and math.isclose(base["drift"]["mean"], 5 * x.mean(), rel_tol=1e-9)
    for name in ("normal", "history", "blocks"):
        assert abs(base[name]["mean"] - 5 * x.mean()) < 0.15 and abs(base[name]["sd"] / (x.std() * 5**0.5) - 1) < 0.1
    assert base["history"]["mean"] == {r["baseline"]: r for r in M.baseline_samples(df.repartition(3), "k", "t", "f", horizon=5, count=4000, seed=1).collect()}["history"]["mean"]
    assert M.baseline_samples(df.limit(2), "k", "t", "f", horizon=5, count=10).collect() == []


def test_medoids_start_at_the_centre_and_use_squared_distances():
    x = np.array([[0.0], [0.1], [-0.1], [5.0], [5.2], [9.0]])
    labels, medoids = K.k_medoids(x, 3)
    assert sorted(labels[:3]) == [labels[0]] * 3 and len(set(labels)) == 3 and set(medoids) >= {0, 5}
    same = K.k_medoids(np.zeros((4, 2)), 2)
    assert len(same[0]) == 4


def test_critical_walk_counts_the_stable_suffix():
    t = np.arange(60)
    y = 5 - 0.5 * (70 - t) ** 0.4
    got = K.critical_walk(y, 56, lambda end: K.seeded("t", end), rounds=15, tolerance=1000.0)
    assert got["fits"] == 5 and got["stable"] == 5 and got["last"] > 60
    assert K.critical_walk(y[:10], 20, lambda end: K.seeded("t", end))["fits"] == 0


def test_paths_of_each_key_come_from_its_own_history(spark):
    data = [("a", t, float(t)) for t in range(30)] + [("b", t, -1.0 - t % 2) for t in range(30)] + [("one", 0, 1.0), ("none", 0, None)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    run = lambda d, chunk: sorted(tuple(r) for r in M.paths_each(d, "k", "t", "v", M.block_draw(5, 3.0), paths=7, horizon=5, seed=1, chunk=chunk).collect())
    got = run(df, 3)
    assert got == run(df.repartition(5), 100) and {r[0] for r in got} == {"a", "b"} and len(got) == 2 * 7 * 5
    assert {r[3] for r in got if r[0] == "b"} == {-1.0, -2.0} and all(0 <= r[3] < 30 for r in got if r[0] == "a")
    draw = M.regime_draw(lambda h: (h > 14).astype(int), [1, 1, 0, 2], 2.0)
    r = draw(np.random.default_rng(2), np.arange(30.0))
    assert r[0] > 14 and r[1] > 14 and r[2] <= 14


def test_density_over_strikes_like_the_kernel(spark):
    from tidemark.operators.scoring import call_density

    k = np.array([80.0, 85, 92, 100, 105, 111, 120])
    c = np.maximum(104 - k, 0) + 3 * np.exp(-np.abs(k - 104) / 8)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(k, c, strict=True)] + [("few", 1.0, 1.0), ("few", 2.0, 0.5)] + [("flat", float(x), 0.0) for x in k], "g string, k double, c double")
    got = {}
    for r in call_density(df, ["g"], "k", "c", rate=0.03, years=0.5).orderBy("k").collect():
        got.setdefault(r["g"], []).append(r["density"])
    assert np.allclose(got["a"], K.call_density(k, c, 0.03, 0.5)) and set(got) == {"a", "flat"} and got["flat"] == [None] * 5


def test_factors_are_aligned():
    g = np.random.default_rng(8)
    f, load = g.normal(size=60), np.array([-1.0, 0.5, -0.8])
    s, new, sign = K.aligned(f, load, [0, 2], slice(0, 40))
    assert sign == -1 and abs(s[:40].mean()) < 1e-12 and abs(s[:40].std(ddof=1) - 1) < 1e-12 and np.allclose(np.outer(s, new) + (-f[:40]).mean() * -load, np.outer(f, load))
    assert K.aligned(f, load, [0, 2], slice(0, 40), before=-new)[2] == 1
    with pytest.raises(ValueError):
        K.aligned(f, load, [0], slice(0, 3))
    with pytest.raises(ValueError):
        K.aligned(f, load, [0], slice(0, 40), before=np.array([1.0, 0.0, -1.2]), least=0.99)
