"""Fits and simulations: sums in the engine, small linear algebra on the driver, paths in Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators.ranks import quantiles, running_totals
from tidemark.session import cut_lineage


def gram(df: DataFrame, xs: Sequence[str], y: str, by: str | None = None) -> dict[object, tuple[np.ndarray, np.ndarray, float, int]]:
    """X'X with a constant, X'y, y'y and n, per value of ``by``: one aggregation of sums.

    Only (k + 1)^2 numbers per group come to the driver; keep the groups few (folds).
    """
    names = [*xs, "_one"]
    d = df.dropna(subset=[*xs, y]).withColumn("_one", F.lit(1.0)).withColumn("_g", F.col(by) if by else F.lit(0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"t{i}") for i, a in enumerate(names)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")]
    out = {}
    for r in d.groupBy("_g").agg(*sums).collect():
        k = len(names)
        xx = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        out[r["_g"]] = (xx, np.array([r[f"t{i}"] for i in range(k)], float), float(r["yy"]), int(r["n"]))
    return out


def solve(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge coefficients; the constant (last) isn't penalised."""
    penalty = alpha * np.eye(len(xx))
    penalty[-1, -1] = 0.0
    return np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]


def ridge(df: DataFrame, xs: Sequence[str], y: str, alpha: float) -> dict[str, float]:
    """Coefficients by name, ``const`` last; rows with nulls are left out; no rows raise."""
    fits = gram(df, xs, y)
    if not fits:
        raise ValueError("no complete rows")
    xx, xy, *_ = fits[0]
    return dict(zip([*xs, "const"], solve(xx, xy, alpha), strict=True))


def select_ridge(df: DataFrame, xs: Sequence[str], y: str, fold: str, alphas: Sequence[float], purge: int = 1) -> dict[float, float]:
    """Mean squared error of each penalty over expanding folds: trained on the folds before, ``purge`` left out between.

    One pass over the data: the Gram matrices of the folds add up to those of the training parts.
    """
    parts = gram(df, xs, y, fold)
    order = sorted(parts)
    errors = {a: [0.0, 0] for a in alphas}
    for at in range(purge + 1, len(order)):
        train = [parts[k] for k in order[: at - purge]]
        xx, xy = sum(p[0] for p in train), sum(p[1] for p in train)
        txx, txy, tyy, n = parts[order[at]]
        for a in alphas:
            b = solve(xx, xy, a)
            errors[a][0] += tyy - 2 * b @ txy + b @ txx @ b
            errors[a][1] += n
    return {a: e / n if n else float("nan") for a, (e, n) in errors.items()}


def _simulated(spark: SparkSession, paths: int, horizon: int, seed: object, draw: Callable[[np.random.Generator], np.ndarray]) -> DataFrame:
    """(path_id, step, r): one generator per path, so any partitioning gives the same paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            r = np.stack([draw(K.seeded(seed, int(i))) for i in ids]) if len(ids) else np.empty((0, horizon))
            yield pd.DataFrame({"path_id": np.repeat(ids, horizon), "step": np.tile(np.arange(horizon, dtype=np.int32), len(ids)), "r": r.ravel()})

    return spark.range(paths).mapInPandas(run, "path_id long, step int, r double")


def block_paths(spark: SparkSession, returns: Sequence[float], *, paths: int, horizon: int, mean_block: float = 10.0, seed: object = 0) -> DataFrame:
    """Stationary-bootstrap paths of one history (at most some ten thousand returns, sent with the function)."""
    history = np.asarray(returns, float)
    return _simulated(spark, paths, horizon, seed, lambda g: history[K.stationary_indices(g, len(history), horizon, mean_block)])


def paths_each(df: DataFrame, key: str, order: str, value: str, draw: Callable[[np.random.Generator, np.ndarray], np.ndarray], *, paths: int, horizon: int, seed: object = 0, chunk: int = 250) -> DataFrame:
    """(key, path_id, step, r): simulated paths of each key from its own ordered history, ``draw(generator, history)`` giving one.

    A key's history (a series of at most a value a day) goes to as many tasks as its paths
    have chunks. One generator per key and path, so any partitioning gives the same paths;
    keys with fewer than two values have none.
    """
    kind = df.schema[key].dataType.simpleString()
    ordered = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias("v")).where(F.size("v") > 1)
    work = ordered.withColumn("begin", F.explode(F.array(*(F.lit(b) for b in range(0, paths, chunk)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, v, begin in zip(batch[key], batch["v"], batch["begin"], strict=True):
                ids, history = np.arange(begin, min(begin + chunk, paths)), np.asarray(v, float)
                r = np.stack([draw(K.seeded(seed, k, int(i)), history) for i in ids])
                yield pd.DataFrame({key: k, "path_id": np.repeat(ids, horizon), "step": np.tile(np.arange(horizon, dtype=np.int32), len(ids)), "r": r.ravel()})

    return work.mapInPandas(run, f"`{key}` {kind}, path_id long, step int, r double")


def block_draw(horizon: int, mean_block: float = 10.0) -> Callable[[np.random.Generator, np.ndarray], np.ndarray]:
    """Stationary bootstrap of the history."""
    return lambda g, h: h[K.stationary_indices(g, len(h), horizon, mean_block)]


def regime_draw(label: Callable[[np.ndarray], np.ndarray], order: Sequence[int], mean_block: float = 10.0) -> Callable[[np.random.Generator, np.ndarray], np.ndarray]:
    """Stretches from the history's regimes in a given order, ``label`` telling each of its values' regime; of a regime without history all of it."""
    steps = np.asarray(order)

    def draw(g: np.random.Generator, h: np.ndarray) -> np.ndarray:
        of, out = label(h), np.empty(len(steps))
        for k in np.unique(steps):
            at, pool = np.flatnonzero(steps == k), h[of == k]
            pool = pool if len(pool) else h
            out[at] = pool[K.stationary_indices(g, len(pool), len(at), mean_block)]
        return out

    return draw


def autoregressive_paths(spark: SparkSession, coefficients: np.ndarray, const: np.ndarray, start: np.ndarray, residuals: np.ndarray, *, paths: int, horizon: int, seed: object = 0, mean_block: float = 5.0) -> DataFrame:
    """Paths of a vector autoregression of order one with resampled residual rows: (path_id, step, k, x)."""
    a, c, x0, e = (np.asarray(v, float) for v in (coefficients, const, start, residuals))
    k = len(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            shocks = np.stack([e[K.stationary_indices(K.seeded(seed, int(i)), len(e), horizon, mean_block)] for i in ids]) if len(ids) else np.empty((0, horizon, k))
            x, out = np.tile(x0, (len(ids), 1)), np.empty((len(ids), horizon, k))
            for step in range(horizon):
                x = c + x @ a.T + shocks[:, step]
                out[:, step] = x
            yield pd.DataFrame({"path_id": np.repeat(ids, horizon * k), "step": np.tile(np.repeat(np.arange(horizon, dtype=np.int32), k), len(ids)), "k": np.tile(np.arange(k, dtype=np.int32), len(ids) * horizon), "x": out.ravel()})

    return spark.range(paths).mapInPandas(run, "path_id long, step int, k int, x double")


def bootstrap_mean(df: DataFrame, key: str, order: str, value: str, *, replicates: int = 1000, mean_block: float = 10.0, confidence: float = 0.9, seed: object = 0) -> DataFrame:
    """(key, n, mean, lo, hi): stationary-bootstrap interval of the mean of each key's ordered values.

    For series with at most a value per day: a key's values are one array.
    """
    ordered = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias("v"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch["v"], strict=True):
                x, g = np.asarray(v, float), K.seeded(seed, k)
                means = [x[K.stationary_indices(g, len(x), len(x), mean_block)].mean() for _ in range(replicates)]
                lo, hi = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
                out.append((k, len(x), x.mean(), lo, hi))
            yield pd.DataFrame(out, columns=[key, "n", "mean", "lo", "hi"])

    return ordered.mapInPandas(run, f"`{key}` {kind}, n long, mean double, lo double, hi double")


def fit_each(df: DataFrame, key: str, order: str, value: str, fit: Callable[[object, np.ndarray], dict[str, float]], fields: Sequence[str]) -> DataFrame:
    """One fit per key over its ordered values (a series of at most a value per day): (key, fields...)."""
    ordered = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias("v"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fit(k, np.asarray(v, float)) for k, v in zip(batch[key], batch["v"], strict=True)]
            yield pd.DataFrame({key: batch[key], **{f: [x.get(f) for x in found] for f in fields}})

    return ordered.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{f} double" for f in fields))


def cluster_each(df: DataFrame, key: str, id: str, features: Sequence[str], k: int) -> DataFrame:  # noqa: A002
    """k-medoids per key over its rows (month-ends and the like, some thousand at most): (key, id, cluster, medoid)."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, id)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id).reset_index(drop=True)
        labels, medoids = K.k_medoids(part[list(features)].to_numpy(), k)
        return pd.DataFrame({key: part[key], id: part[id], "cluster": labels.astype("int32"), "medoid": part.index.isin(medoids)})

    return df.select(key, id, *features).dropna().groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{id}` {kinds[id]}, cluster int, medoid boolean")


def warp_each(df: DataFrame, key: str, order: str, value: str, reference: Sequence[float]) -> DataFrame:
    """Open-end time warping of each key's ordered logarithms against a reference: (key, distance, end, steps)."""
    ref = np.asarray(reference, float)

    def fit(_: object, v: np.ndarray) -> dict[str, float]:
        total = K.dtw(np.log(v), ref)
        j = K.open_end(total)
        return {"distance": float(total[-1, j] / (len(v) + j + 1)), "last": float(j), "steps": float(len(K.dtw_path(total, j)))}

    return fit_each(df, key, order, value, fit, ["distance", "last", "steps"])


def entropy_pooled(rows: DataFrame, views: Sequence[str], targets: Sequence[float], *, keep: Sequence[str], steps: int = 100) -> DataFrame:
    """The rows' ``keep`` columns with ``weight``: nearest to equal weights in entropy such that the views' means are the targets.

    Newton on the dual, at most a handful of numbers; each step is one aggregation over all
    rows (their weights, weighted views and products), so rows never come to the driver.
    Raises if the targets can't be met (they lie outside what the rows span).
    """
    k = len(views)
    # read once for each step: narrow and checkpointed
    rows = cut_lineage(rows.select(*dict.fromkeys([*keep, *views])))
    scale = rows.agg(F.count(F.lit(1)).alias("n"), *(F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(views)), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(views))).first()
    if not scale["n"]:
        return rows.select(*keep, F.lit(None).cast("double").alias("weight"))
    sd = np.array([scale[f"s{i}"] or 1.0 for i in range(k)])
    mid = np.array([scale[f"m{i}"] for i in range(k)])
    a = [(F.col(v) - F.lit(float(m))) / F.lit(float(s)) for v, m, s in zip(views, mid, sd, strict=True)]
    b = (np.asarray(targets, float) - mid) / sd

    def logs(x: np.ndarray) -> Column:
        return sum((F.lit(float(xi)) * ai for xi, ai in zip(x, a, strict=True)), F.lit(0.0))

    def sums(x: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        top = float(rows.agg(F.max(logs(x))).first()[0]) if x.any() else 0.0
        w = F.exp(logs(x) - F.lit(top))
        r = rows.agg(F.sum(w).alias("w"), *(F.sum(w * a[i]).alias(f"a{i}") for i in range(k)), *(F.sum(w * a[i] * a[j]).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k))).first()
        mean = np.array([r[f"a{i}"] for i in range(k)]) / r["w"]
        square = np.array([[r[f"b{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / r["w"]
        return top, float(r["w"]), mean, square

    x = np.zeros(k)
    top, mass, mean, square = sums(x)
    for _ in range(steps):
        slope = mean - b
        if np.abs(slope).max() < 1e-9:
            break
        value = np.log(mass) + top - x @ b
        move, size = np.linalg.solve(square - np.outer(mean, mean) + 1e-12 * np.eye(k), slope), 1.0
        while size > 1e-8:
            fresh = sums(x - size * move)
            if np.log(fresh[1]) + fresh[0] - (x - size * move) @ b < value:
                x, (top, mass, mean, square) = x - size * move, fresh
                break
            size /= 2
        else:
            break
    if np.abs(mean - b).max() > 1e-4:
        raise ValueError("no weights have these means")
    return rows.select(*keep, (F.exp(logs(x) - F.lit(top)) / F.lit(mass)).alias("weight"))


def overlay_weights(ends: DataFrame, target: float, value: str = "fin") -> DataFrame:
    """(path_id, weight): weights that move the paths' mean end to ``target`` and change as little else as can be."""
    return entropy_pooled(ends, [value], [target], keep=["path_id"])


def kernel_weights(ends: DataFrame, value: str, target: float) -> DataFrame:
    """The rows with ``weight``, summing to one: a normal kernel around the target, as wide as the values' spread."""
    spread = ends.agg(F.greatest(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(1e-8)).alias("_h"))
    near = ends.crossJoin(F.broadcast(spread)).withColumn("_z", (F.col(value) - F.lit(float(target))) / F.col("_h"))  # one row
    u = near.withColumn("_u", F.exp(-0.5 * F.col("_z") * F.col("_z")))
    return u.crossJoin(F.broadcast(u.agg(F.sum("_u").alias("_t")))).withColumn("weight", F.col("_u") / F.col("_t")).drop("_h", "_z", "_u", "_t")  # one row


def resampled(rows: DataFrame, id: str, weight: str, u: float = 0.5) -> DataFrame:  # noqa: A002
    """The rows with ``copies``: systematic resampling by one uniform number, as many copies in all as there are rows.

    A row's copies are the points (k + u) / n between the cumulative weight before it and its own, by
    ``id``; the cumulative weights come from :func:`ranks.running_totals`, so nothing is sampled in one place.
    """
    t = running_totals(rows, [], id, {"_w": F.col(weight), "_n": F.lit(1)})
    point = lambda c: F.ceil(F.col("_n_all") * F.round(c / F.col("_w_all"), 12) - u)
    each = t.select(id, (point(F.col("_w_before") + F.col("_w")) - point(F.col("_w_before"))).cast("long").alias("copies"))
    return rows.join(each, id)


def soft_regimes(df: DataFrame, key: str, features: Sequence[str], centres: dict[str, Sequence[float]], floor: float = 0.01) -> DataFrame:
    """The rows with a probability per regime: softmax of the mean squared distance of robust scores to each centre, floored.

    Scores are (value - median) / interquartile range of the key; a missing value counts as the median.
    """
    out = df
    for i, f in enumerate(features):
        q = quantiles(df, [key], f, [0.25, 0.5, 0.75]).select(F.col(key).alias("_k"), F.col("q").alias(f"_q{i}"))
        out = out.join(q, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    z = [F.coalesce((F.col(f) - F.col(f"_q{i}")[1]) / F.when(F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0] > 1e-12, F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).otherwise(1.0), F.lit(0.0)) for i, f in enumerate(features)]
    logit = {r: -0.5 * sum(((zi - c) * (zi - c) for zi, c in zip(z, at, strict=True)), F.lit(0.0)) / len(features) for r, at in centres.items()}
    out = out.select(*df.columns, *(v.alias(f"_l_{r}") for r, v in logit.items()))
    top = F.greatest(*(F.col(f"_l_{r}") for r in centres)) if len(centres) > 1 else F.col(f"_l_{next(iter(centres))}")
    e = {r: F.exp(F.col(f"_l_{r}") - top) for r in centres}
    total = sum(e.values(), F.lit(0.0))
    p = {r: F.greatest(v / total, F.lit(floor)) for r, v in e.items()}
    mass = sum(p.values(), F.lit(0.0))
    return out.select(*df.columns, *((v / mass).alias(r) for r, v in p.items()))


def analog_quantiles(df: DataFrame, key: str, order: str, features: Sequence[str], target: str, levels: Sequence[float], *, neighbours: int = 50, bound: float = 0.5) -> DataFrame:
    """Quantiles of what followed the rows most like a key's last one: (key, n, shift, q).

    Rows with a target are candidates, near by the mean squared distance of robust scores (ties
    by ``order``). The neighbours' median may lie ``bound`` standard deviations of all targets
    off the median of all; what is more is taken back from every quantile (``shift`` is what stays).
    For series of at most a value a day.
    """
    last = df.groupBy(key).agg(F.max_by(F.struct(*features), order).alias("_here"))
    spread = df
    for i, f in enumerate(features):
        q = quantiles(df, [key], f, [0.25, 0.5, 0.75]).select(F.col(key).alias("_k"), F.col("q").alias(f"_q{i}"))
        spread = spread.join(q, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    here = spread.where(F.col(target).isNotNull()).join(last.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    clean = lambda c, i: F.coalesce(c, F.col(f"_q{i}")[1])
    width = lambda i: F.when(F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0] > 1e-12, F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).otherwise(1.0)
    gap = [(clean(F.col(f), i) - clean(F.col("_here")[f], i)) / width(i) for i, f in enumerate(features)]
    far = here.withColumn("_d", F.round(sum((g * g for g in gap), F.lit(0.0)) / len(features), 12))
    w = Window.partitionBy(key).orderBy("_d", order)
    near = far.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= neighbours)
    picked = near.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile({target}, array({', '.join(repr(float(p)) for p in (0.5, *levels))}))").alias("_p"))  # at most ``neighbours`` values
    base = quantiles(df.where(F.col(target).isNotNull()), [key], target, [0.5]).select(F.col(key).alias("_k"), F.col("q")[0].alias("_m"))
    sd = df.groupBy(F.col(key).alias("_j")).agg(F.stddev_samp(target).alias("_sd"))
    both = picked.join(base, F.col(key).eqNullSafe(F.col("_k"))).join(sd, F.col(key).eqNullSafe(F.col("_j")))
    delta = F.col("_p")[0] - F.col("_m")
    stays = F.least(F.greatest(delta, -bound * F.col("_sd")), bound * F.col("_sd"))
    return both.select(key, "n", stays.alias("shift"), F.transform(F.slice("_p", 2, len(levels)), lambda x: x + stays - delta).alias("q"))


def horizon_scale(df: DataFrame, key: str, features: Sequence[str], target: str, anchor: str, *, alpha: float = 10.0, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """The rows with ``ratio``: how much wider than its anchor the target's spread is expected, kept within bounds.

    Ridge of log(|target| / anchor) on the features per key; sums in the engine, a few numbers per key on the driver.
    """
    y = F.log(F.greatest(F.abs(F.col(target)), F.lit(1e-8)) / F.greatest(F.col(anchor), F.lit(1e-8)))
    fits = {k: solve(xx, xy, alpha) for k, (xx, xy, _, _) in gram(df.withColumn("_y", y), list(features), "_y", key).items()}
    if not fits:
        return df.withColumn("ratio", F.lit(None).cast("double"))
    table = F.create_map(*(x for k, b in fits.items() for x in (F.lit(k), F.array(*(F.lit(float(v)) for v in b)))))
    b = table[F.col(key)]
    line = sum((b[i] * F.col(f) for i, f in enumerate(features)), b[len(features)])
    return df.withColumn("ratio", F.least(F.lit(high), F.greatest(F.lit(low), F.exp(line))))


def baseline_samples(df: DataFrame, key: str, order: str, value: str, *, horizon: int, count: int, seed: object = 0) -> DataFrame:
    """(key, baseline, mean, sd) of ``count`` sums of the next ``horizon`` values: random walk, drift, AR(1), normal, history, blocks.

    For series of at most a value a day; every draw depends on seed, key and baseline only.
    """
    kind = df.schema[key].dataType.simpleString()
    ordered = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch["v"], strict=True):
                for name, drawn in K.baselines(np.asarray(v, float), horizon, count, lambda name, k=k: K.seeded(seed, k, name)).items():
                    out.append((k, name, drawn.mean(), drawn.std()))
            yield pd.DataFrame(out, columns=[key, "baseline", "mean", "sd"])

    return ordered.mapInPandas(run, f"`{key}` {kind}, baseline string, mean double, sd double")
