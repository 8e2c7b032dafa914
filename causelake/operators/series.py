"""Time series, panel and event operators, and tests over ordered data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import DataError
from causelake.functions import special
from causelake.operators.estimate import _row
from causelake.operators.reduce import gram, lag_frame, linear, ranged, running, solve
from causelake.schema import TIME
from causelake.scratch import sized, written


def event_grid(events: DataFrame, time_us: str, value: str, step_us: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Regular grid from the first event: half-open bins, the last event of a bin wins, empty bins are null."""
    start = events.groupBy(*by).agg(F.min(time_us).alias("__t0"), F.max(time_us).alias("__t1"))
    start = written(start, "starts")  # one row a group: broadcast only if few
    bins = start.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__t1") - F.col("__t0")) / step_us).cast("long"))))
    joined = events.join(sized(start), list(by)) if by else events.join(F.broadcast(start))
    held = joined.groupBy(*by, F.floor((F.col(time_us) - F.col("__t0")) / step_us).cast("long").alias("bin")).agg(F.max_by(value, F.struct(time_us, key)).alias("value"))
    return bins.select(*by, "bin").join(held, [*by, "bin"], "left")


def temporal_adjustment(df: DataFrame, t: str, y: str, time: str, lag: int, adjust: Sequence[tuple[str, int]] = (), by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """OLS of y on t at a lag and lagged adjustment columns; rows with any used lag missing drop out."""
    frame = df
    used = {(t, lag), *adjust}
    for c in {c for c, _ in used}:
        frame = lag_frame(frame, [c], sorted({k for x, k in used if x == c}), time, by)
    names = [f"{t}__lag{lag}", *[f"{c}__lag{k}" for c, k in adjust]]
    rows = frame.where(F.col(y).isNotNull())
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    fit = solve(gram(rows, [*names, y]), y, ["1", *names])
    return _row(df, effect=fit[names[0]] * delta, se=fit.se(names[0]) * abs(delta), n=int(fit.n))


def temporal_response(df: DataFrame, t: str, y: str, time: str, lags: Sequence[int], doses: Sequence[float], horizons: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Dose by horizon means under a pulse of the treatment, other lags at zero: one frame and one Gram for all horizons."""
    frame = lag_frame(df, [t], list(lags), time, by)
    names = [f"{t}__lag{k}" for k in lags]
    for n in names:
        frame = frame.where(F.col(n).isNotNull())
    fit = solve(gram(frame.where(F.col(y).isNotNull()), [*names, y]), y, ["1", *names])
    out = [(float(d), int(h), fit["1"] + (fit[f"{t}__lag{h}"] * d if h in lags else 0.0)) for d in doses for h in horizons]
    return df.sparkSession.createDataFrame(out, "dose double, horizon long, mean double")


def lagged_model(df: DataFrame, template: Sequence[tuple[str, int, str]], time: str, by: Sequence[str] = ()) -> dict[tuple[str, int, str], float]:
    """Coefficients of a linear lagged model: each effect regressed on its lagged causes, all lags from one frame."""
    frame = df
    for c in sorted({a for a, _, _ in template}):
        frame = lag_frame(frame, [c], sorted({k for a, k, _ in template if a == c}), time, by)
    out = {}
    for y in sorted({b for _, _, b in template}):
        parents = sorted({(a, k) for a, k, b in template if b == y})
        names = [f"{a}__lag{k}" for a, k in parents]
        rows = frame
        for n in [*names, y]:
            rows = rows.where(F.col(n).isNotNull())
        fit = solve(gram(rows, [*names, y]), y, ["1", *names])
        out |= {(a, k, y): fit[n] for (a, k), n in zip(parents, names)}
    return out


def temporal_mediation_effect(df: DataFrame, template: Sequence[tuple[str, int, str]], t: str, y: str, horizon: int, time: str, by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """Total, direct and mediated effect of t on y over a horizon, by products of lagged coefficients along the paths."""
    from causelake.plans.identify import temporal_mediation

    b = lagged_model(df, template, time, by)
    paths = temporal_mediation(template, t, y, horizon)
    share = {path: math.prod(b[step] for step in path) * delta for path in paths}
    direct = sum(v for path, v in share.items() if len(path) == 1)
    total = sum(share.values())
    return _row(df, total=float(total), direct=float(direct), mediated=float(total - direct), paths=len(paths))


def temporal_predict(df: DataFrame, y: str, parents: Sequence[tuple[str, int]], time: str, by: Sequence[str] = (), do: dict[tuple[str, int], float] | None = None, out: str = "prediction") -> DataFrame:
    """Rows with the linear prediction of y from its lagged parents, some of them set; null where a parent is missing."""
    frame = df
    for c in sorted({a for a, _ in parents}):
        frame = lag_frame(frame, [c], sorted({k for a, k in parents if a == c}), time, by)
    names = [f"{a}__lag{k}" for a, k in parents]
    rows = frame
    for n in [*names, y]:
        rows = rows.where(F.col(n).isNotNull())
    fit = solve(gram(rows, [*names, y]), y, ["1", *names])
    fixed = {f"{a}__lag{k}": F.lit(float(v)) for (a, k), v in (do or {}).items()}
    return frame.withColumn(out, linear(fit.names, fit.beta, fixed)).drop(*names)


def cusum(df: DataFrame, value: str, order: str) -> DataFrame:
    """Largest absolute cumulative demeaned sum and where it is reached, over one series.

    The running sum is taken inside ranges and offset by the ranges before, so no task holds the series.
    """
    parts = ranged(df.select(F.col(order).alias("o"), F.col(value).cast("double").alias("x")), "o").withColumnRenamed("__p", "p")
    mean = parts.agg(F.avg("x").alias("m"))
    local = parts.join(F.broadcast(mean)).withColumn("d", F.col("x") - F.col("m"))
    sums = local.groupBy("p").agg(F.sum("d").alias("s"))
    before = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("b"))
    run = local.withColumn("c", F.sum("d").over(Window.partitionBy("p").orderBy("o"))).join(F.broadcast(before), "p").withColumn("a", F.abs(F.col("c") + F.col("b")))
    return run.agg(F.max("a").alias("statistic"), F.max_by("o", F.struct(F.round("a", 9), -F.col("o"))).alias("at"))


def known_split(df: DataFrame, value: str, after: Column) -> DataFrame:
    """Two-segment Gaussian likelihood ratio of a change in mean and variance at a known split."""
    v = F.col(value).cast("double")
    s = df.agg(F.count(v).alias("n"), F.var_pop(v).alias("v"), F.count(F.when(~after, v)).alias("n0"), F.var_pop(F.when(~after, v)).alias("v0"), F.count(F.when(after, v)).alias("n1"), F.var_pop(F.when(after, v)).alias("v1"))
    return s.select((F.col("n") * F.log("v") - F.col("n0") * F.log("v0") - F.col("n1") * F.log("v1")).alias("lr"), "n0", "n1")


def mean_difference(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Welch statistic of two groups, with the two-sided normal p."""
    v = F.col(value).cast("double")
    side = lambda c, k: [F.avg(F.when(c, v)).alias(f"m{k}"), F.var_samp(F.when(c, v)).alias(f"v{k}"), F.count(F.when(c, v)).alias(f"n{k}")]
    r = df.agg(*side(group, 1), *side(~group, 0)).first()
    z = abs(r["m1"] - r["m0"]) / math.sqrt(r["v1"] / r["n1"] + r["v0"] / r["n0"])
    return _row(df, difference=r["m1"] - r["m0"], statistic=z, p=2 * special.norm_sf(z))


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Classifier AUC by average ranks with tie-corrected variance: one row per distinct value is all that is ordered."""
    levels = df.select(F.col(value).alias("v"), group.alias("g")).groupBy("v").agg(F.sum(F.col("g").cast("double")).alias("a"), F.sum((~F.col("g")).cast("double")).alias("b"))
    run = running(levels, "v", {"below": F.col("b")})
    t = F.col("a") + F.col("b")
    s = run.agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(t**3 - t).alias("ties"))
    n = F.col("n1") + F.col("n0")
    var = F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return s.select((F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"), ((F.col("u") - F.col("n1") * F.col("n0") / 2) / F.sqrt(var)).alias("z"))


def adjust_p(df: DataFrame, p: str = "p", method: str = "bh", out: str = "adjusted") -> DataFrame:
    """BH, BY, Holm or Bonferroni over the whole table of tests.

    Ranks and running extremes are taken inside ranges of p and carried over one row a range.
    """
    if method not in ("bh", "by", "holm", "bonferroni"):
        raise DataError(f"no adjustment {method!r}")
    parts = ranged(df, p)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__c"))
    n = parts.count()
    ahead, behind = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__p").rowsBetween(1, Window.unboundedFollowing)
    before = sizes.select("__p", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__b"))
    ranked = parts.withColumn("__l", F.row_number().over(Window.partitionBy("__p").orderBy(p))).join(F.broadcast(before), "__p").withColumn("__r", F.col("__l") + F.col("__b"))
    if method == "bonferroni":
        value = F.col(p) * n
    elif method == "holm":
        value = F.col(p) * (n - F.col("__r") + 1)
    else:
        value = F.col(p) * n / F.col("__r") * (harmonic(n) if method == "by" else 1.0)
    ranked = ranked.withColumn("__v", value)
    if method != "bonferroni":
        up = method == "holm"
        extreme, pick = (F.max, F.greatest) if up else (F.min, F.least)
        ends = ranked.groupBy("__p").agg(extreme("__v").alias("__e")).select("__p", extreme("__e").over(ahead if up else behind).alias("__o"))
        inside = Window.partitionBy("__p").orderBy(F.col("__r") if up else F.col("__r").desc())
        ranked = ranked.withColumn("__i", extreme("__v").over(inside)).join(F.broadcast(ends), "__p").withColumn("__v", pick("__i", "__o"))
    return ranked.select(*df.columns, F.least(F.lit(1.0), F.col("__v")).alias(out))


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n."""
    if n <= 1_000_000:
        return float((1.0 / np.arange(1, n + 1)).sum())
    return math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)


def rolling_regression(df: DataFrame, x: str, y: str, time: str, window: int, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and residual variance over the last ``window`` rows, from windowed sums."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(-window + 1, 0)
    n = F.count("*").over(w)
    sxx = F.var_pop(x).over(w)
    sxy = F.covar_pop(x, y).over(w)
    slope = F.when((n == window) & (sxx > 0), sxy / sxx)
    return df.withColumn("slope", slope).withColumn("intercept", F.avg(y).over(w) - F.col("slope") * F.avg(x).over(w)).withColumn("residual_variance", F.var_pop(y).over(w) - F.col("slope") * sxy)


def kalman(df: DataFrame, unit: str, time: str, value: str, a: float, process_var: float, obs_var: float, x0: float = 0.0, p0: float = 1.0) -> DataFrame:
    """Filter and smoother of x' = a x + noise, y = x + noise; a recursion, so one group per unit."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        xs, ps, fx, fp, x, p = [], [], [], [], x0, p0
        for y in g[value]:
            x, p = a * x, a * a * p + process_var
            fx.append(x)
            fp.append(p)
            if not (y is None or np.isnan(y)):
                k = p / (p + obs_var)
                x, p = x + k * (y - x), (1 - k) * p
            xs.append(x)
            ps.append(p)
        sm = xs[:]
        for i in range(len(xs) - 2, -1, -1):
            sm[i] = xs[i] + ps[i] * a / fp[i + 1] * (sm[i + 1] - fx[i + 1])
        return pd.DataFrame({unit: g[unit].to_numpy(), time: g[time].to_numpy(), "filtered": xs, "variance": ps, "smoothed": sm})

    kinds = dict(df.dtypes)
    return df.select(unit, time, value).groupBy(unit).applyInPandas(run, f"{unit} {kinds[unit]}, {time} {kinds[time]}, filtered double, variance double, smoothed double")


def phase_surrogate(df: DataFrame, unit: str, time: str, value: str, seed: int) -> DataFrame:
    """A series with the same spectrum and random phases, per unit."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x = g[value].to_numpy(float)
        f = np.fft.rfft(x)
        rng = np.random.default_rng([seed, abs(hash(str(g[unit].iloc[0]))) % (1 << 32) if not str(g[unit].iloc[0]).isdigit() else int(g[unit].iloc[0])])
        phase = np.exp(2j * np.pi * rng.random(len(f)))
        phase[0] = 1
        if len(x) % 2 == 0:
            phase[-1] = 1
        return pd.DataFrame({unit: g[unit].to_numpy(), time: g[time].to_numpy(), "surrogate": np.fft.irfft(f * phase, len(x))})

    kinds = dict(df.dtypes)
    return df.select(unit, time, value).groupBy(unit).applyInPandas(run, f"{unit} {kinds[unit]}, {time} {kinds[time]}, surrogate double")


# --- splits: by the hash of a key, never by partition


def random_split(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0, allow_temporal: bool = False) -> DataFrame:
    """:func:`hash_split`, refused for rows with a declared time unless allowed: it would put the future into training."""
    if TIME in df.columns and not allow_temporal:
        raise DataError("a random split of ordered rows leaks the future: split by time, or allow it")
    return hash_split(df, key, fraction, seed)


def hash_split(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    from causelake.functions.transforms import uniform

    return df.withColumn("train", uniform(seed, "split", *key) < fraction)


def rolling_origin(df: DataFrame, time: str, first: int, step: int, horizon: int, folds: int) -> DataFrame:
    """Rows with a fold number and whether they train: all before the fold's origin, tests in the horizon after it."""
    f = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("__o", F.lit(first) + F.col("fold") * step)
    return f.where(F.col(time) < F.col("__o") + horizon).withColumn("train", F.col(time) < F.col("__o")).drop("__o")


def discovery_estimation_split(df: DataFrame, time: str, cut: int, gap: int) -> DataFrame:
    """Disjoint time ranges with a gap between them."""
    part = F.when(F.col(time) < cut, "discovery").when(F.col(time) >= cut + gap, "estimation")
    return df.withColumn("part", part).where("part is not null")


def block_resample(df: DataFrame, time: str, length: int, n: int, replicate_count: int, seed: int, kind: str = "moving") -> DataFrame:
    """Index plan (replicate, position, source) of block bootstraps of a series of n steps, joined to its rows."""
    from causelake.functions.transforms import uniform

    spark = df.sparkSession
    blocks = math.ceil(n / length)
    plan = spark.range(replicate_count).withColumnRenamed("id", "replicate").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    u = uniform(seed, "block", "replicate", "block")
    top = n if kind == "circular" else n - length + 1
    plan = plan.withColumn("start", F.floor(u * top)).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    plan = plan.withColumn("position", F.col("block") * length + F.col("offset")).where(F.col("position") < n)
    plan = plan.select("replicate", "position", ((F.col("start") + F.col("offset")) % n).alias(time))
    return plan.join(df, time)


def stationary_resample(df: DataFrame, time: str, n: int, mean_length: float, replicate_count: int, seed: int) -> DataFrame:
    """Blocks of geometric length, wrapped: a position starts a block with probability 1 / mean_length, else follows on."""
    from causelake.functions.transforms import uniform

    p = df.sparkSession.range(replicate_count).withColumnRenamed("id", "replicate").withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    begins = (F.col("position") == 0) | (uniform(seed, "begin", "replicate", "position") < 1 / mean_length)
    start = F.when(begins, F.struct(F.floor(uniform(seed, "start", "replicate", "position") * n).alias("s"), F.col("position").alias("at")))
    held = F.last(start, ignorenulls=True).over(Window.partitionBy("replicate").orderBy("position"))
    p = p.withColumn("__b", held).select("replicate", "position", ((F.col("__b.s") + F.col("position") - F.col("__b.at")) % n).alias(time))
    return p.join(df, time)


def group_holdout(df: DataFrame, column: str, ids: Sequence[object], discovery: int, part: str = "part") -> DataFrame:
    """Whole environments or regimes on one side: the first ``discovery`` of the listed ids for discovery, the others for estimation.

    Rows of ids that are not listed go; nothing is copied, ``part`` says the side.
    """
    if len(set(ids)) != len(ids) or not 0 < discovery < len(ids):
        raise DataError("list distinct ids, with at least one on each side")
    side = F.when(F.col(column).isin(list(ids[:discovery])), "discovery").when(F.col(column).isin(list(ids[discovery:])), "estimation")
    return df.withColumn(part, side).where(F.col(part).isNotNull())


def holdout_errors(df: DataFrame, y: str, x: Sequence[str], environment: str) -> DataFrame:
    """``environment, n, rmse``: each environment predicted by a linear fit of all the others, from one grouped Gram (few environments)."""
    grams = gram(df, [*x, y], by=[environment])
    if len(grams) < 2:
        raise DataError("a holdout needs two environments")
    rows = []
    for key, own in grams.items():
        others = [g for k, g in grams.items() if k != key]
        fit = solve(sum(others[1:], others[0]), y, ["1", *x])
        v = np.append(-np.array([fit[c] for c in ("1", *x)]), 1.0)
        names = ["1", *x, y]
        rows.append((str(key[0]), int(own.n), math.sqrt(max(0.0, float(v @ own.sub(names, names) @ v)) / own.n)))
    return df.sparkSession.createDataFrame(rows, "environment string, n long, rmse double")
