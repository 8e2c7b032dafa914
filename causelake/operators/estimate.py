"""Effect estimators.  Each is one or two aggregates; its result is a small DataFrame.

Weights, strata and scores are column expressions; only p x p algebra happens on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import EstimationError, Unsupported
from causelake.functions import special
from causelake.operators.neighbours import PAIRS, Tree, halved, home, levels_of, within
from causelake.operators.reduce import Fit, gram, irls, linear, ranged, running, sandwich, solve
from causelake.schema import complete_cases
from causelake.scratch import sized, written

TARGETS = ("ate", "att", "atc")
#: Doses at which a pseudo-outcome's marginal density is tabulated.
KNOTS = 257


def _row(df: DataFrame, **values) -> DataFrame:
    kinds = {float: "double", int: "long", str: "string", bool: "boolean"}
    values = {k: float(v) if isinstance(v, np.floating) else v for k, v in values.items()}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in values.items())
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def _treated(t: str) -> Column:
    return F.col(t).cast("double") > 0.5


# --- outcome regression


def linear_adjustment(df: DataFrame, t: str, y: str, z: Sequence[str] = (), delta: float = 1.0, se: str = "homoskedastic", ridge: float = 0.0, clusters: Sequence[str] = ()) -> DataFrame:
    """OLS of y on 1, t, z over complete cases: effect beta_t * delta."""
    rows = complete_cases(df, [t, y, *z], clusters)
    fit = solve(gram(rows, [t, *z, y]), y, ["1", t, *z], ridge)
    if se == "homoskedastic":
        error = fit.se(t)
    else:
        i = fit.names.index(t)
        error = math.sqrt(sandwich(rows, fit, y, se, clusters)[i, i])
    return _row(df, effect=fit[t] * delta, se=error * abs(delta), n=int(fit.n))


def huber_adjustment(df: DataFrame, t: str, y: str, z: Sequence[str] = (), k: float = 1.345, rounds: int = 50) -> DataFrame:
    """Huber M-estimate by reweighted Grams; the scale is the residuals' MAD."""
    rows = complete_cases(df, [t, y, *z]).persist()
    try:
        design = ["1", t, *z]
        fit = solve(gram(rows, [t, *z, y]), y, design)
        for _ in range(rounds):
            r = F.col(y) - linear(design, fit.beta)
            mad = rows.agg(F.percentile(F.abs(r), F.lit(0.5))).first()[0] / 0.6744897501960817 or 1e-12
            w = F.least(F.lit(1.0), F.lit(k * mad) / F.greatest(F.abs(r), F.lit(1e-300)))
            new = solve(gram(rows.withColumn("__w", w), [t, *z, y]), y, design)
            done = np.abs(new.beta - fit.beta).max() < 1e-8 * (1 + np.abs(fit.beta).max())
            fit = new
            if done:
                break
        return _row(df, effect=fit[t], n=int(rows.count()))
    finally:
        rows.unpersist()


def glm_adjustment(df: DataFrame, t: str, y: str, z: Sequence[str] = (), active: float = 1.0, control: float = 0.0, family: str = "logit") -> DataFrame:
    """G-computation through a GLM: mean predicted difference between two levels, with the delta-method error of the coefficients."""
    rows = complete_cases(df, [t, y, *z])
    design = ["1", t, *z]
    beta, cov = irls(rows, y, design, family)
    mean = {"logit": lambda e: 1 / (1 + F.exp(-e)), "poisson": F.exp, "gaussian": lambda e: e}[family]
    slope = {"logit": lambda m: m * (1 - m), "poisson": lambda m: m, "gaussian": lambda m: F.lit(1.0)}[family]
    at = lambda level: mean(linear(design, beta, {t: F.lit(level)}))
    x = lambda d, level: F.lit(1.0) if d == "1" else F.lit(float(level)) if d == t else F.col(d).cast("double")
    pull = [F.avg(slope(at(active)) * x(d, active) - slope(at(control)) * x(d, control)).alias(f"g{i}") for i, d in enumerate(design)]
    extra = [F.avg((F.col(y).cast("double") - linear(design, beta)) ** 2).alias("v")] if family == "gaussian" else []
    r = rows.agg(F.avg(at(active) - at(control)).alias("effect"), F.count("*").alias("n"), *pull, *extra).first()
    g = np.array([r[f"g{i}"] for i in range(len(design))])
    scale = r["v"] * r["n"] / (r["n"] - len(design)) if extra else 1.0
    return _row(df, effect=r["effect"], se=math.sqrt(scale * float(g @ cov @ g)), n=int(r["n"]))


def conditional_effect(df: DataFrame, t: str, y: str, w: str, z: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """(beta_t + beta_tw * mean w) * delta with one modifier; the mean is held fixed in the standard error."""
    rows = complete_cases(df, [t, y, w, *z])
    g = gram(rows, {t: t, w: w, "__tw": F.col(t).cast("double") * F.col(w).cast("double"), **{c: c for c in z}, y: y})
    if g.n < 8:
        raise EstimationError("fewer than eight complete rows")
    fit = solve(g, y, ["1", t, w, "__tw", *z])
    mean = g.mean(w)
    i, j = fit.names.index(t), fit.names.index("__tw")
    var = fit.sigma2 * (fit.inverse[i, i] + 2 * mean * fit.inverse[i, j] + mean**2 * fit.inverse[j, j])
    return _row(df, effect=(fit[t] + fit["__tw"] * mean) * delta, se=math.sqrt(var) * abs(delta), modifier_mean=mean, n=int(g.n))


# --- propensity


def propensity(df: DataFrame, t: str, z: Sequence[str], clip: float = 0.01, out: str = "e") -> DataFrame:
    """Rows with a logistic propensity clipped to [clip, 1 - clip]."""
    design = ["1", *z]
    beta, _ = irls(df, t, design)
    e = 1 / (1 + F.exp(-linear(design, beta)))
    return df.withColumn(out, F.greatest(F.lit(clip), F.least(F.lit(1 - clip), e)))


def saturated_propensity(df: DataFrame, t: str, z: Sequence[str], clip: float = 0.01, out: str = "e") -> DataFrame:
    """The logistic maximum-likelihood propensity of a saturated design: the cell's share of treated rows."""
    cells = df.groupBy(*z).agg(F.avg(_treated(t).cast("double")).alias("__e"))
    e = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("__e")))
    return df.join(cells, list(z)).withColumn(out, e).drop("__e")


def ipw_weights(t: str, e: str, target: str) -> Column:
    p, a = F.col(e), _treated(t)
    if target == "ate":
        return F.when(a, 1 / p).otherwise(1 / (1 - p))
    if target == "att":
        return F.when(a, 1.0).otherwise(p / (1 - p))
    if target == "atc":
        return F.when(a, (1 - p) / p).otherwise(1.0)
    raise Unsupported(f"no target {target!r}")


def rank_by_positivity(df: DataFrame, t: str, sets: Sequence[Sequence[str]], floor: float = 0.05) -> DataFrame:
    """Adjustment sets by how well both arms occur in their cells: share of rows in cells without positivity, then least share, then name."""
    parts = []
    for z in sets:
        cells = df.groupBy(*z).agg(F.avg(_treated(t).cast("double")).alias("e"), F.count("*").alias("n"))
        side = F.least("e", 1 - F.col("e"))
        parts.append(cells.agg(F.lit(",".join(z)).alias("adjustment"), (F.sum(F.when(side < floor, F.col("n")).otherwise(0)) / F.sum("n")).alias("violating"), F.min(side).alias("least_share")))
    return fold(DataFrame.unionByName, parts).orderBy("violating", F.desc("least_share"), "adjustment")


def trim(df: DataFrame, e: str, threshold: float) -> DataFrame:
    """Drops rows whose raw score lies outside [threshold, 1 - threshold]."""
    return df.where(F.col(e).between(threshold, 1 - threshold))


def ipw(df: DataFrame, t: str, y: str, e: str = "e", target: str = "ate") -> DataFrame:
    """Hajek difference of weighted means; an arm without weight divides by zero and raises."""
    w, a = ipw_weights(t, e, target), _treated(t)
    mean = lambda arm: F.sum(F.when(arm, w * F.col(y))) / F.sum(F.when(arm, w))
    return df.agg((mean(a) - mean(~a)).alias("effect"), F.count("*").alias("n"))


def ipw_se(df: DataFrame, t: str, y: str, z: Sequence[str], e: str = "e", target: str = "ate") -> DataFrame:
    """Hajek estimate with the influence-function error, residualised on the propensity scores."""
    w, a = ipw_weights(t, e, target), _treated(t)
    s = df.agg(*[f.alias(k) for k, f in {
        "w1": F.sum(F.when(a, w)), "w0": F.sum(F.when(~a, w)), "y1": F.sum(F.when(a, w * F.col(y))), "y0": F.sum(F.when(~a, w * F.col(y))), "n": F.count("*")}.items()]).first()
    m1, m0, n = s["y1"] / s["w1"], s["y0"] / s["w0"], s["n"]
    psi = F.when(a, n * w / s["w1"] * (F.col(y) - m1)).otherwise(-(n * w / s["w0"]) * (F.col(y) - m0))
    scores = {f"__s{i}": (F.lit(1.0) if c == "1" else F.col(c)) * (F.col(t) - F.col(e)) for i, c in enumerate(["1", *z])}
    fit = solve(gram(df, {**scores, "__psi": psi}), "__psi", list(scores))
    return _row(df, effect=m1 - m0, se=math.sqrt(fit.rss / (n - 1)) / math.sqrt(n), n=int(n))


def aipw(df: DataFrame, t: str, y: str, e: str = "e", m1: str = "m1", m0: str = "m0", target: str = "ate") -> DataFrame:
    """Doubly robust mean of the score for the target, with the error of its influence function for given scores."""
    a, p, o = F.col(t).cast("double"), F.col(e), F.col(y)
    u1, u0 = F.col(m1), F.col(m0)
    if target == "ate":
        score, member = u1 - u0 + a * (o - u1) / p - (1 - a) * (o - u0) / (1 - p), F.lit(1.0)
    elif target == "att":
        score, member = a * (o - u0) - (1 - a) * p / (1 - p) * (o - u0), a
    elif target == "atc":
        score, member = a * (1 - p) / p * (o - u1) - (1 - a) * (o - u1), 1 - a
    else:
        raise Unsupported(f"no target {target!r}")
    # the effect solves mean(score - effect * member) = 0; its error is that of this mean over the share of members
    s = df.agg(F.avg(score).alias("s"), F.avg(member).alias("h"), F.var_samp(score).alias("ss"), F.covar_samp(score, member).alias("sh"), F.var_samp(member).alias("hh"), F.count("*").alias("n"))
    effect = F.col("s") / F.col("h")
    spread = F.col("ss") - 2 * effect * F.col("sh") + effect * effect * F.col("hh")
    return s.select(effect.alias("effect"), (F.sqrt(F.greatest(F.lit(0.0), spread) / F.col("n")) / F.col("h")).alias("se_plain"), "n")


def arm_means(df: DataFrame, t: str, y: str, z: Sequence[str]) -> DataFrame:
    """Saturated outcome models: the mean of each arm in each cell."""
    cells = df.groupBy(*z).agg(F.avg(F.when(_treated(t), F.col(y))).alias("m1"), F.avg(F.when(~_treated(t), F.col(y))).alias("m0"))
    return df.join(cells, list(z))


def arm_regressions(df: DataFrame, t: str, y: str, z: Sequence[str]) -> DataFrame:
    """Linear outcome models of each arm, from one grouped Gram."""
    grams = gram(df.withColumn("__arm", _treated(t)), [*z, y], by=["__arm"])
    fits: dict[bool, Fit] = {k[0]: solve(g, y, ["1", *z]) for k, g in grams.items()}
    if len(fits) < 2:
        raise EstimationError("an arm is empty")
    return df.withColumn("m1", fits[True].predict()).withColumn("m0", fits[False].predict())


def stratify(df: DataFrame, score: str, strata: int, key: Sequence[str], out: str = "stratum") -> DataFrame:
    """Strata floor((rank - 1) * k / n) of the score in key order.

    Ranks come from a range partitioning: a partition's rows are numbered inside it and the
    counts of the partitions before it are added, so no task sees all rows.
    """
    ranked = global_rank(df, [score, *key], "__rank")
    total = df.agg(F.count("*").alias("__n"))
    return ranked.join(F.broadcast(total)).withColumn(out, F.floor((F.col("__rank") - 1) * strata / F.col("__n")).cast("int")).drop("__rank", "__n")


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based row numbers in a total order, without sorting all rows in one task."""
    parts = ranged(df, *order)  # written: a range's number must mean the same in both uses
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__local", local).join(F.broadcast(before), "__p").withColumn(out, F.col("__local") + F.col("__b")).drop("__p", "__local", "__b")


def stratified_effect(df: DataFrame, t: str, y: str, stratum: str = "stratum", target: str = "ate") -> DataFrame:
    """Weighted within-stratum differences; a stratum without an arm is dropped, one with fewer than two rows in an arm raises."""
    a = _treated(t)
    s = df.groupBy(stratum).agg(
        F.sum(a.cast("long")).alias("n1"), F.sum((~a).cast("long")).alias("n0"),
        F.avg(F.when(a, F.col(y))).alias("y1"), F.avg(F.when(~a, F.col(y))).alias("y0"),
        F.var_samp(F.when(a, F.col(y))).alias("v1"), F.var_samp(F.when(~a, F.col(y))).alias("v0"),
    ).where("n1 > 0 and n0 > 0")
    fails = F.when((F.col("n1") < 2) | (F.col("n0") < 2), F.raise_error(F.lit("a stratum has fewer than two rows in an arm")).cast("long"))
    w = {"ate": F.col("n1") + F.col("n0"), "att": F.col("n1"), "atc": F.col("n0")}[target]
    s = s.withColumn("w", F.coalesce(fails, w).cast("double"))
    total = s.agg(F.sum("w").alias("__total"))
    share = F.col("w") / F.col("__total")
    return s.join(F.broadcast(total)).agg(
        F.sum(share * (F.col("y1") - F.col("y0"))).alias("effect"),
        F.sqrt(F.sum(share * share * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")))).alias("se"),
        F.sum("w").cast("long").alias("n"),
    )


def overlap_report(df: DataFrame, t: str, e: str = "e", thresholds: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Per clip threshold: score range, effective sizes, extreme weights, excluded share; one pass."""
    grid = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    p = F.greatest(F.col("threshold"), F.least(1 - F.col("threshold"), F.col(e)))
    w = F.when(_treated(t), 1 / p).otherwise(1 / (1 - p))
    outside = ~F.col(e).between(F.col("threshold"), 1 - F.col("threshold"))
    return grid.groupBy("threshold").agg(
        F.min(e).alias("low"), F.max(e).alias("high"), (F.sum(w) ** 2 / F.sum(w * w)).alias("ess"),
        F.sum((w > 10).cast("long")).alias("extreme"), F.avg(outside.cast("double")).alias("excluded"),
    )


# --- matching


def nearest_match(df: DataFrame, t: str, y: str, score: str, key: str, caliper: float | None = None) -> DataFrame:
    """Each treated row with the control of nearest score (ties: first in key order).

    As-of style: both arms are ordered by score once, per range partition; the nearest control
    below and above are carried along, across partitions too by the partitions' end controls.
    """
    rows = df.select(F.col(key).alias("key"), F.col(y).alias("y"), F.col(score).alias("s"), (~_treated(t)).alias("control"))
    rows = ranged(rows, "s").withColumnRenamed("__p", "p")
    w_down = Window.partitionBy("p").orderBy("s", F.col("control").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    w_up = Window.partitionBy("p").orderBy(F.col("s").desc(), F.col("control").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    # of equal scores the first key stands for the donor
    donor = F.struct(F.col("s"), F.col("key").alias("k"), F.col("y").alias("y"))
    first = rows.where("control").groupBy("s").agg(F.min(F.struct("key", "y")).alias("d"))
    marked = rows.join(first, "s", "left").withColumn("donor", F.when(F.col("control"), F.struct(F.col("s"), F.col("d.key").alias("k"), F.col("d.y").alias("y"))))
    ends = rows.where("control").groupBy("p").agg(F.max("s").alias("hi"), F.min("s").alias("lo"))
    ends = ends.join(first.select(F.col("s").alias("hi"), F.struct(F.col("s"), F.col("d.key").alias("k"), F.col("d.y").alias("y")).alias("hi_d")), "hi")
    ends = ends.join(first.select(F.col("s").alias("lo"), F.struct(F.col("s"), F.col("d.key").alias("k"), F.col("d.y").alias("y")).alias("lo_d")), "lo")
    parts = rows.select("p").distinct().join(ends.select("p", "hi_d", "lo_d"), "p", "left")
    around = parts.select(
        "p",
        F.last("hi_d", ignorenulls=True).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("under"),
        F.first("lo_d", ignorenulls=True).over(Window.orderBy("p").rowsBetween(1, Window.unboundedFollowing)).alias("over"),
    )
    near = (
        marked.withColumn("below", F.last("donor", ignorenulls=True).over(w_down)).withColumn("above", F.last("donor", ignorenulls=True).over(w_up))
        .where("not control").join(F.broadcast(around), "p")
        .withColumn("below", F.coalesce("below", "under")).withColumn("above", F.coalesce("above", "over"))
    )
    gap = lambda d: F.struct(F.abs(F.col("s") - F.col(f"{d}.s")).alias("d"), F.col(f"{d}.k").alias("k"), F.col(f"{d}.y").alias("dy"))
    best = F.array_min(F.filter(F.array(F.when(F.col("below").isNotNull(), gap("below")), F.when(F.col("above").isNotNull(), gap("above"))), lambda g: g.isNotNull()))
    out = near.withColumn("best", best).select("key", "y", F.col("best.k").alias("donor"), F.col("best.dy").alias("donor_y"), F.col("best.d").alias("distance")).where("donor is not null")
    return out if caliper is None else out.where(F.col("distance") <= caliper)


def distance_match(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, most_donors: int = 200_000) -> DataFrame:
    """Each treated row with its control nearest in standardised Euclidean distance (ties: first in key order).

    Squared distances are compared to 15 decimals.  A tree of boxes finds the nearest donor exactly; of donors with equal
    covariates only the first in key order is held.  Up to ``most_donors`` such donors are one broadcast tree.  More are cut
    into cells of about that size by a sample that only plans; a treated row is searched for in the cell next to it, and then in
    every other cell whose box is as near as what it found, so the result is the same.  A treated row without all
    covariates is as far from all donors and gets the first one, at infinity; such donors are nobody's nearest.
    """
    import pyarrow as pa

    names, kind = [f"z{i}" for i in range(len(z))], dict(df.dtypes)[key]
    rows = written(df.select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), _treated(t).alias("a"), *[F.col(c).cast("double").alias(n) for c, n in zip(z, names)]), "match-rows")
    stats = rows.agg(*[F.stddev_samp(n).alias(n) for n in names]).first()
    scale = np.array([stats[n] or 1.0 for n in names])
    donors = written(rows.where("not a").groupBy(*names).agg(F.min("key").alias("key"), F.min_by("y", "key").alias("y")), "match-donors")
    whole = fold(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])
    count, first, first_y = donors.agg(F.count(F.when(whole, 1)), F.min("key"), F.min_by("y", "key")).first()
    units, donors = rows.where("a").drop("a"), donors.where(whole)
    schema = f"key {kind}, y double, donor {kind}, donor_y double, distance double"
    if not count:
        return df.sparkSession.createDataFrame([], schema)
    if count > most_donors:
        return _nearest_in_cells(units.where(whole), donors, names, scale, kind, count, most_donors).unionByName(
            units.where(~whole).select("key", "y", F.lit(first).cast(kind).alias("donor"), F.lit(first_y).cast("double").alias("donor_y"), F.lit(math.inf).alias("distance"))
        )
    held = donors.orderBy("key").toArrow()
    keys, ys = held["key"].combine_chunks(), held["y"].combine_chunks()
    table = df.sparkSession.sparkContext.broadcast((keys, ys, Tree(_matrix(held, names), scale)))

    def match(batches):
        keys, ys, tree = table.value
        for b in batches:
            x = _matrix(b, names)
            known = np.isfinite(x).all(1)
            at, d = tree.nearest(x[known])
            took = pa.array(at)
            if not known.all():
                place = np.cumsum(known) - 1
                took = pa.array(np.where(known, at[place] if len(at) else 0, 0), mask=~known)
                d = np.where(known, d[place] if len(d) else 0.0, np.inf)
            k, v = keys.take(took), ys.take(took)
            if not known.all():
                k = pa.array([first if not s else u for s, u in zip(known, k.to_pylist())], keys.type)
                v = pa.array([first_y if not s else u for s, u in zip(known, v.to_pylist())], ys.type)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), k, v, pa.array(np.sqrt(d))], ["key", "y", "donor", "donor_y", "distance"])

    return units.mapInArrow(match, schema)


def _matrix(rows, names: Sequence[str]) -> np.ndarray:
    """Columns of Arrow rows as a matrix; missing values are NaN."""
    return np.stack([np.asarray(rows.column(n).to_numpy(zero_copy_only=False) if not hasattr(rows.column(n), "num_chunks") else rows.column(n).to_numpy(), np.float64) for n in names], 1)


def _nearest_in_cells(units: DataFrame, donors: DataFrame, names: list[str], scale: np.ndarray, kind: str, count: int, most: int) -> DataFrame:
    """Units with the nearest of more donors than one table should hold, searched for cell by cell."""
    import pyarrow as pa

    depth = max(1, math.ceil(math.log2(1.3 * count / most)))
    share = 200 * (1 << depth) / count
    sampled = donors.where(F.pmod(F.xxhash64(*names), F.lit(1_000_000)) < math.ceil(1e6 * share)).select(*names).toArrow()
    points = _matrix(sampled, names)
    while depth and len(points) < 1 << depth:
        depth -= 1
    if not len(points):
        points = _matrix(donors.select(*names).limit(1).toArrow(), names)
    ends = len(points) * np.arange((1 << depth) + 1) >> depth
    ordered = points[halved(points, scale, depth)]
    planned = levels_of(np.minimum.reduceat(ordered, ends[:-1]), np.maximum.reduceat(ordered, ends[:-1]))

    def routed(levels):
        def route(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home(levels, scale, _matrix(b, names)))], [*b.schema.names, "cell"])

        return route

    columns = f"key {kind}, y double, {', '.join(f'{n} double' for n in names)}"
    donors = written(donors.select("key", "y", *names).mapInArrow(routed(planned), f"{columns}, cell long"), "match-cells")
    boxes = donors.groupBy("cell").agg(*[f(n).alias(f"{k}{n}") for n in names for k, f in (("l", F.min), ("h", F.max))]).collect()
    low, high = np.full((1 << depth, len(names)), np.inf), np.full((1 << depth, len(names)), -np.inf)  # a cell without donors is infinitely far
    for r in boxes:
        low[r["cell"]], high[r["cell"]] = [r[f"l{n}"] for n in names], [r[f"h{n}"] for n in names]
    levels = levels_of(low, high)

    def search(left, right):
        right = right.sort_by("key")
        at, d = Tree(_matrix(right, names), scale).nearest(_matrix(left, names))
        took = pa.array(at)
        return pa.table([*[left[c] for c in ("key", "y", *names, "unit", "cell")], right["key"].take(took), right["y"].take(took), pa.array(d)], names=["key", "y", *names, "unit", "cell", "donor", "donor_y", "d"])

    def searched(asked: DataFrame) -> DataFrame:
        """Asked units with the nearest donor of their cell; units of a cell with many go to several tasks."""
        many = asked.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("pieces"))
        many = F.broadcast(written(many, "match-pieces"))
        left = asked.join(many, "cell").withColumn("piece", F.pmod(F.xxhash64("unit"), F.col("pieces")).cast("int")).drop("pieces")
        right = donors.join(many, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        found = left.groupBy("cell", "piece").cogroup(right.groupBy("cell", "piece")).applyInArrow(search, f"{columns}, unit long, cell long, donor {kind}, donor_y double, d double")
        return written(found, "matches")

    def others(batches):
        for b in batches:
            x, d, own = _matrix(b, names), b.column("d").to_numpy(), b.column("cell").to_numpy()
            for i in range(0, len(x), step):
                who, cell = within(levels, scale, x[i : i + step], d[i : i + step])
                other = cell != own[i : i + step][who]
                held = b.select(["key", "y", *names, "unit"]).take(pa.array(who[other] + i))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(cell[other])], [*held.schema.names, "cell"])

    step = max(1, min(10_000, PAIRS >> (depth + 1)))
    asked = written(units.select("key", "y", *names).mapInArrow(routed(levels), f"{columns}, cell long").withColumn("unit", F.monotonically_increasing_id()), "match-units")
    near = searched(asked.select("key", "y", *names, "unit", "cell"))
    again = written(near.mapInArrow(others, f"{columns}, unit long, cell long"), "match-others")
    more = searched(again).select("unit", F.struct("d", "donor", "donor_y").alias("other")).groupBy("unit").agg(F.min("other").alias("other"))
    best = F.least(F.struct("d", "donor", "donor_y"), F.coalesce("other", F.struct("d", "donor", "donor_y")))
    return near.join(more, "unit", "left").withColumn("b", best).select("key", "y", "b.donor", "b.donor_y", F.sqrt("b.d").alias("distance"))


def match_effect(matches: DataFrame) -> DataFrame:
    """Mean difference of matched pairs (no bias adjustment)."""
    return matches.agg(F.avg(F.col("y") - F.col("donor_y")).alias("effect"), F.count("*").alias("n"))


def matched_error(matches: DataFrame, df: DataFrame, t: str, y: str, score: str, key: str) -> DataFrame:
    """``effect, se, n`` of single matches with replacement on a score, with an error that counts how often a donor serves.

    The variance of the treated's mean difference is that of the pair differences, and K (K - 1) times a donor's outcome
    variance for each donor used K times; that variance is half the squared difference to the nearest other control
    (of equal gaps the one before).
    """
    used = matches.groupBy("donor").agg(F.count("*").cast("double").alias("k")).where("k > 1")
    controls = ranged(df.where(~_treated(t)).select(F.col(score).alias("s"), F.col(key).alias("donor"), F.col(y).cast("double").alias("y")), "s")
    own = F.struct("s", "donor", "y")
    w = Window.partitionBy("__p").orderBy("s", "donor")
    ends = controls.groupBy("__p").agg(F.min(own).alias("first"), F.max(own).alias("last"))  # one row a range
    around = ends.select("__p", F.lag("last").over(Window.orderBy("__p")).alias("under"), F.lead("first").over(Window.orderBy("__p")).alias("over"))
    near = controls.withColumn("below", F.lag(own).over(w)).withColumn("above", F.lead(own).over(w)).join(F.broadcast(around), "__p")
    near = near.withColumn("below", F.coalesce("below", "under")).withColumn("above", F.coalesce("above", "over"))
    down, up = F.col("s") - F.col("below.s"), F.col("above.s") - F.col("s")
    other = F.when(F.col("below").isNotNull() & (F.col("above").isNull() | (down <= up)), F.col("below.y")).otherwise(F.col("above.y"))
    extra = used.join(near.select("donor", (0.5 * (F.col("y") - other) ** 2).alias("v")), "donor").agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) * F.col("v")), F.lit(0.0)).alias("x")).first()["x"]
    gap = F.col("y") - F.col("donor_y")
    r = matches.agg(F.avg(gap).alias("m"), F.var_pop(gap).alias("v"), F.count("*").alias("n")).first()
    if not r["n"]:
        raise EstimationError("no row was matched")
    return _row(df, effect=r["m"], se=math.sqrt(r["n"] * r["v"] + extra) / r["n"], n=int(r["n"]))


def bias_adjusted(matches: DataFrame, df: DataFrame, t: str, y: str, z: Sequence[str], key: str) -> DataFrame:
    """Mean matched difference less what a linear fit of the donors expects from unequal covariates."""
    fit = solve(gram(df.where(~_treated(t)), [*z, y]), y, ["1", *z])
    m = df.select(F.col(key).alias("__k"), fit.predict().alias("__m"))
    x = matches.join(m, F.col("key") == F.col("__k")).select("y", "donor", "donor_y", F.col("__m").alias("own"))
    x = x.join(m, F.col("donor") == F.col("__k"))
    return x.agg(F.avg(F.col("y") - F.col("donor_y") - (F.col("own") - F.col("__m"))).alias("effect"), F.count("*").alias("n"))


# --- instruments, front door, discontinuity


def wald_iv(df: DataFrame, z: str, t: str, y: str, delta: float = 1.0, weak: float = 10.0) -> DataFrame:
    """Ratio of mean differences over a binary instrument; a weak first stage keeps the estimate and gives a NaN error."""
    rows = complete_cases(df, [z, t, y])
    g = gram(rows, [z, t, y])
    first = solve(g, t, ["1", z])
    if first[z] == 0:
        raise EstimationError("the instrument does not move the treatment")
    f = (first[z] / first.se(z)) ** 2 if first.rss > 0 else math.inf
    effect = solve(g, y, ["1", z])[z] / first[z]
    # structural residual variance around the mean
    c = g.covariance([z, t, y])
    rss = g.n * (c[2, 2] - 2 * effect * c[1, 2] + effect**2 * c[1, 1])
    se = math.sqrt(rss / (g.n - 2) * c[0, 0] / g.n) / abs(c[0, 1]) if f >= weak else math.nan
    return _row(df, effect=effect * delta, se=se * abs(delta), first_stage_f=f, n=int(g.n))


def two_stage(df: DataFrame, instruments: Sequence[str], t: str, y: str, x: Sequence[str] = ()) -> DataFrame:
    """2SLS from one Gram over [1, x, instruments, t, y]."""
    rows = complete_cases(df, [*instruments, t, y, *x])
    g = gram(rows, [*x, *instruments, t, y])
    zs, xs = ["1", *x, *instruments], ["1", *x, t]
    zz, zx, zy = g.sub(zs, zs), g.sub(zs, xs), g.sub(zs, [y])[:, 0]
    p = zx.T @ np.linalg.solve(zz, zx)
    beta = np.linalg.solve(p, zx.T @ np.linalg.solve(zz, zy))
    xx, xy, yy = g.sub(xs, xs), g.sub(xs, [y])[:, 0], g.sub([y], [y])[0, 0]
    rss = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    cov = rss / (g.n - len(xs)) * np.linalg.inv(p)
    full, short = solve(g, t, zs), solve(g, t, ["1", *x])
    f = (short.rss - full.rss) / len(instruments) / full.sigma2 if full.rss > 0 else math.inf
    return _row(df, effect=float(beta[-1]), se=math.sqrt(cov[-1, -1]), first_stage_f=float(f), n=int(g.n))


def frontdoor_effect(df: DataFrame, t: str, mediators: Sequence[str], y: str, delta: float = 1.0) -> DataFrame:
    """Sum over mediators of (t -> m) times (m -> y given t and all mediators), with the sandwich error of the stacked stages."""
    rows = complete_cases(df, [t, *mediators, y])
    g = gram(rows, [t, *mediators, y])
    second = solve(g, y, ["1", t, *mediators])
    firsts = {m: solve(g, m, ["1", t]) for m in mediators}
    effect = sum(firsts[m][t] * second[m] for m in mediators)
    # a row's influence: each stage's coefficient times the other's score through its inverse cross products
    dot = lambda fit, name: linear(fit.names, fit.inverse[fit.names.index(name)] * g.n)
    second_error = F.col(y).cast("double") - second.predict()
    influence = sum((F.lit(second[m]) * dot(f, t) * (F.col(m).cast("double") - f.predict()) + F.lit(f[t]) * dot(second, m) * second_error for m, f in firsts.items()), F.lit(0.0))
    se = math.sqrt(rows.agg(F.sum(influence * influence)).first()[0]) / g.n
    return _row(df, effect=effect * delta, se=se * abs(delta), n=int(g.n))


def sharp_rd(df: DataFrame, running: str, y: str, cutoff: float, bandwidth: float) -> DataFrame:
    """Local-linear jump at the cutoff, uniform kernel, |r - c| <= bandwidth, treated from the cutoff on."""
    rows = complete_cases(df, [running, y]).withColumn("__r", F.col(running).cast("double") - cutoff).where(F.abs("__r") <= bandwidth)
    rows = rows.withColumn("__d", (F.col("__r") >= 0).cast("double"))
    g = gram(rows, {"t": "__d", "r": "__r", "tr": F.col("__d") * F.col("__r"), y: y})
    fit = solve(g, y, ["1", "t", "r", "tr"])
    return _row(df, effect=fit["t"], se=fit.se("t"), n=int(g.n))


# --- observation, transport, interference


def selected_outcome(df: DataFrame, y: str, observed: str, p: str, m: str, out: str = "pseudo") -> DataFrame:
    """AIPW pseudo-outcome of an outcome seen with probability p: m + (y - m) / p where seen, else m."""
    return df.withColumn(out, F.when(F.col(observed), F.col(m) + (F.col(y) - F.col(m)) / F.col(p)).otherwise(F.col(m)))


def km_ipcw(df: DataFrame, time: str, event: str, key: str, entry: str | None = None, floor: float = 1e-6) -> DataFrame:
    """Inverse probability of censoring weights by Kaplan-Meier of the censoring times.

    Censoring times are distinct values, far fewer than rows; the running product is over them.
    Weight G(entry-) / G(time-) for events, 0 for censored rows; below the floor it raises.
    """
    start = F.col(entry) if entry else F.lit(None)
    rows = df.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t"), F.col(event).cast("boolean").alias("d"), start.cast("double").alias("l"))
    # at risk at u: entered by u and not yet gone; counted from the numbers of entries and exits up to u
    moves = rows.select(F.col("t").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into"), (~F.col("d")).cast("int").alias("c"))
    if entry:
        moves = moves.unionByName(rows.select(F.col("l").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).alias("c")))
    steps = moves.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.sum("c").alias("c"))
    steps = running(steps, "u", {"gone": F.col("out"), "came": F.col("into")})
    entered = F.col("came") + F.col("into") if entry else F.lit(rows.count())
    factor = F.when(F.col("c") > 0, 1 - F.col("c") / (entered - F.col("gone"))).otherwise(1.0)
    steps = running(steps.select("u", factor.alias("f")), "u", {"zeros": (F.col("f") <= 0).cast("int"), "logs": F.when(F.col("f") > 0, F.log("f")).otherwise(0.0)})
    curve = written(steps.select("u", F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("logs")).alias("g")), "survival")
    lookup = sized(curve)
    at = rows.join(lookup.withColumnRenamed("g", "gt"), rows["t"] == F.col("u")).drop("u")
    at = at.join(lookup.withColumnRenamed("g", "gl"), F.col("l") == F.col("u")).drop("u") if entry else at.withColumn("gl", F.lit(1.0))
    low = F.raise_error(F.lit("a censoring probability is below the floor")).cast("double")
    return at.select("key", F.when(~F.col("d"), 0.0).when(F.col("gt") < floor, low).otherwise(F.col("gl") / F.col("gt")).alias("weight"))


def trial_transport(df: DataFrame, y: str, t: str, trial: str, s: str, e: str, m1: str | None = None, m0: str | None = None) -> DataFrame:
    """Effect in the target (rows outside the trial) from weighted trial rows; with outcome models also AIPW."""
    a, inside = _treated(t), F.col(trial).cast("boolean")
    w = (1 - F.col(s)) / F.col(s) * F.when(a, 1 / F.col(e)).otherwise(1 / (1 - F.col(e)))
    sign = F.when(a, 1.0).otherwise(-1.0)
    n = F.sum((~inside).cast("double"))
    out = [(F.sum(F.when(inside, sign * w * F.col(y))) / n).alias("ipw")]
    if m1 and m0:
        model = F.when(a, F.col(m1)).otherwise(F.col(m0))
        score = F.when(inside, sign * w * (F.col(y) - model)).otherwise(F.col(m1) - F.col(m0))
        out.append((F.sum(score) / n).alias("aipw"))
    out += [(F.sum(F.when(inside & c, w)) ** 2 / F.sum(F.when(inside & c, w * w))).alias(k) for k, c in (("ess_treated", a), ("ess_control", ~a))]
    return df.agg(*out, n.cast("long").alias("n_target"))


def neighbour_exposure(units: DataFrame, edges: DataFrame, mapping: str = "count") -> DataFrame:
    """Exposure of each unit to its in-neighbours' assignment: count, fraction or weighted sum.

    ``units(unit, assigned, ...)``, ``edges(src, dst, w)``; sums are pre-aggregated by ``dst``.
    """
    treated = units.select(F.col("unit").alias("src"), F.col("assigned").cast("double").alias("a"))
    summed = edges.join(treated, "src").groupBy("dst").agg(F.sum("a").alias("hits"), F.count("*").alias("degree"), F.sum(F.col("a") * F.col("w")).alias("weighted"))
    value = {"count": F.col("hits"), "fraction": F.col("hits") / F.col("degree"), "weighted": F.col("weighted")}[mapping]
    return units.join(summed.withColumnRenamed("dst", "unit"), "unit", "left").withColumn("exposure", F.coalesce(value, F.lit(0.0))).drop("hits", "degree", "weighted")


def exposure_contrast(df: DataFrame, y: str, on: Column, p_on: Column, off: Column, p_off: Column) -> DataFrame:
    """Horvitz-Thompson and Hajek contrast of two exposures with a conservative variance; a zero probability raises."""
    def arm(hit: Column, p: Column, k: str) -> list[Column]:
        r = F.when(hit, F.col(y) / p).otherwise(0.0)
        v = F.when(hit, (1 - p) * F.col(y) ** 2 / (p * p)).otherwise(0.0)
        return [F.avg(r).alias(f"ht{k}"), (F.sum(r) / F.sum(F.when(hit, 1 / p))).alias(f"hj{k}"), F.avg(v).alias(f"v{k}")]

    s = df.agg(*arm(on, p_on, "1"), *arm(off, p_off, "0"), F.count("*").alias("n"))
    return s.select((F.col("ht1") - F.col("ht0")).alias("ht"), (F.col("hj1") - F.col("hj0")).alias("hajek"), (2 * (F.col("v1") + F.col("v0"))).alias("variance"), "n")


def exposure_probability(units: DataFrame, edges: DataFrame, share: float, draws: int, seed: int, hit: Column) -> DataFrame:
    """Monte-Carlo exposure probabilities under Bernoulli assignment; draws are groups of one job."""
    from causelake.functions.transforms import uniform

    worlds = units.select("unit").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    worlds = worlds.withColumn("assigned", uniform(seed, "assign", "unit", "draw") < share)
    source = worlds.select(F.col("unit").alias("src"), "draw", F.col("assigned").cast("double").alias("a"))
    summed = edges.join(source, "src").groupBy("dst", "draw").agg(F.sum("a").alias("hits")).withColumnRenamed("dst", "unit")
    full = worlds.join(summed, ["unit", "draw"], "left").withColumn("exposure", F.coalesce("hits", F.lit(0.0)))
    return full.groupBy("unit").agg(F.avg(hit.cast("double")).alias("probability"))


# --- response curves


def local_polynomial(df: DataFrame, t: str, y: str, grid: Sequence[float], bandwidth: float | None = None, degree: int = 2) -> DataFrame:
    """Kernel-weighted polynomial at each grid point: one aggregate, grouped by point."""
    if bandwidth is None:
        s = df.agg(F.stddev_samp(t), F.count(t), F.max(t) - F.min(t)).first()
        bandwidth = max(1.06 * s[0] * s[1] ** -0.2, 1e-6 * s[2])
    rows = complete_cases(df, [t, y]).withColumn("__g", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    u = (F.col(t).cast("double") - F.col("__g")) / bandwidth
    rows = rows.withColumn("__u", u).withColumn("__w", F.exp(-0.5 * u * u))
    powers = {f"u{k}": F.col("__u") ** k for k in range(1, degree + 1)}
    grams = gram(rows, {**powers, y: y}, by=["__g"])
    out = []
    for (point,), g in sorted(grams.items()):
        fit = solve(g, y, ["1", *powers])
        out.append((float(point), fit["1"], fit["u1"] / bandwidth, float(g.n)))
    return df.sparkSession.createDataFrame(out, "dose double, mean double, slope double, weight double")


def pseudo_outcome(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, folds: int = 5) -> DataFrame:
    """Cross-fitted doubly robust pseudo-outcome of a continuous treatment: Gaussian density ratio and linear nuisances.

    Nuisances of all folds come from one grouped Gram: a fold's training Gram is the total less its own.
    The marginal density is averaged over the treatment means binned at 200 equal-width points of their
    range, and interpolated between KNOTS doses.
    """
    from causelake.functions.transforms import gaussian_density

    rows = complete_cases(df, [t, y, *z], [key]).withColumn("__f", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    grams = gram(rows, [*z, t, y], by=["__f"])
    whole = fold(lambda a, b: a + b, grams.values())
    low, high = (float(v) for v in rows.agg(F.min(t), F.max(t)).first())
    parts = []
    for (k,), g in sorted(grams.items()):
        train = whole - g
        density, outcome = solve(train, t, ["1", *z]), solve(train, y, ["1", t, *z])
        sd = math.sqrt(density.rss / density.n)
        own = rows.where(F.col("__f") == k).withColumn("__m", density.predict())
        other = rows.where(F.col("__f") != k).withColumn("__m", density.predict())
        ends = other.agg(F.min("__m"), F.max("__m")).first()
        width = max((ends[1] - ends[0]) / 200, 1e-12)
        bins = other.groupBy(F.floor((F.col("__m") - ends[0]) / width).alias("b")).agg(F.avg("__m").alias("m"), F.count("*").alias("c")).collect()
        at, share = np.array([b["m"] for b in bins]), np.array([b["c"] for b in bins], float)
        # the marginal at equal knots over the doses, then linear between two of them
        knots = np.linspace(low, high, KNOTS)
        values = (np.exp(-0.5 * ((knots[:, None] - at) / sd) ** 2) @ share) / (share.sum() * sd * math.sqrt(2 * math.pi))
        place = (F.col(t).cast("double") - low) / max((high - low) / (KNOTS - 1), 1e-300)
        left = F.least(F.floor(place), F.lit(KNOTS - 2)).cast("int")
        table = F.array(*[F.lit(float(v)) for v in values])
        marginal = F.get(table, left) + (place - left) * (F.get(table, left + 1) - F.get(table, left))
        conditional = F.greatest(gaussian_density(F.col(t).cast("double"), F.col("__m"), sd), F.lit(1e-6))
        z_means = {c: F.lit(train.mean(c)) for c in z}
        at_dose = linear(outcome.names, outcome.beta, z_means)  # additive model: averaging z is an offset
        parts.append(own.select(key, t, (at_dose + (F.col(y) - outcome.predict()) * marginal / conditional).alias("pseudo")))
    return fold(DataFrame.unionByName, parts)


def average_derivative(df: DataFrame, t: str, y: str, z: Sequence[str]) -> DataFrame:
    """Riesz average derivative with a Gaussian score: slope + (t - m) / s2 * residual."""
    rows = complete_cases(df, [t, y, *z])
    g = gram(rows, [*z, t, y])
    density, outcome = solve(g, t, ["1", *z]), solve(g, y, ["1", t, *z])
    s2 = density.rss / density.n
    score = F.lit(outcome[t]) + (F.col(t) - density.predict()) / s2 * (F.col(y) - outcome.predict())
    return rows.agg(F.avg(score).alias("effect"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


# --- bootstrap


def bootstrap_means(df: DataFrame, t: str, y: str, key: str, count: int, seed: int = 1, scheme: str = "poisson") -> DataFrame:
    """Replicated difference of means, all replicates in one grouped aggregate.

    ``bayesian``: exponential weights.  ``poisson``: Poisson(1) counts, the scalable stand-in for
    multinomial draws (it differs in that the total is random).  Weights come from integer
    arithmetic on the key, so any SQL engine can repeat them.
    """
    from causelake.functions.transforms import lcg_uniform
    from causelake.operators.reduce import replicates

    rows = replicates(df.select(F.col(key).cast("long").alias("k"), F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")), count)
    u = lcg_uniform(seed, F.col("replicate").cast("long"), F.col("k"))
    if scheme == "bayesian":
        w = -F.log(u)
    else:
        cut, p, w = 0.0, math.exp(-1), F.lit(9.0)
        edges = []
        for i in range(9):
            cut += p
            edges.append((cut, float(i)))
            p /= i + 1
        w = F.when(u < edges[0][0], edges[0][1])
        for c, v in edges[1:]:
            w = w.when(u < c, v)
        w = w.otherwise(9.0)
    rows = rows.withColumn("w", w)
    mean = lambda a: F.sum(F.when(a, F.col("w") * F.col("y"))) / F.sum(F.when(a, F.col("w")))
    return rows.groupBy("replicate").agg((mean(F.col("t") > 0.5) - mean(F.col("t") <= 0.5)).alias("effect"))


def bootstrap_se(replicas: DataFrame, total: int, column: str = "effect") -> DataFrame:
    """Sample sd of the finite replicates; null when fewer than two or under half succeeded."""
    ok = F.col(column).isNotNull() & ~F.isnan(column)
    s = replicas.where(ok).agg(F.stddev_samp(column).alias("sd"), F.count("*").alias("succeeded"))
    return s.select(F.when((F.col("succeeded") >= 2) & (F.col("succeeded") * 2 >= total), F.col("sd")).alias("se"), "succeeded")


def e_value(effect: float, sd: float) -> float:
    """E-value of a mean difference on the risk-ratio scale."""
    rr = math.exp(0.91 * abs(effect / sd))
    return rr + math.sqrt(rr * (rr - 1))


def normal_interval(effect: float, se: float, level: float = 0.95) -> tuple[float, float]:
    z = special.norm_quantile(0.5 + level / 2)
    return effect - z * se, effect + z * se
