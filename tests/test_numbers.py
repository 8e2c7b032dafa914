import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causelake import api
from causelake.errors import EstimationError, Unsupported
from causelake.functions import special as sp
from causelake.functions import transforms as tf
from causelake.graphs.dag import Dag
from causelake.operators import bayes, estimate, scm
from causelake.operators import reduce as red
from causelake.operators.attribution import shapley
from causelake.operators.discovery import GaussianScore, direct_lingam, exact_posterior, ges, notears, pcmci
from causelake.sources import artifacts, frames
from causelake.streaming.state import CausalState, IncrementalOls


def test_special_functions():
    assert sp.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert sp.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert sp.f_sf(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert sp.norm_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert sp.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert sp.log_norm_sf(40) == pytest.approx(-804.608, abs=1e-2)


@pytest.fixture(scope="module")
def linear(spark):
    """t, y, z with y = 1 + 2 t + 3 z exactly."""
    d = spark.range(200).select(F.col("id").alias("k"), (F.col("id") / 200).alias("z"))
    d = d.withColumn("t", (F.col("z") > 0.5).cast("double"))
    return d.withColumn("y", 1 + 2 * F.col("t") + 3 * F.col("z"))


def test_exact_recovery(linear):
    g = Dag("zty", [("z", "t"), ("z", "y"), ("t", "y")])
    r = api.analyze(linear, g, api.AverageEffect("t", "y"))
    assert r.estimand.adjustment == ("z",) and r.estimate.first()["effect"] == pytest.approx(2.0, abs=1e-10)


def test_refusals(linear):
    g = Dag("zty", [("z", "t"), ("z", "y"), ("t", "y")])
    with pytest.raises(Unsupported):
        api.analyze(linear, g, api.AverageEffect("t", "y", target="att"))
    with pytest.raises(Unsupported):
        api.analyze(linear, g, api.AverageEffect("t", "y"), estimator="rd.sharp")
    with pytest.raises(EstimationError):
        red.solve(red.gram(linear.withColumn("z2", 2 * F.col("z")), ["z", "z2", "y"]), "y", ["1", "z", "z2"])


@pytest.fixture(scope="module")
def noisy(spark):
    d = spark.range(4000).select(F.col("id").alias("k"), tf.normal(7, "z", "id").alias("z"))
    p = 1 / (1 + F.exp(0.4 - 0.9 * F.col("z")))
    d = d.withColumn("t", (tf.uniform(7, "t", "k") < p).cast("double"))
    return d.withColumn("y", 1 + 2 * F.col("t") + 3 * F.col("z") + 0.5 * tf.normal(7, "y", "k")).persist()


@pytest.mark.parametrize("estimator", ["linear.adjustment.ate", "propensity.weighting", "aipw", "propensity.stratification", "propensity.matching", "distance.matching"])
def test_estimators_find_the_effect(noisy, estimator):
    g = Dag("zty", [("z", "t"), ("z", "y"), ("t", "y")])
    e = api.analyze(noisy, g, api.AverageEffect("t", "y"), estimator=estimator, key="k").estimate.first()["effect"]
    assert e == pytest.approx(2.0, abs=0.6 if estimator == "propensity.stratification" else 0.3)


def test_logistic_equals_newton(noisy):
    x = noisy.select("z", "t").toPandas().to_numpy()
    b = np.zeros(2)
    d = np.stack([np.ones(len(x)), x[:, 0]], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        b += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]), d.T @ (x[:, 1] - p))
    got, _ = red.irls(noisy, "t", ["1", "z"])
    assert got == pytest.approx(b, abs=1e-6)


def test_wide_gram_equals_narrow(spark):
    cols = [f"c{i}" for i in range(30)]
    d = spark.range(500).select(*[tf.normal(1, c, "id").alias(c) for c in cols])
    wide = red.gram(d, cols)
    x = np.column_stack([np.ones(500), d.toPandas().to_numpy()])
    assert wide.matrix == pytest.approx(x.T @ x, rel=1e-9, abs=1e-9)


def test_sandwich_kinds(noisy):
    fit = red.solve(red.gram(noisy, ["t", "z", "y"]), "y", ["1", "t", "z"])
    plain = math.sqrt(red.sandwich(noisy, fit, "y", "homoskedastic")[1, 1])
    for kind in ("HC0", "HC1", "HC2", "HC3"):
        assert math.sqrt(red.sandwich(noisy, fit, "y", kind)[1, 1]) == pytest.approx(plain, rel=0.15)
    assert math.sqrt(red.sandwich(noisy, fit, "y", "newey_west", time="k", max_lag=3)[1, 1]) == pytest.approx(plain, rel=0.3)


def test_counterfactual_and_sampling(spark):
    d = spark.range(100).select((F.col("id") / 10).alias("x")).withColumn("y", 1 + 2 * F.col("x"))
    m = scm.Model.fit(d, Dag("xy", [("x", "y")]))
    assert m.sample(spark, 200, {"x": 3.0}).agg(F.avg("y")).first()[0] == pytest.approx(7.0, abs=1e-6)
    assert m.total_effect("x", "y") == pytest.approx(2.0)
    assert m.counterfactual(d, [{"x": 0.0}]).agg(F.max("cf_y")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_shapley():
    v = {"a": 1.0, "b": 2.0, "c": 4.0}
    assert shapley(list(v), lambda s: sum(v[p] for p in s)) == pytest.approx(v)
    assert shapley(list(v), lambda s: sum(v[p] for p in s), samples=20) == pytest.approx(v)


@pytest.fixture(scope="module")
def chain(spark):
    d = spark.range(3000).select(F.col("id").alias("k"), (tf.exponential(3, "a", "id") - 1).alias("a"))
    d = d.withColumn("b", 0.8 * F.col("a") + (tf.exponential(3, "b", "k") - 1))
    return d.withColumn("c", 0.8 * F.col("b") + (tf.exponential(3, "c", "k") - 1)).persist()


def test_searches(chain):
    g = red.gram(chain, ["a", "b", "c"])
    assert ges(GaussianScore(g)).skeleton() == {frozenset("ab"), frozenset("bc")}
    assert set(notears(g)) == {("a", "b"), ("b", "c")}
    order, arrows = direct_lingam(chain, ["c", "a", "b"], "k")
    assert order == ["a", "b", "c"] and set(arrows) == {("a", "b"), ("b", "c")}
    assert sum(w for _, w in exact_posterior(GaussianScore(g))) == pytest.approx(1)


def test_pcmci(spark):
    s = frames.simulate_lagged(spark, 500, 0.8, 1, 0.2, seed=3)
    links, _ = pcmci(s, ["x", "y"], 2, "t", alpha=0.001)
    assert [(x.cause, x.lag, x.effect) for x in links] == [("x", 1, "y")]


def test_bayes(spark, noisy):
    g = red.gram(noisy, ["t", "z", "y"])
    post = bayes.conjugate(g, "y", ["1", "t", "z"])
    assert post.mean[1] == pytest.approx(2.0, abs=0.1)
    d = post.draws(spark, 2000, 1).agg(F.avg("t").alias("m"), F.stddev("t").alias("s")).first()
    assert d["m"] == pytest.approx(post.mean[1], abs=4 * math.sqrt(post.cov[1, 1] / 2000)) and d["s"] == pytest.approx(math.sqrt(post.cov[1, 1]), rel=0.1)
    h = bayes.hmc_gaussian(spark, g, "y", ["1", "t", "z"], 0.25, steps=300, warmup=200)
    assert bayes.mcmc_diagnostics(h, ["t"]).first()["rhat"] < 1.05
    assert sum(bayes.beta_moments(0.3, 0.01)) == pytest.approx(20)


def test_state_and_streaming(spark, tmp_path):
    d = spark.range(300).select((F.col("id") / 10).alias("x")).withColumn("y", 1 + 2 * F.col("x"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ols = IncrementalOls(str(tmp_path / "grams"), ("x",), "y")
    ols.start(stream, str(tmp_path / "cp")).awaitTermination(60)
    assert ols.fit(spark)["x"] == pytest.approx(2.0, abs=1e-8)
    state = CausalState(budget_bytes=100)
    state.register("models", "m")
    assert state.apply("append_data") == [("models", "m")] and state.is_stale("models", "m")
    assert state.admit("a", 80) and not state.admit("b", 40)


def test_artifacts(spark, tmp_path):
    d = spark.range(10).toDF("draw")
    artifacts.write_posterior(str(tmp_path / "a"), d, {"quantity": "effect"})
    assert artifacts.read_manifest(spark, str(tmp_path / "a"))["meta"] == {"quantity": "effect"}
    assert artifacts.read_section(spark, str(tmp_path / "a"), "draws", verify=True).count() == 10


def test_nearest_match_equals_brute_force(noisy):
    got = {r["key"]: r["donor"] for r in estimate.nearest_match(noisy, "t", "y", "z", "k").collect()}
    x = noisy.select("k", "t", "z").toPandas()
    donors = x[x.t < 0.5].sort_values("k")
    for k, z in x[x.t > 0.5][["k", "z"]].head(200).itertuples(index=False):
        d = (donors.z - z).abs()
        assert got[k] == donors.k[d == d.min()].min()


def test_small_fixtures(spark):
    units = spark.createDataFrame([(1, True, 4.0), (2, False, 10.0)], "unit long, assigned boolean, y double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")
    units, edges = frames.network(units, edges)
    x = estimate.neighbour_exposure(units, edges)
    assert {r["unit"]: r["exposure"] for r in x.collect()} == {1: 0.0, 2: 1.0}
    km = spark.createDataFrame([(1, 1.0, False), (2, 2.0, True), (3, 3.0, True)], "k long, time double, event boolean")
    assert [r["weight"] for r in estimate.km_ipcw(km, "time", "event", "k").orderBy("key").collect()] == pytest.approx([0.0, 1.5, 1.5])


def test_path_specific_effect(spark):
    """m copies t in 3 of 4 rows, y = m + 2 t: the paths' effects add up to the total."""
    rows = [(t, m, m + 2 * t) for t in (0, 1) for m in (t, t, t, 1 - t)]
    d = spark.createDataFrame(rows, "t int, m int, y int")
    g = Dag("tmy", [("t", "m"), ("m", "y"), ("t", "y")])
    effect = lambda *through: api.analyze(d, g, api.PathSpecificEffect("t", "y", through, 1, 0)).estimate.first()["value"]
    assert effect(("t", "y")) == pytest.approx(2.0)
    assert effect(("t", "m", "y")) == pytest.approx(0.5)
    assert effect(("t", "m"), ("t", "y")) == pytest.approx(2.5)


def test_bias_adjusted_match_and_stationary_blocks(spark, noisy):
    matches = estimate.nearest_match(noisy, "t", "y", "z", "k")
    assert estimate.bias_adjusted(matches, noisy, "t", "y", ["z"], "k").first()["effect"] == pytest.approx(2.0, abs=0.1)
    s = frames.simulate_lagged(spark, 60, 0.8, 1, 0.2).withColumnRenamed("t", "step")
    from causelake.operators.series import stationary_resample

    r = stationary_resample(s, "step", 60, 5.0, 3, 1)
    assert [x["count"] for x in r.groupBy("replicate").count().collect()] == [60] * 3
    steps = sorted((x["replicate"], x["position"], x["step"]) for x in r.collect())
    follow = sum(b[2] == (a[2] + 1) % 60 for a, b in zip(steps, steps[1:]) if a[0] == b[0])
    assert 100 < follow < 177


def test_trajectory(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 8.0)], "u long, x0 double")
    got = scm.trajectory(d, "u", 3, 0.5, 1.0, {2: 10.0}, "x0").orderBy("u", "step").collect()
    assert [r["value"] for r in got] == [0.0, 1.0, 10.0, 6.0, 8.0, 5.0, 10.0, 6.0]


def test_functional_effect_refuses_missing_support(spark):
    g = Dag("zty", [("z", "t"), ("z", "y"), ("t", "y")])
    full = spark.createDataFrame([(z, t, t + z) for z in (0, 1) for t in (0, 1)], "z int, t int, y int")
    ask = lambda d: api.analyze(d, g, api.AverageEffect("t", "y", 1, 0), estimator="functional.effect").estimate.first()["value"]
    assert ask(full) == pytest.approx(1.0)
    with pytest.raises(Exception, match="no support"):
        ask(full.where("not (z = 1 and t = 0)"))


def test_large_means_keep_their_digits(spark):
    d = spark.range(4000).select((1.7e9 + F.col("id") * 21.6).alias("t"), (1e6 + F.col("id") % 11).alias("x"), tf.normal(1, "e", "id").alias("e"))
    d = d.withColumn("y", 3 + 2e-3 * (F.col("t") - 1.7e9) + 0.5 * (F.col("x") - 1e6) + F.col("e"))
    rows = d.toPandas()
    x = np.column_stack([rows["t"] - rows["t"].mean(), rows["x"] - rows["x"].mean()])
    want = np.linalg.lstsq(x, rows["y"] - rows["y"].mean(), rcond=None)[0]
    fit = red.solve(red.gram(d, ["t", "x", "y"]), "y", ["1", "t", "x"])
    assert [fit["t"], fit["x"]] == pytest.approx(want, rel=1e-8)
    weighted = red.solve(red.gram(d.withColumn("__w", F.lit(2.0)), ["t", "x", "y"]), "y", ["1", "t", "x"])
    assert [weighted["t"], weighted["x"]] == pytest.approx(want, rel=1e-8)
    thirds = red.gram(d.withColumn("g", F.col("x") % 3), ["t", "x", "y"], by=["g"])
    parts = list(thirds.values())
    whole = parts[0] + parts[1] + parts[2]
    assert red.solve(whole, "y", ["1", "t", "x"])["x"] == pytest.approx(want[1], rel=1e-8)
    assert red.solve(whole - parts[0], "y", ["1", "t", "x"])["t"] == pytest.approx(red.solve(parts[1] + parts[2], "y", ["1", "t", "x"])["t"], rel=1e-8)


def test_aipw_errors_of_the_treated(spark):
    from causelake.operators import estimate as est

    d = spark.range(4000).select((tf.uniform(1, "t", "id") < 0.5).cast("double").alias("t"), tf.normal(1, "n", "id").alias("n"))
    d = d.select("t", (10 * F.col("t") + F.col("n")).alias("y"), F.lit(0.5).alias("e"), F.lit(10.0).alias("m1"), F.lit(0.0).alias("m0"))
    for target in ("ate", "att", "atc"):
        r = est.aipw(d, "t", "y", target=target).first()
        assert r["effect"] == pytest.approx(10, abs=0.15) and r["se_plain"] == pytest.approx(0.0316, rel=0.15), target


def test_glm_and_front_door_errors_match_replicates(spark):
    """The stated error is near the spread of estimates over independent samples."""
    from causelake.operators import estimate as est

    effects, errors, fronts, front_errors = [], [], [], []
    for seed in range(12):
        d = spark.range(600).select(tf.normal(seed, "t", "id").alias("t"), tf.normal(seed, "m", "id").alias("a"), tf.normal(seed, "y", "id").alias("b"), tf.uniform(seed, "u", "id").alias("u"))
        d = d.select("t", (F.col("t") + F.col("a")).alias("m"), (F.col("t") + 2 * F.col("a") + F.col("b")).alias("y"), (F.col("u") < 1 / (1 + F.exp(-F.col("t")))).cast("double").alias("yb"))
        g, f = est.glm_adjustment(d, "t", "yb").first(), est.frontdoor_effect(d, "t", ["m"], "y").first()
        effects.append(g["effect"])
        errors.append(g["se"])
        fronts.append(f["effect"])
        front_errors.append(f["se"])
    assert 0.5 < np.std(effects, ddof=1) / np.mean(errors) < 1.8
    assert 0.5 < np.std(fronts, ddof=1) / np.mean(front_errors) < 1.8


def test_ranges_give_global_ranks_and_extremes(spark):
    from causelake.operators import series as ser

    d = spark.range(500).select("id", F.round(tf.uniform(3, "p", "id"), 2).alias("p")).repartition(7)
    rows = sorted((r["p"], r["id"]) for r in d.collect())
    p = np.array([v for v, _ in rows])
    n = len(p)
    bh = np.minimum(1, np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1])
    holm = np.minimum(1, np.maximum.accumulate(p * (n - np.arange(n))))
    for method, want in (("bh", bh), ("by", np.minimum(1, np.minimum.accumulate((p * n / np.arange(1, n + 1) * ser.harmonic(n))[::-1])[::-1])), ("holm", holm)):
        got = sorted((r["p"], r["adjusted"]) for r in ser.adjust_p(d, method=method).collect())
        assert [a for _, a in got] == pytest.approx(sorted(want.tolist())), method
    assert ser.harmonic(2_000_000) == pytest.approx(float((1 / np.arange(1, 2_000_001)).sum()), abs=1e-9)
    run = {r["id"]: r["before"] for r in red.running(d.select("id"), "id", {"before": F.col("id")}).collect()}
    assert run == {i: i * (i - 1) // 2 for i in range(500)}


def test_entry_times_and_split_guard(spark):
    from causelake.errors import DataError
    from causelake.operators import estimate as est
    from causelake.operators import series as ser
    from causelake.sources import frames

    rows = [(k, float(k % 5 + 2), k % 3 != 0, float(k % 2)) for k in range(40)]
    d = spark.createDataFrame(rows, "k long, time double, event boolean, entry double")

    def curve(u):  # Kaplan-Meier of censoring just before u, by counting
        g = 1.0
        for v in sorted({t for _, t, _, _ in rows if t < u}):
            risk = sum(t >= v and e <= v for _, t, _, e in rows)
            g *= 1 - sum(t == v and not ev for _, t, ev, _ in rows) / risk
        return g

    got = {r["key"]: r["weight"] for r in est.km_ipcw(d, "time", "event", "k", "entry").collect()}
    assert got == pytest.approx({k: curve(e) / curve(t) if ev else 0.0 for k, t, ev, e in rows})
    with pytest.raises(DataError):
        ser.random_split(frames.time_series(d, "time"), ["k"], 0.5)
    assert ser.random_split(frames.time_series(d, "time"), ["k"], 0.5, allow_temporal=True).count() == 40
