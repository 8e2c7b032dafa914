"""Structural models, priors, partial ancestral graphs, options, staged runs and documents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causelake import api, config, runtime
from causelake.errors import CausalError, DataError, EstimationError, ReviewRequired, Unsupported
from causelake.functions import transforms as tf
from causelake.graphs import pag
from causelake.graphs.dag import Dag, Mixed
from causelake.operators import models, priors, scm
from causelake.operators.ci import Covariance, oracle_test
from causelake.operators.discovery import GaussianScore, dbn_posterior, exact_posterior, fci, screened_posterior
from causelake.operators.reduce import gram
from causelake.sources import artifacts
from causelake.streaming.state import CausalState, Retention, strictest

CHAIN = Dag("abc", [("a", "b"), ("b", "c")])


@pytest.fixture(scope="module")
def chain(spark):
    m = scm.Model(CHAIN, {"a": scm.Linear(1.0, {}, 1.0), "b": scm.Linear(0.5, {"a": 2.0}, 1.0), "c": scm.Linear(-1.0, {"b": 0.7}, 0.5)})
    return m, m.sample(spark, 4000, seed=3).persist()


def test_evaluation_accepts_the_truth_and_falsifies_a_wrong_graph(chain):
    _, rows = chain
    right = models.evaluate(scm.Model.fit(rows, CHAIN), rows, alpha=0.001).first()
    assert not right["falsified"] and right["loglik"] > right["permutation_loglik"]
    fork = Dag("abc", [("a", "b"), ("a", "c")])
    wrong = models.evaluate(scm.Model.fit(rows, fork), rows, alpha=0.001).first()
    assert wrong["falsified"] and wrong["least_markov_p"] < 1e-6 and wrong["least_residual_p"] < 1e-6


def test_permutation_baseline_is_the_mean_over_shuffles(chain):
    _, rows = chain
    model = scm.Model.fit(rows, CHAIN)
    x = np.array(rows.select("a", "b", "c").collect())
    rng, total = np.random.default_rng(0), []
    for _ in range(200):
        parts = []
        for i, n in enumerate("abc"):
            m = model.mechanisms[n]
            mean = m.intercept + sum(b * x[:, "abc".index(p)] for p, b in m.coefficients.items())
            z = (rng.permutation(x[:, i]) - mean) / m.sd
            parts.append((-0.5 * z * z - math.log(m.sd) - 0.5 * math.log(2 * math.pi)).mean())
        total.append(np.mean(parts))
    assert models.evaluate(model, rows).first()["permutation_loglik"] == pytest.approx(np.mean(total), abs=0.02)


def test_arrows_that_are_not_needed(chain):
    _, rows = chain
    full = Dag("abc", [("a", "b"), ("a", "c"), ("b", "c")])
    assert [e[:2] for e in models.redundant_arrows(full, Covariance.of(rows, list("abc")), 0.01)] == [("a", "c")]


def test_conditional_draws_agree_with_closed_form(spark, chain):
    model, _ = chain
    mean, var = models.conditional_moments(model, "a", {"c": 3.0})
    d = models.sample_conditional(model, spark, 40_000, {"c": 3.0}, seed=5)
    r = d.agg((F.sum(F.col("weight") * F.col("a")) / F.sum("weight")).alias("m"), (F.sum(F.col("weight") * F.col("a") ** 2) / F.sum("weight")).alias("q"), F.max("c").alias("c")).first()
    assert r["c"] == 3.0 and r["m"] == pytest.approx(mean, abs=0.03) and r["q"] - r["m"] ** 2 == pytest.approx(var, abs=0.03)
    assert models.conditional_moments(model, "c", {"a": 9.0}, {"b": 1.0})[0] == pytest.approx(-0.3)
    for bad in ({}, {"b": 1.0}):
        with pytest.raises(Unsupported):
            models.sample_conditional(model, spark, 5, bad, {"b": 2.0})
    with pytest.raises(EstimationError):
        models.evaluate(model, spark.createDataFrame([], "a double, b double, c double"))


def test_assignment_picks_constant_for_a_useless_parent(spark):
    rows = spark.range(2000).select(tf.normal(1, "u", "id").alias("u"), tf.normal(1, "v", "id").alias("v"))
    model, scores = models.assign(rows, Dag("uv", [("u", "v")]))
    picked = {r["node"]: r["family"] for r in scores.where("selected").collect()}
    assert picked == {"u": "constant", "v": "constant"} and model.mechanisms["v"].coefficients == {}


def test_logistic_and_custom_mechanisms(spark):
    logistic = models.Logistic(0.3, {"x": 0.8})
    own = models.Custom(lambda v, e: v["b"] * v["b"] + e, lambda v, y: y - v["b"] * v["b"])
    m = scm.Model(Dag("xbc", [("x", "b"), ("b", "c")]), {"x": scm.Linear(0.0, {}, 1.0), "b": logistic, "c": own})
    d = m.sample(spark, 20_000, seed=2)
    back = models.fit_logistic(d, "b", ["x"])
    assert back.intercept == pytest.approx(0.3, abs=0.07) and back.coefficients["x"] == pytest.approx(0.8, abs=0.07)
    noise = d.select(own.noise({"b": F.col("b")}, F.col("c")).alias("e")).agg(F.avg("e"), F.stddev("e")).first()
    assert noise[0] == pytest.approx(0, abs=0.03) and noise[1] == pytest.approx(1, abs=0.03)
    with pytest.raises(Unsupported):
        own.log_density({"b": F.col("b")}, F.col("c"))


def test_structure_change_adds_up_and_names_players(spark, chain):
    _, rows = chain
    shifted = rows.withColumn("c", F.col("c") + 2 * F.col("a"))
    new = Dag("abc", [("a", "b"), ("a", "c"), ("b", "c")])
    found = models.structure_change(rows, shifted, CHAIN, new, "c")
    gap = shifted.agg(F.avg("c")).first()[0] - rows.agg(F.avg("c")).first()[0]
    assert set(found) == {"c"} and found["c"] == pytest.approx(gap, abs=1e-8)
    with pytest.raises(EstimationError):
        models.structure_change(rows, shifted, CHAIN, CHAIN, "c")


def test_predictive_draws(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, x double")
    draws = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 20.0)], "draw long, `1` double, x double")
    got = {(r["draw"], r["k"]): r["predicted"] for r in models.predictive_draws(rows, draws, ["1", "x"], "k").collect()}
    assert got == {(0, 1): 21.0, (0, 2): 31.0, (1, 1): 42.0, (1, 2): 62.0}


# --- priors


def test_hydration():
    base = priors.Prior.weak(["1", "t"], 10.0)
    assert priors.hydrate({"1": (1.0, 2.0), "t": (3.0, 0.5)}, base).variance == (4.0, 0.25)
    effect = priors.hydrate({"ate": (3.0, 0.5)}, base, "effect", treatment="t")
    assert effect.mean == (0.0, 3.0) and effect.variance == (100.0, 0.25) and "ate" in effect.notes[0]
    assert priors.hydrate({"b": (3.0, 0.0)}, base, "named", pairs=[("b", "t")]).variance[1] == priors.LEAST_VARIANCE
    for bad in (dict(source={"t": (1.0, 1.0)}, baseline=base), dict(source={"x": (1.0, 1.0)}, baseline=base, mapping="effect", treatment="t"), dict(source={"b": (1.0, 1.0)}, baseline=base, mapping="named", pairs=[("b", "q")])):
        with pytest.raises(DataError):
            priors.hydrate(**bad)


def test_transport_gate():
    here, there = priors.Source("h", priors.Prior.weak(["t"]), "s"), priors.Source("x", priors.Prior.weak(["t"]), "n")
    assert priors.transport([here], "s") == [(here, False, "")]
    with pytest.raises(Unsupported):
        priors.transport([there], "s")
    ((gone, required, why),) = priors.transport([there], "s", "invariant_propensity")
    assert required and gone.alpha == 0.0 and why and priors.compose([gone], priors.Prior(("t",), (1.0,), (2.0,))).mean == (1.0,)
    ((kept, _, _),) = priors.transport([there], "s", "invariant_conditional_outcome")
    assert kept.alpha == 1.0 and kept.prior.mean == there.prior.mean


def test_predictive_checks_and_engines(spark, chain):
    _, rows = chain
    g = gram(rows, ["b", "c"])
    design, prior = ["1", "b"], priors.Prior.weak(["1", "b"], 100.0)
    exact = priors.infer(priors.Conjugate(), g, "c", design, prior, 0.25)
    assert exact.mean == pytest.approx([-1.0, 0.7], abs=0.05)
    sampled = priors.infer(priors.Hamiltonian(spark, 2, 400), g, "c", design, prior, 0.25)
    assert sampled.mean == pytest.approx(exact.mean, abs=0.01)
    draws = np.random.default_rng(0).multivariate_normal(exact.mean, exact.cov, 400)
    assert priors.predictive_check(spark, g, "c", design, draws, 0.25).first()["passed"]
    far = priors.predictive_check(spark, g, "c", design, draws + [50.0, 0.0], 0.25).first()
    assert not far["passed"] and far["mean_p"] == 0.0
    x = np.array(rows.select("b").collect())[:, 0]
    r = priors.predictive_check(spark, g, "c", design, draws[:3]).first()
    assert r["predictive_mean"] == pytest.approx(np.mean([(d[0] + d[1] * x).mean() for d in draws[:3]])) and r["predictive_sd"] == pytest.approx(np.mean([(d[0] + d[1] * x).std() for d in draws[:3]]))

    class Broken:
        name = "broken"

        def infer(self, *_):
            return priors.Posterior(("1", "b"), np.array([math.nan, 0.0]), np.eye(2))

    with pytest.raises(EstimationError):
        priors.infer(Broken(), g, "c", design, prior, 0.25)


def test_alpha_grid_and_unidentified(spark, chain):
    _, rows = chain
    g = gram(rows, ["b", "c"])
    source = priors.Source("s", priors.Prior(("1", "b"), (0.0, 5.0), (1e-6, 1e-6)))
    grid = priors.alpha_sensitivity(spark, g, "c", ["1", "b"], "b", 0.25, [source], priors.Prior.weak(["1", "b"])).orderBy("alpha").collect()
    assert grid[0]["mean"] == pytest.approx(0.7, abs=0.05) and grid[-1]["mean"] > 2 and not grid[0]["stable"]
    draws, summary = priors.not_identified(spark, priors.Prior(("t",), (2.0,), (9.0,)), "t", 5000)
    s = summary.first()
    assert s["unidentified_mass"] == 1.0 and draws.agg(F.stddev("effect")).first()[0] == pytest.approx(3.0, abs=0.15)


# --- graphs


def test_pag_paths_activity_and_completions():
    latent = Dag(["u", "a", "b", "c", "d"], [("a", "b"), ("c", "d"), ("u", "b"), ("u", "d")])
    g = fci(list("abcd"), oracle_test(latent))
    found, cut = pag.definite_status_paths(g, "a", "c")
    assert ("a", "b", "d", "c") in found and not cut
    assert not pag.active(g, ("a", "b", "d", "c"), []) and pag.active(g, ("a", "b", "d", "c"), ["b", "d"])
    kept, audit = pag.completions(g)
    assert kept and audit.kept == len(kept) and not audit.cut
    for h in kept:
        assert pag.is_ancestral(h) and pag.is_maximal(h)
        for x, y in (("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")):
            for z in ([], ["b"], ["d"], ["b", "d"]):
                if not {x, y} & set(z):
                    assert pag.separated(h, x, y, z) == latent.separated([x], [y], z)
    assert pag.completions(g, most=1)[1].cut


def test_completions_of_a_chain_match_the_class():
    """Without hidden causes the DAGs of the class are among the completions, and nothing with a collider is."""
    g = Mixed("abc")
    g.connect("a", "b", "o", "o")
    g.connect("b", "c", "o", "o")
    kept, _ = pag.completions(g)
    middle = {(h.mark["a", "b"], h.mark["c", "b"]) for h in kept}
    assert (">", ">") not in middle and len(kept) == len({tuple(h.edges()) for h in kept})
    dags = {tuple(h.edges()) for h in kept if all({h.mark[a, b], h.mark[b, a]} == {"-", ">"} for a, b in (("a", "b"), ("b", "c")))}
    assert len(dags) == 3


def test_graph_posteriors(spark, chain):
    _, rows = chain
    score = GaussianScore(gram(rows, list("abc")))
    whole = {}
    for mask, w in exact_posterior(score):
        for i in range(3):
            for j in range(3):
                if mask >> (i * 3 + j) & 1:
                    whole[score.names[i], score.names[j]] = whole.get((score.names[i], score.names[j]), 0.0) + w
    left = Mixed("abc")
    for a, b in (("a", "b"), ("b", "c"), ("a", "c")):
        left.connect(a, b, "-", "-")
    inside = screened_posterior(score, left)
    assert all(inside[e] == pytest.approx(whole.get(e, 0.0), abs=1e-9) for e in inside)
    screened = config.ScreenedPosterior(alpha=0.001).run(rows, list("abc"))
    assert ("a", "c") not in screened and screened["a", "b"] + screened["b", "a"] == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(Unsupported):
        screened_posterior(score, left, most=10)


def test_dbn_posterior_finds_the_lag(spark):
    rng, x, y = np.random.default_rng(4), np.zeros(800), np.zeros(800)
    for t in range(2, 800):
        x[t] = 0.5 * x[t - 1] + rng.normal()
        y[t] = 0.8 * x[t - 2] + rng.normal()
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double")
    p = dbn_posterior(d, ["x", "y"], 2, "t")
    assert p["x", 2, "y"] > 0.99 and p["x", 1, "x"] > 0.99 and p["y", 2, "x"] < 0.2 and p["x", 0, "y"] + p["y", 0, "x"] < 0.3


# --- options, runs, documents


def test_discovery_options_run_and_accept(chain):
    _, rows = chain
    found = config.PC(alpha=0.001).run(rows, list("abc"))
    assert {frozenset(e[::2]) for e in found.pending} == {frozenset("ab"), frozenset("bc")}
    with pytest.raises(ReviewRequired):
        found.accept()
    assert found.accept(orient=[("a", "b"), ("b", "c")]).edges == [("a", "b"), ("b", "c")]
    with pytest.raises(EstimationError):
        found.accept(remove=[("a", "c")])
    assert config.GES().run(rows, list("abc")).graph.skeleton() == found.graph.skeleton()
    assert config.RFCI(0.001).run(rows, list("abc")).algorithm == "rfci"


def test_estimator_options(chain):
    _, rows = chain
    e = api.identify(CHAIN, api.AverageEffect("b", "c"))
    assert config.LinearAdjustment(se="HC0").fit(rows, api.AverageEffect("b", "c"), e).first()["effect"] == pytest.approx(0.7, abs=0.03)
    with pytest.raises(Unsupported):
        config.TwoStage().fit(rows, api.AverageEffect("b", "c"), e)


def test_stages_keep_what_is_done(spark):
    heard, token = [], runtime.Token()
    stages = [("count", lambda h: spark.range(10).count()), ("fails", lambda h: 1 / 0), ("twice", lambda h: 2 * h["count"]), ("stop", lambda h: token.cancel(spark)), ("never", lambda h: 1)]
    out = runtime.run_stages(spark, stages, token, lambda f, n: heard.append((f, n)))
    assert [r.state for r in out] == ["done", "failed", "done", "done", "cancelled"] and out[2].value == 20
    assert heard[0] == (0.0, "count") and heard[-1] == (1.0, "") and runtime.stage_table(spark, out).count() == 5
    assert [r.state for r in runtime.run_stages(spark, stages[:1], seconds=-1)] == ["skipped"]
    with pytest.raises(ZeroDivisionError):
        runtime.run_stages(spark, stages[1:2], required=["fails"])
    with pytest.raises(runtime.Cancelled):
        runtime.run_stages(spark, stages[:1], token, required=["count"])
    assert issubclass(runtime.Cancelled, CausalError)


def test_plans_record_where_they_cross_into_python(spark):
    d = spark.range(10)
    assert runtime.crossings(d.select(F.col("id") + 1)).count() == 0
    assert [tuple(r) for r in runtime.crossings(d.mapInArrow(lambda b: b, "id long")).collect()] == [("MapInArrow", True, 1)]


def test_payloads_models_and_ipc(spark, chain, tmp_path):
    model, rows = chain
    query = api.PathSpecificEffect("a", "c", (("a", "b", "c"),))
    text = artifacts.payload("query", query, ["a", "b", "c"])
    assert artifacts.read_payload(text) == (query, ["a", "b", "c"], None)
    assert artifacts.read_payload(artifacts.payload("result", query, ["a"], {"effect": 1.4}))[2] == {"effect": 1.4}
    for bad in (text.replace("PathSpecificEffect", "Popen"), text.replace('"format": 2', '"format": 3')):
        with pytest.raises(DataError):
            artifacts.read_payload(bad)
    path = f"{tmp_path}/model"
    artifacts.write_model(path, model.graph, artifacts.linear_parameters(model, spark))
    graph, parameters = artifacts.read_model(spark, path)
    assert artifacts.linear_model(graph, parameters).mechanisms == model.mechanisms
    section = artifacts.ipc_section(rows.select("row", "a"))
    assert artifacts.from_ipc(section, "row long, a double").exceptAll(rows.select("row", "a")).count() == 0
    assert artifacts.from_ipc(section, "row long, a double").count() == 4000


def test_retention_and_eviction(spark):
    with pytest.raises(DataError):
        Retention("window")
    assert strictest([Retention("statistics"), Retention("window", 3), Retention("window", 7)]) == Retention("window", 7)
    assert strictest([Retention(), Retention("window", 3)]).kind == "raw" and strictest([]).kind == "statistics"
    d = spark.range(6).select((F.col("id") % 2).alias("k"), "id")
    kept = Retention("window", 2).keep(d, "id", ["k"])
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert Retention("statistics").keep(d, "id", [], ["id"]).first()["s0_1"] == 15.0
    s = CausalState(budget_bytes=10)
    assert s.admit("a", 6) and s.admit("b", 4) and not s.admit("c", 5)
    s.touch("a")
    assert s.admit("c", 4, evict=True) and set(s.held) == {"a", "c"} and not s.admit("d", 11, evict=True)


def test_column_functions(spark):
    z = [-8.0, -2.5, -0.3, 0.0, 0.7, 1.9, 6.0]
    r = spark.createDataFrame([(v,) for v in z], "z double").select("z", tf.normal_cdf(F.col("z")).alias("c"), tf.erf(F.col("z")).alias("e"), tf.erfc(F.col("z")).alias("f")).collect()
    for v in r:
        assert v["c"] == pytest.approx(0.5 * math.erfc(-v["z"] / math.sqrt(2)), abs=1e-6)
        assert v["e"] == pytest.approx(math.erf(v["z"]), abs=1e-6) and v["f"] == pytest.approx(math.erfc(v["z"]), abs=1e-6)
    t = spark.range(30_000).select(tf.categorical(1, "c", [("x", 1.0), ("y", 0.0), ("z", 3.0)], "id").alias("c"), tf.index_below(1, "i", 5, "id").alias("i"), tf.shuffle_key(1, "s", "id").alias("s"))
    shares = {x["c"]: x["count"] / 30_000 for x in t.groupBy("c").count().collect()}
    assert set(shares) == {"x", "z"} and shares["z"] == pytest.approx(0.75, abs=0.02)
    counts = {x["i"]: x["count"] for x in t.groupBy("i").count().collect()}
    assert set(counts) == set(range(5)) and min(counts.values()) > 5600
    assert t.select("s").distinct().count() == 30_000
    with pytest.raises(DataError):
        tf.categorical(1, "c", [("x", -1.0)], "id")


# --- matching, policies, schedules, formats


def test_distance_match_in_tables_equals_one_table(spark):
    from causelake.operators.estimate import distance_match

    d = spark.range(3000).select(F.col("id").alias("k"), tf.normal(1, "a", "id").alias("a"), tf.normal(1, "b", "id").alias("b"), (tf.uniform(1, "t", "id") < 0.2).cast("double").alias("t"), tf.normal(1, "y", "id").alias("y"))
    d = d.unionByName(d.where("k % 50 = 0").withColumn("k", F.col("k") + 10_000)).persist()  # equal distances
    one = {r["key"]: r for r in distance_match(d, "t", "y", ["a", "b"], "k").collect()}
    many = {r["key"]: r for r in distance_match(d, "t", "y", ["a", "b"], "k", most_donors=300).collect()}
    assert len(one) == d.where("t = 1").count() and one.keys() == many.keys()
    assert all(one[k]["donor"] == many[k]["donor"] and one[k]["distance"] == pytest.approx(many[k]["distance"]) for k in one)


def test_distance_match_ties_gaps_and_jobs(spark):
    """Equal distances go to the first key whatever rounding makes of them; rows without a covariate; jobs do not grow with donors."""
    from causelake.operators.estimate import distance_match

    rows = [(9, 1.0, 0.3, 0.0, 1.0), (2, 0.0, 0.1, 0.0, 2.0), (1, 0.0, 0.5, 0.0, 3.0), (4, 0.0, None, 0.0, 4.0), (8, 1.0, None, 0.0, 5.0), (7, 1.0, 0.5, 0.0, 6.0), (6, 0.0, 0.5, 0.0, 7.0)]
    d = spark.createDataFrame([(k, t, a * 1000 if a else a, b, y) for k, t, a, b, y in rows], "k long, t double, a double, b double, y double")
    for most in (100, 1):
        got = {r["key"]: (r["donor"], r["donor_y"]) for r in distance_match(d, "t", "y", ["a", "b"], "k", most_donors=most).collect()}
        assert got == {9: (1, 3.0), 8: (1, 3.0), 7: (1, 3.0)}

    g = spark.range(4000).select(F.col("id").alias("k"), *[F.round(tf.normal(1, c, "id"), 2).alias(c) for c in "ab"], (tf.uniform(1, "t", "id") < 0.3).cast("double").alias("t"), tf.normal(1, "y", "id").alias("y")).persist()
    frame = g.toPandas()
    units, donors, s = frame[frame.t > 0.5], frame[frame.t < 0.5].sort_values("k"), frame[["a", "b"]].std().to_numpy()
    apart = np.round((((units[["a", "b"]].to_numpy()[:, None] - donors[["a", "b"]].to_numpy()[None]) / s) ** 2).sum(2), 15)
    want = dict(zip(units.k, donors.k.to_numpy()[apart.argmin(1)]))
    jobs = {}
    for most in (10_000, 1500, 60):
        spark.sparkContext.setJobGroup(f"match-{most}", "")
        got = {r["key"]: r["donor"] for r in distance_match(g, "t", "y", ["a", "b"], "k", most_donors=most).collect()}
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"match-{most}"))
        assert got == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[60] <= jobs[1500] + 8  # 25 times as many cells


def test_sample_policies_refuse(spark):
    from causelake.schema import WEIGHT, sample, with_weight

    d = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "v double, w double")
    with pytest.raises(DataError, match="missing values in v"):
        sample(d, ["v"], missing="error")
    with pytest.raises(DataError):
        sample(d, ["v"], mask="maybe")
    weighted = with_weight(d, F.col("w"))
    assert sample(weighted, ["v"]).first()[WEIGHT] == 2.0 and sample(weighted, ["v"], weight="unit").first()[WEIGHT] == 1.0
    assert sample(weighted, ["v"], weight="ignore").columns == ["v"]


def test_schedules_holdouts_and_rules_refuse(spark):
    from causelake.errors import NotIdentified
    from causelake.graphs.dag import Admg
    from causelake.operators.series import group_holdout, holdout_errors
    from causelake.operators.validate import overlap_rule
    from causelake.plans import expr
    from causelake.plans.identify import identify_schedule

    hidden = Admg(["a", "b", "y"], [("a", "b"), ("b", "y"), ("a", "y")], [("b", "y")])
    with pytest.raises(NotIdentified):
        identify_schedule(hidden, "y", ["a", "b"])
    with pytest.raises(NotIdentified):
        identify_schedule(hidden, "y", [])
    d = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (0, 1, 3)], "a long, b long, y long")
    e = identify_schedule(Dag("aby", [("a", "y"), ("b", "y")]), "y", ["a", "b"])
    assert expr.schedule_contrast(e.functional, d, "y", {"a": 1, "b": 1}, {"a": 0, "b": 0}).first()["value"] == 1.0
    with pytest.raises(Exception, match="no support"):
        expr.schedule_contrast(e.functional, d, "y", {"a": 1, "b": 0}, {"a": 0, "b": 0}).collect()
    for ids, n in ((["x"], 1), (["x", "x"], 1), (["x", "y"], 2)):
        with pytest.raises(DataError):
            group_holdout(d, "a", ids, n)
    with pytest.raises(DataError):
        holdout_errors(d.where("a = 0"), "y", ["b"], "a")
    none = overlap_rule(spark.createDataFrame([], "t double, e double"), "t").first()
    assert none["verdict"] == "not applicable"


def test_partial_graphs_in_text():
    from causelake.sources import graphs as formats

    g = Mixed(["a b", 'c"&\\', "d", "e"])
    g.connect("a b", 'c"&\\', "o", ">")
    g.connect('c"&\\', "d", ">", ">")
    g.connect("d", "e", "-", "-")
    g.connect("a b", "e", "o", "o")
    for write, read in ((formats.mixed_to_dot, formats.mixed_from_dot), (formats.mixed_to_gml, formats.mixed_from_gml)):
        h = read(write(g))
        assert h.nodes == g.nodes and h.mark == g.mark
    assert formats.mixed_from_dot("graph { a -- b; b -- c }").edges() == [("a", "---", "b"), ("b", "---", "c")]
    d = Dag(['x"&y', "z"], [('x"&y', "z")])
    assert formats.from_gml(formats.to_gml(d)).edges == d.edges


def test_edge_posterior_equals_enumeration(spark, chain):
    from causelake.operators.discovery import edge_posterior

    _, rows = chain
    d = rows.select("a", "b", "c", (0.1 * F.col("a") + tf.normal(9, "e", "row")).alias("d")).limit(300)
    score = GaussianScore(gram(d, list("abcd")))
    whole = {}
    for mask, w in exact_posterior(score, 0.3):
        for i in range(4):
            for j in range(4):
                if mask >> (i * 4 + j) & 1:
                    whole[score.names[i], score.names[j]] = whole.get((score.names[i], score.names[j]), 0.0) + w
    for e, v in edge_posterior(score, 0.3).items():
        assert v == pytest.approx(whole.get(e, 0.0), abs=1e-9)
    with pytest.raises(Unsupported):
        edge_posterior(score, most=3)


def test_matched_error_covers_the_spread_of_repeated_draws(spark):
    from causelake.operators.estimate import matched_error, nearest_match

    effects, errors = [], []
    for seed in range(12):
        d = spark.range(400).select(F.col("id").alias("k"), tf.uniform(seed, "s", "id").alias("s"), (tf.uniform(seed, "t", "id") < 0.4).cast("double").alias("t"))
        d = d.withColumn("y", 2 * F.col("s") + F.col("t") + tf.normal(seed, "y", "k"))
        r = matched_error(nearest_match(d, "t", "y", "s", "k"), d, "t", "y", "s", "k").first()
        effects.append(r["effect"])
        errors.append(r["se"])
    assert np.mean(effects) == pytest.approx(1.0, abs=0.15) and 0.6 < np.std(effects, ddof=1) / np.mean(errors) < 1.6


def test_queries_answered_by_class(spark, chain):
    from causelake.errors import NotIdentified
    from causelake.graphs.dag import Admg

    model, rows = chain
    m = api.answer(rows, CHAIN, api.MediationEffect("a", "c", ("b",))).first()
    assert m["total"] == pytest.approx(1.4, abs=0.05) and m["direct"] == 0.0 and m["mediated"] == m["total"]
    cf = api.answer(rows, CHAIN, api.Counterfactual("c", (("b", 0.0),))).agg(F.avg(F.col("c") - F.col("counterfactual") - 0.7 * F.col("b"))).first()[0]
    assert cf == pytest.approx(0.0, abs=0.1)
    policies = api.answer(rows, CHAIN, api.InterventionResponse("b", "c", (("zero", "set", 0.0), ("up", "shift", 1.0)), "row")).collect()
    assert {r["policy"] for r in policies} == {"zero", "up"}
    assert api.answer(rows, CHAIN, api.AverageDerivative("b", "c")).first()["effect"] == pytest.approx(0.7, abs=0.03)
    pulse = api.answer(rows, None, api.PulseEffect("a", "b", 0, "row")).first()
    assert pulse["effect"] == pytest.approx(2.0, abs=0.05)
    with pytest.raises(Unsupported):  # a parent of the second treatment follows the first
        api.answer(rows, Dag("xlyt", [("x", "l"), ("l", "t"), ("t", "y"), ("x", "y")]), api.DirectionalDerivative("y", (("x", 1.0, 0.0), ("t", 1.0, 0.0))))
    with pytest.raises(NotIdentified):
        api.answer(rows, Admg("bc", [("b", "c")], [("b", "c")]), api.PointDerivative("b", "c", 0.0))
    for bad in (api.Counterfactual("c", (("b", 0.0),)), api.AverageDerivative("b", "c")):
        with pytest.raises(Unsupported):
            api.answer(rows, None, bad)
    with pytest.raises(Unsupported):
        api.answer(rows, CHAIN, api.AverageEffect("a", "c"))


def test_derivatives_of_a_curve(spark):
    d = spark.range(-50, 51).select((F.col("id") / 10).alias("t"), (3 + 2 * F.col("id") / 10 + 0.5 * (F.col("id") / 10) ** 2).alias("y"))
    g = Dag("ty", [("t", "y")])
    assert api.answer(d, g, api.PointDerivative("t", "y", 2.0)).first()["effect"] == pytest.approx(4.0)
    assert api.answer(d, g, api.Elasticity("t", "y", 2.0)).first()["effect"] == pytest.approx(4.0 * 2 / 9)
    assert api.answer(d, g, api.SemiElasticity("t", "y", 2.0)).first()["effect"] == pytest.approx(4.0 / 9)
    low = d.withColumn("y", F.col("y") - 100)
    assert api.answer(low, g, api.Elasticity("t", "y", 2.0)).first()["effect"] is None


@pytest.mark.parametrize("query", [
    api.PulseEffect("a", "b", 1, "t", adjust=(("a", 2),)), api.SustainedEffect("a", "b", (1, 2), "t"), api.MediationEffect("a", "c", ("b",)), api.Counterfactual("c", (("a", 1.0),)),
    api.TemporalMediationEffect("a", "c", (("a", 1, "c"),), 2, "t"), api.Elasticity("a", "b", 1.0), api.DirectionalDerivative("c", (("a", 1.0, 0.5),)), api.ResponseJacobian(("a",), ("b", "c")),
    api.InterventionResponse("a", "b", (("s", "set", 1.0),)),
])
def test_payloads_of_every_class(query):
    text = artifacts.payload("query", query, ["a", "b", "c"])
    assert artifacts.read_payload(text)[0] == query and artifacts.json.loads(text)["uses"]
