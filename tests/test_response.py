import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causelake.functions import transforms as tf
from causelake.operators import response as rs


@pytest.fixture(scope="module")
def d(spark):
    x = spark.range(3000).select(F.col("id").alias("k"), tf.normal(1, "x", "id").alias("x"), tf.normal(1, "z", "id").alias("z"))
    x = x.withColumn("y", 1 + 2 * F.col("x") - F.col("z") + 0.5 * tf.normal(1, "y", "k")).withColumn("b", (F.col("x") + tf.normal(1, "b", "k") > 0).cast("double"))
    return x.persist()


def test_families(spark, d):
    beta, _ = rs.probit(d, "b", ["1", "x"])
    assert beta == pytest.approx([0, 1], abs=0.12)
    p = d.withColumn("c", F.when(F.col("b") > 0, "two").when(F.col("z") > 0, "one").otherwise("none"))
    m = rs.multinomial_logit(p, "c", ["1", "x"], ["none", "one", "two"])
    assert m["one"]["x"] == pytest.approx(0, abs=0.25) and m["two"]["x"] > 1
    counts = d.withColumn("n", F.floor(-F.log(tf.uniform(1, "n", "k")) * F.exp(0.5 + 0.3 * F.col("z"))))
    b, alpha = rs.negative_binomial(counts, "n", ["1", "z"])
    assert b[1] == pytest.approx(0.37, abs=0.12) and alpha > 0.3
    c, sd = rs.censored_gaussian(d.withColumn("y", F.greatest(F.col("y"), F.lit(0.0))), "y", ["x", "z"], 0.0)
    assert c["x"] == pytest.approx(2, abs=0.1) and sd == pytest.approx(0.5, abs=0.1)


def test_curves(d):
    s = d.withColumn("y", F.sin("x") + F.col("z"))
    got = {round(r["dose"], 1): r["derivative"] for r in rs.gam_derivative(s, "x", "y", ["z"], [0.0, 1.0], 12).collect()}
    assert got[0.0] == pytest.approx(1.0, abs=0.1) and got[1.0] == pytest.approx(math.cos(1), abs=0.1)
    means = {r["policy"]: r["mean"] for r in rs.intervention_response(d, "x", "y", ["z"], {"set": ("set", 1.0), "shift": ("shift", 1.0), "mix": ("stochastic", [(0.0, 0.5), (1.0, 0.5)])}, "k").collect()}
    assert means["set"] == pytest.approx(3, abs=0.15) and means["mix"] == pytest.approx(2, abs=0.15) and means["shift"] == pytest.approx(3, abs=0.2)
    band = rs.simultaneous_band(d, "x", "y", "k", [0.0, 0.5], 0.3, 50).collect()
    assert all(r["low"] < r["mean"] < r["high"] for r in band)
    verdicts = {r["dose"]: r["support"] for r in rs.support_report(d, "x", [0.0, 50.0], 0.3).collect()}
    assert verdicts == {0.0: "strong", 50.0: "out of range"}
    t = {r["dose"]: r["mean"] for r in rs.transported_response(d.withColumn("trial", F.col("k") % 2 == 0), "x", "y", ["z"], "trial", [0.0, 1.0]).collect()}
    assert t[1.0] - t[0.0] == pytest.approx(2, abs=0.1)


def test_resampling(d):
    small = d.limit(100).select("k", "x").persist()
    boot = rs.multinomial_bootstrap(small, "k", 3).groupBy("replicate").count().collect()
    assert [r["count"] for r in boot] == [100] * 3
    shuffled = rs.permute_columns(small, "k", ["x"]).collect()
    assert sorted(r["x"] for r in shuffled) == sorted(r["x"] for r in small.collect()) and len(shuffled) == 100
    within = rs.permute_within(small.withColumn("g", F.col("k") % 3), "x", "g", "k")
    assert within.groupBy("g").agg(F.sum("x")).count() == 3 and within.count() == 100
    weights = rs.cluster_bootstrap(small.withColumn("g", F.col("k") % 5), "g", 2)
    assert weights.groupBy("replicate", "g").agg(F.count_distinct("__w").alias("n")).where("n > 1").count() == 0


def test_distances(d):
    g = d.withColumn("g", F.col("x") > 0)
    assert rs.mmd(g, ["y"], "g", "k", 19, 300).first()["p"] <= 0.05
    assert rs.gp_distance_test(d, "x", "y", ["z"], "k", 200, 19).first()["p"] <= 0.05
    assert rs.multivariate_parcorr(d, ["x"], ["y"], ["z"]).first()["p"] < 1e-6
    null = rs.block_shuffle_null(d, "x", "y", "k", 50, 20)
    assert null.count() == 20 and abs(null.agg(F.avg("statistic")).first()[0]) < 0.1
    assert rs.custom_test(d, [("x", "y", ["z"])], lambda x, y, z: (np.corrcoef(x, y)[0, 1], 0.0), "k").first()["statistic"] > 0.5
    assert rs.do_weighting(d.withColumn("s", (F.col("z") > 0).cast("int")), "b", "y", ["s"], 1.0).first()["n"] > 1000


def test_mmd_reads_all_rows(spark, monkeypatch):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 2 == 0).alias("g"), tf.normal(3, "v", "id").alias("v"), tf.normal(3, "u", "id").alias("u"))
    rows = rows.withColumn("v", F.col("v") + F.col("g").cast("int") * 0.15).persist()
    p = rows.orderBy(F.xxhash64("k")).toPandas()

    def brute(columns, most):
        x, g = p[columns].to_numpy(), p["g"].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        near = d[:most, :most]
        k = np.exp(-d / np.median(near[near > 0]))
        return k[np.ix_(g, g)].mean() + k[np.ix_(~g, ~g)].mean() - 2 * k[np.ix_(g, ~g)].mean()

    got = rs.mmd(rows, ["v"], "g", "k", 19, 100).first()
    assert got["n"] == n and got["statistic"] == pytest.approx(brute(["v"], 100), rel=1e-9) and got["p"] == 0.05
    monkeypatch.setattr(rs, "PAIR_ROWS", 900)
    both = rs.mmd(rows, ["v", "u"], "g", "k", 19, 100).first()
    assert both["n"] == n and both["statistic"] == pytest.approx(brute(["v", "u"], 100), rel=1e-9)
    monkeypatch.setattr(rs, "MOST_WAVES", 0)  # one column by pairs gives the same, permutations apart
    assert rs.mmd(rows, ["v"], "g", "k", 19, 100).first()["statistic"] == pytest.approx(got["statistic"], rel=1e-9)


def test_dependence_reads_all_rows(spark):
    from causelake.operators.ci import knn_independence
    from causelake.operators.discovery import direct_lingam

    n = 60_000
    least = spark.range(n).select("id", F.xxhash64("id").alias("h")).orderBy("h").limit(20_000).withColumn("first", F.lit(True))
    u, v = (tf.uniform(7, s, "id") - 0.5 for s in "uv")
    rows = spark.range(n).join(least, "id", "left")
    # among the 20,000 rows of least hash b drives a weakly; over all rows a drives b
    rows = rows.select(F.col("id").alias("k"), F.when(F.col("first"), u + 0.8 * v).otherwise(2 * u).alias("a"), F.when(F.col("first"), v).otherwise(1.6 * u + 2 * v).alias("b")).persist()
    assert direct_lingam(rows, ["a", "b"], "k")[0] == ["a", "b"]
    assert direct_lingam(rows.join(least.withColumnRenamed("id", "k"), "k"), ["a", "b"], "k")[0] == ["b", "a"]
    assert knn_independence(rows, [("a", "b")], "k", permutations=3).first()["n"] == n
    seen = rs.custom_test(rows, [("a", "b", ["k"])], lambda x, y, z: (len(x) + len(z), 0.0), "k").first()
    assert seen["statistic"] == 2 * n
