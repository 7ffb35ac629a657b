"""Absorbed least squares against dummies; the REML profile against a direct evaluation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import regress as G


def panel(spark, n_levels, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for source in ("a", "b"):
        for i in range(n):
            level = int(rng.integers(0, n_levels)) if i >= n_levels else i
            x, z, item = rng.normal(), rng.normal() + level % 3, rng.choice(["p", "q", "r"])
            y = 0.5 * x - z + {"p": 0, "q": 1, "r": -1}[item] + math.sin(level) + rng.normal() * 0.3
            rows.append((source, f"l{level}", x, z, item, None if i % 50 == 49 else y))
    return spark.createDataFrame(rows, "source string, level string, x double, z double, item string, y double")


def by_variable(df):
    return {(r.source, r.variable): (r.coefficient, r.std_error, r.z_value, r.p_value, r.n) for r in df.collect()}


def test_absorbed_levels_equal_their_dummies(spark):
    df = panel(spark, 50, 900)
    wide, names = G.dummies(df, "level", G.levels_of(df, "level", "l0"))
    wide, more = G.dummies(wide, "item", ["p", "q", "r"])
    want = by_variable(G.ols(wide, "source", ["x", "z", *names, *more], "y"))
    got = by_variable(G.absorbed_ols(df, "source", ["x", "z"], {"item": "p"}, "level", "l0", "y"))
    assert got.keys() == want.keys() and len(got) == 2 * 54
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-6, abs=1e-8), key


def test_five_thousand_levels(spark):
    df = panel(spark, 5000, 15_000)
    got = by_variable(G.absorbed_ols(df, "source", ["x"], {"item": "p"}, "level", "l0", "y"))
    levels = df.where("y is not null").select("source", "level").distinct().count()
    assert levels > 9900 and len(got) == levels + 2 * 3
    assert got["a", "x"][0] == pytest.approx(0.5, abs=0.08) and got["a", "C(item)[T.q]"][0] == pytest.approx(1, abs=0.2)


def subjects(spark, sizes, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for source, spread in (("a", 1.2), ("b", 0.0)):
        for s, m in enumerate(sizes):
            u = spread * rng.normal()
            rows += [(source, f"s{s}", float(x), float(1 + 0.5 * x + u + rng.normal())) for x in rng.normal(size=m)]
    return rows, spark.createDataFrame(rows, "source string, subject string, x double, y double")


def direct_deviance(rows, source, theta):
    """From the full covariance matrix."""
    own = [r for r in rows if r[0] == source]
    x = np.array([[1.0, r[2]] for r in own])
    y = np.array([r[3] for r in own])
    who = np.array([r[1] for r in own])
    v = np.eye(len(own)) + theta * (who[:, None] == who[None, :])
    w = np.linalg.inv(v)
    a = x.T @ w @ x
    beta = np.linalg.solve(a, x.T @ w @ y)
    rest = (y - x @ beta) @ w @ (y - x @ beta)
    n, p = x.shape
    return (n - p) * math.log(rest / (n - p)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]


def test_profile_and_its_minimum(spark):
    rows, df = subjects(spark, [1, 2, 2, 3, 5, 8, 1, 4, 9, 2, 6, 3])
    points = [-8.0, -2.0, 0.0, 1.5]
    for r in G.profile_deviance(df, "source", "subject", ["x"], "y", points).collect():
        assert r.deviance == pytest.approx(direct_deviance(rows, r.source, math.exp(r.log_theta)), rel=1e-9)
    fit = {(r.source, r.variable): r for r in G.random_intercept(df, "source", "subject", ["x"], "y").collect()}
    theta = fit["a", "x"].theta
    here = direct_deviance(rows, "a", theta)
    assert theta > 0.1
    for other in (theta * 1.001, theta / 1.001, 0.0, 10 * theta):
        assert here < direct_deviance(rows, "a", other)
    base = G.SizeClasses(df, "source", "subject", ["x"], "y")
    _, slope, *_ = G._profile(base.base["a"], *base.at([("a", theta)])["a", theta])
    assert abs(theta * slope) < 1e-7


def test_derivatives_of_the_profile(spark):
    rows, df = subjects(spark, [1, 2, 3, 5, 8])
    base, theta, step = G.SizeClasses(df, "source", "subject", ["x"], "y"), 0.7, 1e-4
    found = base.at([("a", t) for t in (theta - step, theta, theta + step)])
    low, here, high = (G._profile(base.base["a"], *found["a", t]) for t in (theta - step, theta, theta + step))
    assert here[1] == pytest.approx((high[0] - low[0]) / (2 * step), rel=1e-5)
    assert here[2] == pytest.approx((high[1] - low[1]) / (2 * step), rel=1e-5)


def test_no_variance_between_subjects_gives_least_squares(spark):
    rows = [("a", f"s{i % 5}", float(i), (1 if i % 2 else -1) * (1 if (i // 5) % 2 else -1) + 0.5 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, subject string, x double, y double")
    fit = {r.variable: r for r in G.random_intercept(df, "source", "subject", ["x"], "y").collect()}
    plain = {r.variable: r for r in G.ols(df, "source", ["x"], "y").collect()}
    if fit["x"].theta == 0.0:
        assert fit["x"].coefficient == pytest.approx(plain["x"].coefficient) and fit["x"].std_error == pytest.approx(plain["x"].std_error)
    assert direct_deviance(rows, "a", fit["x"].theta) <= direct_deviance(rows, "a", 0.0) + 1e-9


def test_many_sizes(spark):
    sizes = spark.range(1, 1201).select(F.lit("a").alias("source"), F.concat(F.lit("s"), "id").alias("subject"), F.explode(F.sequence(F.lit(1), F.col("id").cast("int"))).alias("k"))
    df = sizes.select("source", "subject", F.sin(F.col("k") * 1.7).alias("x"), (F.sin(F.col("k") * 1.7) + F.cos(F.hash("subject")) + F.cos(F.hash("k", "subject"))).alias("y"))
    fit = {r.variable: r for r in G.random_intercept(df, "source", "subject", ["x"], "y").collect()}
    assert fit["x"].coefficient == pytest.approx(1.0, abs=0.01) and fit["x"].theta > 0.5 and fit["x"].n == 1200 * 1201 // 2
