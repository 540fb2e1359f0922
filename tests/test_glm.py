"""Fits against Newton's method in numpy on the same objective."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelark.operators import boost, glm
from ratelark.operators.boost import BoostSpec
from ratelark.operators import selection as sel
from ratelark.operators.glm import GlmSpec, elastic_net_spec, fit_glm
from ratelark.plans.registry import MODELS

NAMES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 5000
    x1, x2, x3 = rng.normal(size=n), rng.uniform(size=n), rng.normal(size=n)
    w = rng.uniform(0.1, 1, size=n)
    mu = np.exp(-1 + 0.3 * x1 + 0.5 * x2)
    pdf = pd.DataFrame({
        "IDpol": np.arange(n), "x1": x1, "x2": x2, "x3": x3, "ax": np.abs(x1), "w": w,
        "count": rng.poisson(mu * w) / w, "amount": rng.gamma(2, mu / 2),
        "inv": rng.gamma(2, 1 / (1 + 0.3 * np.abs(x1) + 0.5 * x2) / 2)})
    pdf["mixed"] = np.where(rng.uniform(size=n) < 0.5, 0, pdf.amount)
    df = spark.createDataFrame(pdf).cache()
    df.count()
    return pdf, df


def newton(x, y, w, p, q, l2=0.0):
    a = np.c_[np.ones(len(y)), x]
    b = np.zeros(a.shape[1])
    mean = (w * y).sum() / w.sum()
    b[0] = np.log(mean) if q == 0 else mean ** q
    for _ in range(200):
        eta = a @ b
        mu = np.exp(eta) if q == 0 else eta ** (1 / q)
        slope = 1 / mu if q == 0 else q * mu ** (q - 1)
        wt = w / (mu ** p * slope ** 2)
        z = eta + (y - mu) * slope
        h = a.T @ (a * wt[:, None]) / w.sum() + l2 * np.diag([0] + [1] * x.shape[1])
        new = np.linalg.solve(h, a.T @ (wt * z) / w.sum())
        while q not in (0, 1) and (a @ new).min() <= 0:
            new = (new + b) / 2
        if np.abs(new - b).max() < 1e-13:
            break
        b = new
    return b


@pytest.mark.parametrize("spec, y, names", [
    (GlmSpec("gaussian", "identity"), "mixed", NAMES),
    (GlmSpec("poisson"), "count", NAMES),
    (GlmSpec("poisson", l2=0.1), "count", NAMES),
    (GlmSpec("gamma", "log"), "amount", NAMES),
    (GlmSpec("gamma", "log", l2=0.1), "amount", NAMES),
    (GlmSpec("gamma", "inverse"), "inv", ["ax", "x2"]),
    (GlmSpec("tweedie", "log", 1.5), "mixed", NAMES),
    (GlmSpec("tweedie", "log", 1.2, l2=0.1, tol=1e-14), "mixed", NAMES),
    (GlmSpec("tweedie", "power", 1.5, tol=1e-14), "mixed", ["ax", "x2"]),
    (GlmSpec("gamma", "log", tol=1e-14), "mixed", NAMES),
])
def test_coefficients(data, spec, y, names):
    pdf, df = data
    fit = fit_glm(df, names, y, "w", spec)
    want = newton(pdf[names].values, pdf[y].values, pdf.w.values, spec.variance_power,
                  spec.link_power, spec.l2)
    assert np.allclose([fit.intercept, *fit.coefficients], want, atol=2e-5)


def test_elastic_net_optimality(data):
    pdf, df = data
    spec = elastic_net_spec("poisson", 0.5, 0.06, tol=1e-13)
    fit = fit_glm(df, NAMES, "count", "w", spec)
    b = np.array(fit.coefficients)
    mu = np.exp(fit.intercept + pdf[NAMES].values @ b)
    score = -(pdf[NAMES].values * (pdf.w * (pdf["count"] - mu)).values[:, None]).sum(0) / pdf.w.sum()
    score += spec.l2 * b
    for s, c in zip(score, b):
        if c == 0:
            assert abs(s) <= spec.l1 + 1e-6
        else:
            assert abs(s + spec.l1 * np.sign(c)) < 1e-5
    assert fit.coefficients[2] == 0.0


def test_ridge_without_intercept(data):
    """The penalty is relative to the sum of weights, with or without an intercept."""
    pdf, df = data
    spec = GlmSpec("poisson", l2=0.1, fit_intercept=False, tol=1e-13)
    fit = fit_glm(df, NAMES, "count", "w", spec)
    b = np.array(fit.coefficients)
    x, w = pdf[NAMES].values, pdf.w.values
    score = (x * (w * (pdf["count"] - np.exp(x @ b))).values[:, None]).sum(0) / w.sum()
    assert fit.intercept == 0 and np.abs(score - spec.l2 * b).max() < 1e-5


def test_a_part_without_a_model_is_an_error(data):
    _, df = data
    rows = df.withColumn("part", (F.col("IDpol") % 2).cast("string"))
    models = glm.fit_parts(rows.where("part = '0'"), ["0"], NAMES, "count", "w", GlmSpec())
    assert models.predict(rows.where("part = '0'")).where("pred > 0").count() == 2500
    with pytest.raises(Exception, match="no model was fitted"):
        models.predict(rows).where("pred > 0").count()


def test_divisor_floor_and_constant(data):
    _, df = data
    plain = fit_glm(df, NAMES, "amount", "w", GlmSpec("gamma", "log"))
    scaled = fit_glm(df, NAMES, "amount", "w", GlmSpec(
        "gamma", "log", target_divisor="mean", intercept_scale="mean", floor_at_min=True))
    both = df.select(plain.predict().alias("a"), scaled.predict().alias("b"))
    assert both.where("abs(a - b) > 1e-6 * a").count() == 0
    assert scaled.floor == df.agg(F.min("amount")).first()[0]
    assert GlmSpec("gamma", "inverse").floors and not GlmSpec("poisson").floors


def test_parts_are_scored_in_one_pass(data, spark):
    _, df = data
    rows = df.withColumn("part", (F.col("IDpol") % 2).cast("string"))
    models = glm.fit_parts(rows, ["0", "1"], NAMES, "count", "w", GlmSpec())
    out = models.predict(rows)
    assert out.where("pred IS NULL OR pred <= 0").count() == 0
    assert models.coefficients(spark).count() == 8
    table = models.importance(spark)
    assert sel.select_by_importance(table, 0.0, 1).count() == 2


def test_selection_finds_the_signal(data):
    _, df = data
    rows = df.withColumn("y", F.col("count"))
    scores = sel.lasso_importance(rows, NAMES, alpha=0.03)
    assert scores["x1"] > 0 and scores["x3"] == 0
    assert sel.selected_features(scores, 0.0)[0] in ("x1", "x2")

    def importance(d, names):
        return fit_glm(d, names, "y", "w", GlmSpec()).importance()

    kept, _ = sel.eliminate_recursively(rows, NAMES, importance, 2)
    assert kept == ["x1", "x2"]
    with pytest.raises(ValueError):
        sel.selected_features(scores, 99.0)


@pytest.mark.parametrize("loss, y", [("poisson", "count"), ("gamma", "amount")])
def test_boosting_lowers_the_deviance(data, loss, y):
    _, df = data
    rows = df.withColumn("y", F.col(y))
    spec = boost.BoostSpec(loss, n_estimators=6, max_depth=2, learning_rate=0.3, subsample=0.9,
                           colsample_bytree=0.7)
    model = boost.fit_booster(rows, NAMES, spec)
    assert model.history[-1] < model.history[0]
    assert model.importance()["x1"] > 0
    out = model.predict(rows)
    assert out.count() == 5000 and out.where("pred <= 0").count() == 0


def test_boosting_rules():
    assert boost.BoostSpec(learning_rate=0.1).patience == 200
    assert boost.BoostSpec(learning_rate=1.0).patience == 60
    assert boost.BoostSpec(learning_rate=5.0).patience == 30


def test_power_link_on_a_continuous_feature(spark):
    """The power link of a Tweedie model is 1 / (1 - p): exact data give the coefficients back."""
    x = np.linspace(0.0, 1.0, 200)
    rows = spark.createDataFrame([(float(v), float((2.0 + 3.0 * v) ** -0.5), 1.0) for v in x],
                                 "x double, y double, w double")
    spec = GlmSpec("tweedie", "power", 1.5)
    assert spec.link_power == -2.0
    fit = fit_glm(rows, ["x"], "y", "w", spec)
    assert np.allclose([fit.intercept, *fit.coefficients], [2.0, 3.0], rtol=1e-4)


def test_boosted_tweedie_has_a_default_power():
    assert BoostSpec("tweedie").variance_power == 1.5
    assert MODELS["boosted_tweedie"].metric_of({"power": 1.3}) == "MTD(1.3)"
    assert MODELS["boosted_tweedie"].metric_of({}) == "MTD(1.5)"


def test_passes_do_not_grow_with_parts_and_models(data, monkeypatch):
    """Parts, families and feature lists of one call share their passes and do not mix."""
    pdf, df = data
    passes = []
    plain = glm._pass
    monkeypatch.setattr(glm, "_pass", lambda rows, trials: passes.append(1) or plain(rows, trials))
    rows = df.withColumn("part", (F.col("IDpol") % 5).cast("string"))
    specs = {"plain": GlmSpec(), "ridge": GlmSpec(l2=0.1), "net": elastic_net_spec("poisson", 0.5, 0.06)}
    problems = {(p, s): glm.Problem(p, NAMES if s != "plain" else ["x2", "x1"], spec)
                for p in "01234" for s, spec in specs.items()}
    together = glm.fit_glms(rows, problems, "count", "w")
    shared = len(passes)
    for part, name in [("0", "plain"), ("3", "ridge"), ("4", "net")]:
        passes.clear()
        alone = glm.fit_glms(rows, {0: problems[part, name]}, "count", "w")[0]
        assert len(passes) <= shared <= 12
        mine = together[part, name]
        assert mine.features == alone.features
        assert np.allclose([mine.intercept, *mine.coefficients],
                           [alone.intercept, *alone.coefficients], atol=1e-9)
    own = pdf[pdf.IDpol % 5 == 0]
    want = newton(own[["x2", "x1"]].values, own["count"].values, own.w.values, 1.0, 0.0)
    got = together["0", "plain"]
    assert np.allclose([got.intercept, *got.coefficients], want, atol=1e-8)


def test_residuals_of_all_parts(data):
    _, df = data
    rows = df.withColumn("part", (F.col("IDpol") % 2).cast("string"))
    spec = elastic_net_spec("poisson", 0.5, 0.06)
    models = glm.fit_parts(rows, ["0", "1"], NAMES, "count", "w", spec)
    left = models.score_residuals(rows, spec, "count", "w").collect()
    assert len(left) == 8 and all(abs(r.residual) < 1e-8 for r in left)
    off = glm.PartModels({p: replace(f, coefficients=[c + 0.05 for c in f.coefficients])
                          for p, f in models.fits.items()})
    assert all(r.residual > 1e-3 for r in off.score_residuals(rows, spec, "count", "w").collect()
               if r.feature == "x1")


def test_columns_without_information(data):
    """A constant column gets 0, equal columns share one effect."""
    _, df = data
    rows = df.select("count", "w", "x1", F.col("x1").alias("twin"), F.lit(7.0).alias("same"))
    fit = fit_glm(rows, ["x1", "twin", "same"], "count", "w")
    one = fit_glm(rows, ["x1"], "count", "w")
    assert np.allclose(fit.coefficients, [one.coefficients[0] / 2] * 2 + [0.0], atol=1e-9)
    assert abs(fit.intercept - one.intercept) < 1e-9


def test_rows_that_cannot_be_fitted(data):
    _, df = data
    rows = df.withColumn("part", F.lit("0"))
    with pytest.raises(ValueError, match="no rows"):
        glm.fit_parts(rows, ["0", "9"], NAMES, "count", "w", GlmSpec())
    for column, value in [("x1", None), ("count", float("nan")), ("w", None)]:
        bad = rows.withColumn(column, F.when(F.col("IDpol") > 2, F.col(column)).otherwise(value))
        with pytest.raises(ValueError, match="3 rows"):
            fit_glm(bad, NAMES, "count", "w")


def test_large_offsets_keep_precision(data):
    """Features far from zero are centred before their products are summed."""
    _, df = data
    near = fit_glm(df, ["x1", "x2"], "count", "w")
    far = fit_glm(df.withColumn("x1", F.col("x1") + 1e6), ["x1", "x2"], "count", "w")
    assert np.allclose(far.coefficients, near.coefficients, atol=1e-7)
