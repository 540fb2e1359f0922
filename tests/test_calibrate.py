import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelark.operators import calibrate as cal

PARTS = ["0", "1"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 600
    pred = np.round(rng.gamma(2, 0.5, n), 2)
    pdf = pd.DataFrame({"part": np.where(np.arange(n) % 3 == 0, "1", "0"), "IDpol": np.arange(n),
                        "pred": pred, "w": rng.uniform(0.2, 1, n),
                        "y": np.where(rng.uniform(size=n) < 0.5, 0, pred * rng.gamma(2, 1, n))})
    return pdf, spark.createDataFrame(pdf).cache()


def tail(g):
    t = g.IDpol.map(lambda i: hashlib.sha256(f"-{i}".encode()).hexdigest())
    return g.assign(t=t).sort_values(["pred", "t"]).reset_index(drop=True)


def brute_local_mean(g, frac, kernel):
    g = tail(g)
    x, k, out = g.pred.values, int(np.ceil(frac * len(g))), {}
    for c in np.unique(x):
        lo = next((i for i in range(len(x) - k) if c <= (x[i] + x[i + k]) / 2), len(x) - k)
        d = np.abs(x[lo:lo + k] - c)
        h = d.max()
        u = d / h if h > 0 else d * 0
        kw = {"triangular": 1 - u, "rectangular": np.ones(k), "gaussian": np.exp(-u * u / 2)}[kernel]
        if h == 0:
            kw = np.ones(k)
        kw = kw * g.w.values[lo:lo + k]
        out[c] = (kw * g.y.values[lo:lo + k]).sum() / kw.sum()
    return out


@pytest.mark.parametrize("size", [40, None])
@pytest.mark.parametrize("kernel", ["rectangular", "triangular", "gaussian"])
def test_local_mean(data, kernel, size):
    pdf, df = data
    model = cal.LocalMean(0.15, kernel, nodes=1000, rows_per_bucket=size).fit(df, PARTS)
    out = model.transform(df).toPandas()
    assert len(out) == len(pdf)
    for part, g in pdf.groupby("part"):
        want = brute_local_mean(g, 0.15, kernel)
        got = out[out.part == part]
        assert np.allclose(got.calibrated, got.pred.map(want), rtol=1e-7, atol=1e-9)


def test_local_mean_uses_the_nearest_centre(data, spark):
    _, df = data
    model = cal.LocalMean(0.2, "rectangular").fit(df, PARTS)
    new = spark.createDataFrame([("0", 1, -5.0), ("0", 2, 99.0)], "part string, IDpol long, pred double")
    ends = {r.IDpol: r.calibrated for r in model.transform(new).collect()}
    table = {r.pred: r.calibrated for r in model.table.where("part = '0'").collect()}
    assert ends == {1: table[min(table)], 2: table[max(table)]}


def test_local_polynomial_reproduces_a_parabola(data):
    _, df = data
    rows = df.withColumn("y", 1 + 2 * F.col("pred") - 0.3 * F.col("pred") ** 2)
    model = cal.LocalPolynomial(0.5, 2, nodes=1000).fit(rows, PARTS)
    out = model.transform(rows)
    assert out.where("abs(calibrated - y) > 1e-6").count() == 0


def test_node_spacing_bounds_the_error(data):
    _, df = data
    fits = [cal.LocalPolynomial(0.5, 1, nodes=k).fit(df, PARTS).transform(df)
            .select("IDpol", F.col("calibrated").alias(f"v{k}")) for k in (11, 21, 1000)]
    both = fits[0].join(fits[1], "IDpol").join(fits[2], "IDpol").toPandas()
    assert np.abs(both.v21 - both.v1000).mean() <= np.abs(both.v11 - both.v1000).mean()


@pytest.mark.parametrize("centered", [False, True])
def test_isotonic_is_monotone(data, centered):
    _, df = data
    model = cal.Isotonic(centered=centered, low=0.1, high=0.05).fit(df, PARTS)
    out = model.transform(df).toPandas().sort_values(["part", "pred"])
    for _, g in out.groupby("part"):
        assert (np.diff(g.calibrated) >= -1e-12).all()
        assert g.calibrated.min() > 0


@pytest.mark.parametrize("method", ["scale", "shift"])
@pytest.mark.parametrize("name", ["pure", "equal_bins_means", "isotonic"])
def test_rebalancing_restores_totals(data, name, method):
    _, df = data
    out = cal.make_calibrator(name, {}, method).fit(df, PARTS).transform(df)
    gap = out.groupBy("part").agg(
        (F.sum(F.col("w") * (F.col("y") - F.col("calibrated"))) / F.sum("w")).alias("gap"))
    assert all(abs(r.gap) < 1e-9 for r in gap.collect())


@pytest.mark.parametrize("model", [
    cal.EqualBinsMeans(4), cal.Isotonic(force_positive=False), cal.LocalPolynomial(0.5, 1),
    cal.Rebalanced(cal.PureCalibration(), "scale")])
def test_a_part_without_a_calibrator_is_an_error(data, model):
    pdf, df = data
    fitted = model.fit(df.where("part = '0'"), ["0"])
    known = fitted.transform(df.where("part = '0'"))
    assert known.where("calibrated >= 0").count() == (pdf.part == "0").sum()
    with pytest.raises(Exception, match="no model was fitted"):
        fitted.transform(df).where("calibrated >= 0").count()


def test_constant_prediction_gets_the_mean(spark):
    df = spark.createDataFrame([("0", i, float(i % 2), 0.3, 1.0) for i in range(20)],
                               "part string, IDpol long, y double, pred double, w double")
    out = cal.EqualBinsMeans(5).fit(df, ["0"]).transform(df)
    assert {r.calibrated for r in out.collect()} == {0.5}


def test_tail_pool_extends_to_the_first_positive(spark):
    df = spark.createDataFrame([("0", i, float(i == 6), float(i), 1.0) for i in range(10)],
                               "part string, IDpol long, y double, pred double, w double")
    out = cal.pool_tails(df, ["part"], 0.2).toPandas().sort_values("IDpol")
    assert np.allclose(out.y_pooled[:7], 1 / 7) and (out.y_pooled[7:] == 0).all()
    with pytest.raises(ValueError):
        cal.pool_tails(df, ["part"], 0.6, 0.6)


@pytest.mark.parametrize("name, params", [
    ("gamma_glm", {}), ("poisson_glm", {}), ("tweedie_glm", {"power": 1.5})])
def test_glm_calibration(data, name, params):
    _, df = data
    out = cal.make_calibrator(name, params).fit(df, PARTS).transform(df)
    assert out.where("calibrated IS NULL OR calibrated < 0").count() == 0
    final = cal.prediction_columns(out)
    assert {"pure_pred", "calibrated_pred", "pred"} <= set(final.columns)


@pytest.mark.parametrize("kernel", ["rectangular", "triangular"])
def test_windows_come_from_the_merge(data, monkeypatch, kernel):
    """No centre looks up the ends of its window by rank, however many centres share them."""
    _, df = data

    def refused(*args, **kw):
        raise AssertionError("joined by rank")

    monkeypatch.setattr(cal, "hot_join", refused)
    assert cal.LocalMean(0.15, kernel, rows_per_bucket=40).fit(df, PARTS).table.count() > 0


def test_predictions_between_the_entries(data, spark):
    """Entries are met by value; the rest takes the nearest one."""
    _, df = data
    model = cal.LocalMean(0.2, "rectangular").fit(df, PARTS)
    known = model.table.where("part = '0'").orderBy("pred").limit(2).collect()
    low, high = known[0], known[1]
    new = spark.createDataFrame(
        [("0", 1, low.pred), ("0", 2, low.pred + 0.9 * (high.pred - low.pred))],
        "part string, IDpol long, pred double")
    assert {r.IDpol: r.calibrated for r in model.transform(new).collect()} == {
        1: low.calibrated, 2: high.calibrated}
