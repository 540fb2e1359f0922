import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelark.config import Target, Weighting
from ratelark.operators import curves as cv
from ratelark.operators import groups as gr
from ratelark.operators import metrics as m

BY = ["part"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 900
    pred = np.round(rng.gamma(2, 0.3, n), 2) + 0.01
    pdf = pd.DataFrame({"part": np.where(np.arange(n) % 4 == 0, "1", "0"), "IDpol": np.arange(n),
                        "pred": pred, "w": rng.uniform(0.2, 1, n),
                        "y": np.where(rng.uniform(size=n) < 0.7, 0, rng.gamma(2, pred))})
    return pdf, spark.createDataFrame(pdf).cache()


def curve(g, x, y):
    t = g.assign(gy=g.w * g[y]).groupby(x)[["w", "gy"]].sum()
    return (np.r_[0, t.w.cumsum() / t.w.sum()], np.r_[0, t.gy.cumsum() / t.gy.sum()])


@pytest.mark.parametrize("size", [60, None])
def test_curve_metrics(data, size):
    pdf, df = data
    names = ["LCGI", "CCGI", "NCCGI", "ABC", "SDCL", "CCI", "COI", "CUI", "SC", "MAB_10B"]
    got = {(r.part, r.metric): r.value for r in m.evaluate(
        df, BY, names, rows_per_bucket=size).collect()}
    grid = np.linspace(0, 1, 5000)
    for part, g in pdf.groupby("part"):
        cc, lc, best = curve(g, "pred", "y"), curve(g, "pred", "pred"), curve(g, "y", "y")
        gini = [1 - 2 * np.trapezoid(c[1], c[0]) for c in (lc, cc, best)]
        assert got[part, "LCGI"] == pytest.approx(gini[0])
        assert got[part, "CCGI"] == pytest.approx(gini[1])
        assert got[part, "NCCGI"] == pytest.approx(gini[1] / gini[2])
        gap = np.abs(np.interp(grid, *cc) - np.interp(grid, *lc))
        assert got[part, "ABC"] == pytest.approx(np.trapezoid(gap, grid))
        assert got[part, "SDCL"] == pytest.approx(gap.max())
        assert got[part, "CCI"] == pytest.approx(got[part, "COI"] + got[part, "CUI"])
        assert -1 <= got[part, "SC"] <= 1


def test_constant_prediction(spark):
    df = spark.createDataFrame([("0", i, float(i % 3), 0.5, 1.0) for i in range(30)],
                               "part string, IDpol long, y double, pred double, w double")
    row = m.gini_indices(df, BY).first()
    assert abs(row.CCGI) < 1e-12 and abs(row.LCGI) < 1e-12
    assert cv.concentration_segments(df, BY).count() == 1


def test_all_zero_targets_are_undefined_not_wrong(spark):
    df = spark.createDataFrame([("0", i, 0.0, 0.1 * i + 0.1, 1.0) for i in range(30)],
                               "part string, IDpol long, y double, pred double, w double")
    got = {r.metric: r.value for r in m.evaluate(
        df, BY, ["CCGI", "CCI", "MPD", "MGD", "R2"], Weighting.EXPOSURE).collect()}
    assert got["ewCCGI"] is None and got["ewMGD"] is None and got["ewMPD"] > 0


def test_bins_when_rows_are_few_or_do_not_divide(spark):
    df = spark.createDataFrame([("0", i, 1.0, float(i), 1.0) for i in range(7)],
                               "part string, IDpol long, y double, pred double, w double")
    ranked = cv.ordered_rows(df, BY)
    sizes = {(r.n_bins, r.group): r.n_obs for r in gr.group_statistics(ranked, BY, [3, 10]).collect()}
    assert [sizes[3, g] for g in (1, 2, 3)] == [3, 2, 2]
    assert sum(v for (b, _), v in sizes.items() if b == 10) == 7


def test_weight_prefixes_and_metric_sets():
    names = m.metric_names(Target.SEVERITY)
    assert len(names) == 13 + 1 + 15 and "MGD" in names
    assert len(m.metric_names(Target.PURE_PREMIUM)) == 13 + 4 + 15
    assert m.display_name("CCGI", Weighting.EXPOSURE, "pure") == "pure_ewCCGI"
    assert m.display_name("MAB_10B", Weighting.EXPOSURE) == "MAB_10B"
    assert m.display_name("MTD(1.2)", Weighting.CLAIM_COUNT) == "nwMTD(1.2)"
    assert m.larger_is_better("CCGI") and not m.larger_is_better("MTD(1.5)")
    assert m.larger_is_better("MBD") is None


def test_key_restriction_comes_first(data, spark):
    _, df = data
    keys = df.where("IDpol < 300").select("IDpol")
    a = m.evaluate(df, BY, ["RMSE", "MAB_10B"], keys=keys).orderBy("part", "metric").collect()
    b = m.evaluate(df.where("IDpol < 300"), BY, ["RMSE", "MAB_10B"]).orderBy(
        "part", "metric").collect()
    assert a == b


def test_grid_points_are_complete(data):
    _, df = data
    grid = cv.on_grid(cv.concentration_segments(df, BY), BY, 199, {"h": ("y0", "y1")})
    out = grid.groupBy("part").agg(F.count("i").alias("n"), F.max("h").alias("top"),
                                   F.min("h").alias("low")).collect()
    assert all((r.n, round(r.top, 12), round(r.low, 12)) == (200, 1, 0) for r in out)


def test_crossings_lie_on_the_diagonal(data):
    _, df = data
    seg = cv.cumulative_calibration_segments(cv.ordered_rows(df, BY), BY)
    sides = cv.calibration_sides(cv.on_grid(seg, BY, 99, {"h": ("y0", "y1")}), BY, 99)
    cut = sides.where("piece = 1")
    assert cut.where("abs(x0 - y0) > 1e-12").count() == 0
    assert sides.where("side = 'under' AND y0 + y1 < x0 + x1").count() == 0


@pytest.mark.parametrize("size", [40, None])
def test_rank_correlation_shares_the_order_of_predictions(data, spark, monkeypatch, size):
    pdf, df = data
    sorts = []

    def counted(frame, by, value, *args, _run=m.ordered_prefix, **kw):
        sorts.append(value)
        return _run(frame, by, value, *args, **kw)

    monkeypatch.setattr(m, "ordered_prefix", counted)
    monkeypatch.setattr(cv, "ordered_prefix", counted)
    hole = F.col("IDpol") % 7 == 3
    holes = df.withColumns({"y": F.when(~hole, F.col("y")),
                            "part": F.when(F.col("IDpol") % 31 != 5, F.col("part"))})
    got = {r.part: r.value for r in m.evaluate(holes, BY, ["SC", "CCGI"], rows_per_bucket=size)
           .where("metric = 'SC' AND value IS NOT NULL").collect()}
    # targets, predictions, and targets again for the best order
    assert len(sorts) == 3
    alone = {r.part: r.SC for r in m.weighted_spearman(holes, BY, rows_per_bucket=size).collect()}
    assert alone == pytest.approx(got) and None not in alone

    def mid_rank(v, w):
        w = np.asarray(w)
        n = np.array([(v == a).sum() for a in v])
        below = np.array([w[v < a].sum() for a in v])
        same = np.array([w[v == a].sum() for a in v])
        return below + (n + 1) / 2 * same / n

    for part, g in pdf[pdf.IDpol % 31 != 5].groupby("part"):
        empty = (g.IDpol % 7 == 3).to_numpy()
        # rows without a target come first in the order of targets and do not count in the sums
        ry = mid_rank(np.where(empty, -1.0, g.y.to_numpy()), g.w)
        rx = mid_rank(g.pred.to_numpy(), g.w)
        rx, ry, w = rx[~empty], ry[~empty], g.w.to_numpy()[~empty]
        cov = np.cov(rx, ry, aweights=w, ddof=0)
        assert got[part] == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))
