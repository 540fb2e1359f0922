"""The isotonic fit in buckets against pooling of all points at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelark.operators import calibrate as cal
from ratelark.operators.isotonic import block_starts, isotonic_blocks


def pooled(x, y, w):
    """Fitted values by repeated pooling of neighbours that fall."""
    blocks = [[yi * wi, wi, 1] for yi, wi in zip(y, w)]
    i = 0
    while i < len(blocks) - 1:
        a, b = blocks[i], blocks[i + 1]
        if a[0] / a[1] >= b[0] / b[1]:
            blocks[i:i + 2] = [[p + q for p, q in zip(a, b)]]
            i = max(0, i - 1)
        else:
            i += 1
    return np.concatenate([np.full(n, s / t) for s, t, n in blocks])


def shapes(rng, n):
    x = np.sort(rng.uniform(0, 10, n))
    return {
        "noise": (x, x + rng.normal(0, 5, n)),
        "rising": (x, np.exp(x)),
        "falling": (x, -x),
        "steps": (x, np.floor(x) + rng.normal(0, 0.1, n)),
        "swallowed": (x, np.append(np.arange(n - 1.0), -1e6)),
        "saw": (x, (np.arange(n) % 37) * 1.0),
        "flat": (x, np.zeros(n)),
        "heavy": (x, np.where(rng.uniform(size=n) < 0.9, 0, rng.gamma(0.5, 20, n))),
    }


def test_block_starts():
    assert block_starts(np.ones(4), np.array([1.0, 3, 2, 2])).tolist() == [0, 1]
    assert block_starts(np.zeros(0), np.zeros(0)).tolist() == []


@pytest.mark.parametrize("size", [None, 25])
@pytest.mark.parametrize("increasing", [True, False])
def test_blocks(spark, size, increasing):
    rng = np.random.default_rng(8)
    if size and not increasing:
        size = 60
    want, frames = {}, []
    for i, (name, (x, y)) in enumerate(shapes(rng, 400 if size else 150).items()):
        w = rng.uniform(0.1, 3, len(x))
        fit = pooled(x, y, w) if increasing else -pooled(x, -y, w)
        want[name] = (x, fit)
        frames.append(pd.DataFrame({"part": name, "x": x, "y": y, "w": w}))
    points = spark.createDataFrame(pd.concat(frames))
    blocks = isotonic_blocks(points, ["part"], increasing, size).toPandas()
    for name, (x, fit) in want.items():
        own = blocks[blocks.part == name].sort_values("x_lo")
        assert (own.x_lo.to_numpy()[1:] > own.x_hi.to_numpy()[:-1]).all()
        at = np.searchsorted(own.x_lo.to_numpy(), x, "right") - 1
        scale = np.abs(fit).max() + 1e-12
        assert np.allclose(own.value.to_numpy()[at], fit, rtol=1e-9, atol=1e-9 * scale), name
        assert len(own) == 1 + (np.abs(np.diff(fit)) > 1e-9 * scale).sum(), name
        assert np.isclose(own.w.sum(), frames[list(want).index(name)].w.sum())


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    pred = np.round(rng.gamma(2, 0.5, 500), 3)
    pdf = pd.DataFrame({"part": np.where(np.arange(500) % 3 == 0, "1", "0"), "IDpol": np.arange(500),
                        "pred": pred, "y": rng.poisson(pred), "w": rng.uniform(0, 1, 500)})
    pdf.loc[:9, "w"] = 0.0
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("sent, size", [(1 << 17, None), (0, None), (0, 40), (1 << 17, 40)])
@pytest.mark.parametrize("centered", [False, True])
def test_curve(spark, rows, monkeypatch, centered, sent, size):
    """Sent as arrays or merged with the rows; linear between knots, clipped beyond them."""
    pdf, df = rows
    monkeypatch.setattr(cal, "KNOTS_SENT", sent)
    model = cal.Isotonic(centered=centered, force_positive=False, rows_per_bucket=size).fit(df, ["0", "1"])
    asked = [(p, i, float(v)) for p in "01" for i, v in enumerate(
        [-1.0, 0.0, -0.0, *np.linspace(0.01, 6, 150), *([1.5] * 40), 99.0, *pdf.pred[:60]])]
    got = model.transform(spark.createDataFrame(asked, "part string, IDpol int, pred double")).toPandas()
    assert len(got) == len(asked)
    for part, g in pdf[pdf.w > 0].groupby("part"):
        g = g.assign(wy=g.w * g.y).groupby("pred")[["w", "wy"]].sum().reset_index()
        x, w = g.pred.to_numpy(), g.w.to_numpy()
        fit = pooled(x, (g.wy / g.w).to_numpy(), w)
        if centered:
            value = np.unique(fit)
            x, fit = np.array([np.average(x[fit == v], weights=w[fit == v]) for v in value]), value
        mine = got[got.part == part]
        assert np.allclose(mine.calibrated, np.interp(mine.pred, x, fit), rtol=1e-9, atol=1e-12)


def test_empty_and_unknown(spark, rows):
    _, df = rows
    model = cal.Isotonic().fit(df.where("part = '0'"), ["0"])
    assert model.transform(df.where("false")).collect() == []
    with pytest.raises(Exception, match="no model was fitted"):
        model.transform(df).where(F.col("calibrated") >= 0).count()
