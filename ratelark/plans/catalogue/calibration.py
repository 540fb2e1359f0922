"""Calibration of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .curves import RANKED, staged_predictions
from .. import oracle as o
from ...functions.columns import kernel_weight, rounded
from ...operators import calibrate as cal
from ...operators.glm import GlmSpec
from ...sources.portfolio_views import prediction_view

PARTS = [str(i) for i in range(5)]
SIGNAL = dict(pred="pred_signal")


def calibrated(spark, sf, model, digits=6, **kw):
    rows = staged_predictions(spark, sf, **kw)
    return model.fit(rows, PARTS).transform(rows).select(
        "part", "IDpol", rounded(F.col("calibrated"), digits).alias("calibrated"))


@query("calib_pure", f"WITH {o.predictions()} SELECT part, IDpol, pred AS calibrated FROM t")
def calib_pure(spark, sf):
    return calibrated(spark, sf, cal.PureCalibration())


BINS_SQL = """e AS (SELECT part, list_sort(list_distinct(quantile_cont(pred,
      [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM t GROUP BY part),
b AS (SELECT t.*, len(list_filter(edges[2:-2], lambda q : q <= pred)) AS bin
      FROM t JOIN e ON t.part = e.part),
m AS (SELECT part, bin, sum(w * y) / sum(w) AS v FROM b GROUP BY part, bin),
cb AS (SELECT b.part, b.IDpol, b.y, b.w, v AS calibrated
       FROM b JOIN m ON b.part = m.part AND b.bin = m.bin)"""


@query("calib_bin_means", f"""WITH {o.predictions('pred_signal')}, {BINS_SQL}
SELECT part, IDpol, round(calibrated, 6) AS calibrated FROM cb""")
def calib_bin_means(spark, sf):
    return calibrated(spark, sf, cal.EqualBinsMeans(10), **SIGNAL)


def rebalance_query(method, change):
    @query(f"calib_rebalance_{method}", f"""WITH {o.predictions('pred_signal')},
f AS (SELECT part, sum(w * y) / sum(w) AS ey, sum(w * pred) / sum(w) AS ep FROM t GROUP BY part)
SELECT t.part, IDpol, {o.r(change)} AS calibrated FROM t JOIN f ON t.part = f.part""")
    def run(spark, sf):
        return calibrated(spark, sf, cal.Rebalanced(cal.PureCalibration(), method), **SIGNAL)
    return run


rebalance_query("scale", "pred * (ey / ep)")
rebalance_query("shift", "pred + (ey - ep)")


POOL_SQL = f"""{RANKED},
f AS (SELECT part, max(CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS lo,
             max(CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) AS hi,
             max(CASE WHEN rank <= floor(n * CAST(0.1 AS DOUBLE)) THEN y END) AS top,
             min(CASE WHEN y > 0 THEN rank END) AS fp FROM rk GROUP BY part),
g AS (SELECT rk.*, CASE WHEN lo = 0 OR top <= 0 THEN coalesce(fp, lo) ELSE lo END AS lo, hi
      FROM rk JOIN f ON rk.part = f.part),
m AS (SELECT part, sum(CASE WHEN rank <= lo THEN w * y END) / sum(CASE WHEN rank <= lo THEN w END) AS ml,
             sum(CASE WHEN rank > n - hi THEN w * y END) / sum(CASE WHEN rank > n - hi THEN w END) AS mh
      FROM g GROUP BY part),
pooled AS (SELECT g.part, IDpol, CASE WHEN rank > n - hi THEN mh WHEN rank <= lo THEN ml ELSE y END AS y,
                  pred, w FROM g JOIN m ON g.part = m.part)"""


@query("calib_tail_pool", f"""WITH {o.predictions('pred_signal')}, {POOL_SQL}
SELECT part, IDpol, round(y, 6) AS y_pooled FROM pooled""")
def calib_tail_pool(spark, sf):
    out = cal.pool_tails(staged_predictions(spark, sf, **SIGNAL), ["part"], 0.1, 0.05)
    return out.select("part", "IDpol", rounded(F.col("y_pooled")).alias("y_pooled"))


@query("kernel_weights", f"""WITH {o.predictions()},
u AS (SELECT part, IDpol, abs(pred - CAST(0.4 AS DOUBLE)) / CAST(0.25 AS DOUBLE) AS u FROM t)
SELECT part, IDpol, round(greatest(0, least(1, 1 - u)), 6) + 0.0 AS triangular,
       CASE WHEN u <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rectangular,
       round(exp(-0.5 * u * u), 6) AS gaussian FROM u""")
def kernel_weights(spark, sf):
    d, h = F.abs(F.col("pred") - 0.4), F.lit(0.25)
    return prediction_view(spark, sf).select("part", "IDpol", *[
        rounded(kernel_weight(d, h, k)).alias(k) for k in ("triangular", "rectangular", "gaussian")])


def window_sql(share: float) -> str:
    """Centres ``c`` with the ranks and the reach of their nearest rows."""
    return f"""{RANKED},
ce AS (SELECT DISTINCT part, pred AS c FROM t),
mi AS (SELECT a.part, (a.pred + b.pred) / 2 AS m FROM rk a JOIN rk b ON a.part = b.part
       AND b.rank = a.rank + CAST(ceil(a.n * CAST({share} AS DOUBLE)) AS BIGINT)),
bw AS (SELECT ce.part, c, count(m) FILTER (WHERE m < c) AS below
       FROM ce LEFT JOIN mi ON ce.part = mi.part GROUP BY ce.part, c),
kn AS (SELECT part, CAST(ceil(max(n) * CAST({share} AS DOUBLE)) AS BIGINT) AS k FROM rk GROUP BY part),
wi AS (SELECT bw.part, c, below + 1 AS lo, below + k AS hi FROM bw JOIN kn ON bw.part = kn.part),
wd AS (SELECT wi.part, c, lo, hi, abs(pred - c) AS d, pred - c AS sd, w, y,
              max(abs(pred - c)) OVER (PARTITION BY wi.part, c) AS h
       FROM wi JOIN rk ON wi.part = rk.part AND rk.rank BETWEEN lo AND hi)"""


def local_mean_query(kernel, weight):
    for suffix, rows in (("", "pred_tied"), ("_unique", "pred_unique")):
        @query(f"calib_moving_mean_{kernel}{suffix}",
               f"""WITH {o.predictions(rows)}, {window_sql(0.2)},
kw AS (SELECT *, w * CASE WHEN h > 0 THEN {weight} ELSE 1 END AS kw FROM wd),
v AS (SELECT part, c, sum(kw * y) / sum(kw) AS v FROM kw GROUP BY part, c)
SELECT t.part, IDpol, round(v, 6) AS calibrated
FROM t JOIN v ON t.part = v.part AND t.pred = v.c""")
        def run(spark, sf, rows=rows):
            return calibrated(spark, sf, cal.LocalMean(0.2, kernel), pred=rows)


local_mean_query("rectangular", "1")
local_mean_query("triangular", "greatest(0, 1 - d / h)")
local_mean_query("gaussian", "exp(-0.5 * (d / h) * (d / h))")


def loess_query(name, rows, model, digits):
    @query(name, f"""WITH {o.predictions(rows)}, {window_sql(0.5)},
kw AS (SELECT part, c, y, sd / (CASE WHEN h > 0 THEN h ELSE 1 END) AS u,
         w * CASE WHEN h > 0 THEN pow(1 - pow(d / h, 3), 3) ELSE 1 END AS kw FROM wd),
s AS (SELECT part, c, sum(kw) AS s0, sum(kw * u) AS s1, sum(kw * u * u) AS s2,
        sum(kw * u * u * u) AS s3, sum(kw * u * u * u * u) AS s4, sum(kw * y) AS t0,
        sum(kw * u * y) AS t1, sum(kw * u * u * y) AS t2 FROM kw GROUP BY part, c),
d AS (SELECT *, s0 * s2 - s1 * s1 AS d1, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3)
        + s2 * (s1 * s3 - s2 * s2) AS d2 FROM s),
v AS (SELECT part, c, CASE WHEN d2 > 1e-12 * s0 * s0 * s0
          THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / d2
        WHEN d1 > 1e-12 * s0 * s0 THEN (t0 * s2 - t1 * s1) / d1 ELSE t0 / s0 END AS v FROM d)
SELECT t.part, IDpol, round(v, {digits}) AS calibrated
FROM t JOIN v ON t.part = v.part AND t.pred = v.c""")
    def run(spark, sf):
        return calibrated(spark, sf, model, digits, pred=rows)
    return run


loess_query("loess", "pred_tied", cal.LocalPolynomial(0.5, 2, nodes=200), 6)
# many values, some of windows near the limit of det2: four digits, so that float noise there (2e-8
# at sf0.01, 1e-5 at sf0.001) seldom decides the last
loess_query("loess_unique", "pred_unique", cal.LocalPolynomial(), 4)


def isotonic_sql(rows: str = "t") -> str:
    """CTEs up to ``fit(part, i, x, gw, v)``: the max-min formula over all runs of predictions."""
    return f"""p AS (SELECT part, pred AS x, sum(w) AS gw, sum(w * y) AS gy,
        row_number() OVER (PARTITION BY part ORDER BY pred) AS i FROM {rows} GROUP BY part, pred),
cu AS (SELECT *, sum(gw) OVER q AS cw, sum(gy) OVER q AS cy FROM p
       WINDOW q AS (PARTITION BY part ORDER BY i)),
ab AS (SELECT a.part, a.i AS a, b.i AS b,
              (b.cy - a.cy + a.gy) / (b.cw - a.cw + a.gw) AS v
       FROM cu a JOIN cu b ON a.part = b.part AND a.i <= b.i),
mn AS (SELECT part, a, b, min(v) OVER (PARTITION BY part, a ORDER BY b DESC) AS v FROM ab),
iso AS (SELECT part, b AS i, max(v) AS v FROM mn GROUP BY part, b),
fit AS (SELECT cu.part, cu.i, x, gw, v FROM cu JOIN iso ON cu.part = iso.part AND cu.i = iso.i)"""


CENTERED_SQL = """ce AS (SELECT part, sum(gw * x) / sum(gw) AS x, round(v, 10) AS k, max(v) AS v
       FROM fit GROUP BY part, round(v, 10)),
sg AS (SELECT part, x AS x0, v AS y0, lead(x) OVER p AS x1, lead(v) OVER p AS y1,
              row_number() OVER p AS i FROM ce WINDOW p AS (PARTITION BY part ORDER BY x)),
ev AS (SELECT t.part, IDpol, CASE WHEN x1 IS NULL OR pred <= x0 THEN y0
              ELSE y0 + (pred - x0) / (x1 - x0) * (y1 - y0) END AS v
       FROM t JOIN sg ON t.part = sg.part AND (pred >= x0 OR i = 1) AND (pred < x1 OR x1 IS NULL))"""


def isotonic_query(name, model, rows, pool=False, centered=False):
    """The calibrated prediction of every row; ``pool``: 0.1 and 0.05 of the tails are pooled."""
    found = ("SELECT part, IDpol, round(v, 6) AS calibrated FROM ev" if centered else
             "SELECT t.part, IDpol, round(v, 6) AS calibrated\n"
             "FROM t JOIN fit ON t.part = fit.part AND t.pred = fit.x")
    steps = [o.predictions(rows), *([POOL_SQL] if pool else []),
             isotonic_sql("pooled" if pool else "t"), *([CENTERED_SQL] if centered else [])]

    @query(name, f"WITH {', '.join(steps)}\n{found}")
    def run(spark, sf):
        return calibrated(spark, sf, model, pred=rows)
    return run


TAILS = cal.Isotonic(low=0.1, high=0.05)
isotonic_query("isotonic", cal.Isotonic(force_positive=False), "pred_tied")
isotonic_query("centered_isotonic", cal.Isotonic(centered=True, force_positive=False), "pred_tied",
               centered=True)
isotonic_query("isotonic_tails", TAILS, "pred_signal", pool=True)
isotonic_query("isotonic_unique", cal.Isotonic(force_positive=False), "pred_unique")
isotonic_query("centered_isotonic_unique", cal.Isotonic(centered=True, force_positive=False),
               "pred_unique", centered=True)
isotonic_query("isotonic_tails_unique", TAILS, "pred_unique", pool=True)


@query("calib_glm_gamma")
def calib_glm_gamma(spark, sf):
    return calibrated(spark, sf, cal.make_calibrator("gamma_glm"), **SIGNAL)


@query("calib_glm_poisson")
def calib_glm_poisson(spark, sf):
    return calibrated(spark, sf, cal.make_calibrator("poisson_glm"), **SIGNAL)


@query("calib_glm_tweedie")
def calib_glm_tweedie(spark, sf):
    return calibrated(spark, sf, cal.GlmCalibration(GlmSpec("tweedie", "log", 1.5)), **SIGNAL)


def optimality_query(name, model):
    @query(f"{name}_optimality", f"""WITH {o.predictions('pred_signal')}
SELECT DISTINCT part, feature, CAST(0 AS DOUBLE) AS residual
FROM t, (VALUES ('(constant)'), ('pred')) fe(feature)""")
    def run(spark, sf):
        """The score equations hold at the fitted coefficients, to a thousandth of their terms."""
        rows = staged_predictions(spark, sf, **SIGNAL)
        left = model.fit(rows, PARTS).models.score_residuals(
            rows, model.spec, "y", "w" if model.weighted else None)
        return left.withColumn("residual", rounded(F.col("residual"), 3))
    return run


optimality_query("calib_glm_gamma", cal.make_calibrator("gamma_glm"))
optimality_query("calib_glm_poisson", cal.make_calibrator("poisson_glm"))
optimality_query("calib_glm_tweedie", cal.make_calibrator("tweedie_glm", {"power": 1.5}))
