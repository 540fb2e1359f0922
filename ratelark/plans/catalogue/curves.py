"""Ordered curves, metrics and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .. import oracle as o
from ...config import GROUP_BINS, Target, Weighting
from ...functions.columns import rounded
from ...operators import curves as c
from ...operators import groups as g
from ...operators import metrics as m
from ...session import stage
from ...sources.portfolio_views import prediction_view

BY = ["part"]


def staged_predictions(spark, sf, **kw):
    return stage(prediction_view(spark, sf, **kw), "predictions")


def staged_ranks(spark, sf, **kw):
    return stage(c.ordered_rows(prediction_view(spark, sf, **kw), BY), "ranked")


RANKED = """rk AS (
  SELECT *, row_number() OVER p AS rank, count(*) OVER (PARTITION BY part) AS n,
         sum(w) OVER p AS cum_w, sum(w * y) OVER p AS cum_wy, sum(w * pred) OVER p AS cum_wx,
         sum(w * y) OVER (PARTITION BY part) AS tot_wy,
         sum(w * pred) OVER (PARTITION BY part) AS tot_wx
  FROM t WINDOW p AS (PARTITION BY part ORDER BY pred, sha256('-' || IDpol)))"""


def grouped(value: str, y: str) -> str:
    return f"""SELECT part, {value} AS v, sum(w) AS gw, sum(w * {y}) AS gy FROM t GROUP BY 1, 2"""


def segments(value: str = "pred", y: str = "y", name: str = "seg") -> str:
    return f"""{name}_g AS ({grouped(value, y)}),
{name} AS (SELECT part, v, row_number() OVER p AS seg_id,
    (sum(gw) OVER p - gw) / sum(gw) OVER q AS x0, sum(gw) OVER p / sum(gw) OVER q AS x1,
    (sum(gy) OVER p - gy) / sum(gy) OVER q AS y0, sum(gy) OVER p / sum(gy) OVER q AS y1
  FROM {name}_g WINDOW p AS (PARTITION BY part ORDER BY v), q AS (PARTITION BY part))"""


def grid_sql(seg: str, m: int, name: str = "gr") -> str:
    return f"""{name} AS (
  SELECT s.part, i, max(CASE WHEN x1 > x0
      THEN y0 + greatest(0, least(1, (CAST(i AS DOUBLE) / {m} - x0) / (x1 - x0))) * (y1 - y0)
      ELSE y1 END) AS h
  FROM {seg} s, range({m + 1}) gg(i)
  WHERE CAST(i AS DOUBLE) / {m} >= x0 - 1e-12 AND CAST(i AS DOUBLE) / {m} <= x1 + 1e-12
  GROUP BY s.part, i)"""


@query("ordered_rows", f"""WITH {o.predictions()}, {RANKED}
SELECT part, IDpol, rank, n, {o.r('cum_w', 4)} AS cum_w, {o.r('cum_wy', 4)} AS cum_wy,
       {o.r('cum_wx', 4)} AS cum_wx FROM rk""")
def ordered_rows(spark, sf):
    rows = c.ordered_rows(staged_predictions(spark, sf), BY)
    return rows.select("part", "IDpol", "rank", "n",
                       *[rounded(F.col(k), 4).alias(k) for k in ("cum_w", "cum_wy", "cum_wx")])


SEG_OUT = ", ".join(f"{o.r(k)} AS {k}" for k in ("x0", "y0", "x1", "y1"))


def segment_output(seg, *extra):
    return seg.select("part", "seg_id", *extra,
                      *[rounded(F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("cc_segments", f"""WITH {o.predictions('pred_signal')}, {segments()}
SELECT part, seg_id, {SEG_OUT} FROM seg""")
def cc_segments(spark, sf):
    return segment_output(c.concentration_segments(
        staged_predictions(spark, sf, pred="pred_signal"), BY))


@query("cc_segments_step", f"""WITH {o.predictions('pred_signal')}, {segments()}
SELECT part, seg_id, {SEG_OUT.replace('round(y0', 'round(y1')} FROM seg""")
def cc_segments_step(spark, sf):
    return segment_output(c.concentration_segments(
        staged_predictions(spark, sf, pred="pred_signal"), BY, step=True))


@query("lorenz_segments", f"""WITH {o.predictions('pred_signal')}, {segments('pred', 'pred')}
SELECT part, seg_id, {SEG_OUT} FROM seg""")
def lorenz_segments(spark, sf):
    return segment_output(c.lorenz_segments(
        staged_predictions(spark, sf, pred="pred_signal"), BY))


@query("oracle_segments", f"""WITH {o.predictions()}, {segments('y', 'y')}
SELECT part, seg_id, {SEG_OUT} FROM seg""")
def oracle_segments(spark, sf):
    return segment_output(c.oracle_segments(staged_predictions(spark, sf), BY))


@query("cc_polyline", f"""WITH {o.predictions()}, {segments()},
pts AS (SELECT part, round(x0, 6) + 0.0 AS x, round(y0, 6) + 0.0 AS y FROM seg UNION ALL
        SELECT part, round(x1, 6) + 0.0, round(y1, 6) + 0.0 FROM seg)
SELECT part, x, min(y) AS y FROM pts GROUP BY part, x""")
def cc_polyline(spark, sf):
    seg = c.concentration_segments(staged_predictions(spark, sf), BY)
    flat = seg.withColumns({k: rounded(F.col(k)) for k in ("x0", "y0", "x1", "y1")})
    return c.polyline(flat, BY)


@query("cc_common_grid", f"""WITH {o.predictions()}, {segments()},
pts AS (SELECT round(CAST(i AS DOUBLE) / 199, 6) AS x FROM range(200) gg(i) UNION
        SELECT round(x0, 6) + 0.0 FROM seg UNION SELECT round(x1, 6) + 0.0 FROM seg)
SELECT DISTINCT x FROM pts""")
def cc_common_grid(spark, sf):
    seg = c.concentration_segments(staged_predictions(spark, sf), BY, step=True)
    return c.common_grid(seg, 200, step=True).select(rounded(F.col("x")).alias("x")).distinct()


@query("cc_mean_curve", f"""WITH {o.predictions('pred_signal')}, {segments()}, {grid_sql('seg', 199)}
SELECT i, {o.r('avg(h)')} AS mean, {o.r('stddev_pop(h)')} AS std,
       {o.r('CAST(i AS DOUBLE) / 199')} AS x FROM gr GROUP BY i""")
def cc_mean_curve(spark, sf):
    seg = c.concentration_segments(staged_predictions(spark, sf, pred="pred_signal"), BY)
    out = c.mean_curve(c.on_grid(seg, BY, 199, {"h": ("y0", "y1")}), [], 199)
    return out.select("i", *[rounded(F.col(k)).alias(k) for k in ("mean", "std", "x")])


CALIB_SEG = f"""{RANKED},
seg AS (SELECT part, IDpol, rank AS seg_id,
  (cum_wx - w * pred) / tot_wx AS x0, (cum_wy - w * y) / tot_wy AS y0,
  cum_wx / tot_wx AS x1, cum_wy / tot_wy AS y1 FROM rk)"""


@query("cumul_calib", f"""WITH {o.predictions('pred_unique')}, {CALIB_SEG}
SELECT part, IDpol, seg_id, {SEG_OUT} FROM seg""")
def cumul_calib(spark, sf):
    ranked = c.ordered_rows(staged_predictions(spark, sf, pred="pred_unique"), BY)
    return segment_output(c.cumulative_calibration_segments(ranked, BY), "IDpol")


@query("cumul_calib_mean", f"""WITH {o.predictions()}, {CALIB_SEG}, {grid_sql('seg', 99)}
SELECT i, {o.r('avg(h)')} AS mean, {o.r('stddev_pop(h)')} AS std,
       {o.r('CAST(i AS DOUBLE) / 99')} AS x FROM gr GROUP BY i""")
def cumul_calib_mean(spark, sf):
    seg = c.cumulative_calibration_segments(staged_ranks(spark, sf), BY)
    out = c.mean_curve(c.on_grid(seg, BY, 99, {"h": ("y0", "y1")}), [], 99)
    return out.select("i", *[rounded(F.col(k)).alias(k) for k in ("mean", "std", "x")])


@query("cumul_calib_sides", f"""WITH {o.predictions()}, {CALIB_SEG}, {grid_sql('seg', 99)},
q AS (SELECT part, i, CAST(i AS DOUBLE) / 99 AS x0, h AS y0, CAST(i + 1 AS DOUBLE) / 99 AS x1,
             lead(h) OVER (PARTITION BY part ORDER BY i) AS y1 FROM gr),
f AS (SELECT *, y0 - x0 AS f0, y1 - x1 AS f1,
             x0 + (y0 - x0) / ((y0 - x0) - (y1 - x1)) * (x1 - x0) AS cut
      FROM q WHERE y1 IS NOT NULL),
p AS (SELECT part, i, 0 AS piece, x0, y0, CASE WHEN f0 * f1 < 0 THEN cut ELSE x1 END AS x1,
             CASE WHEN f0 * f1 < 0 THEN cut ELSE y1 END AS y1,
             CASE WHEN f0 <> 0 THEN f0 ELSE f1 END AS f FROM f
      UNION ALL SELECT part, i, 1, cut, cut, x1, y1, f1 FROM f WHERE f0 * f1 < 0)
SELECT part, i, piece, {SEG_OUT},
       CASE WHEN f > 0 THEN 'under' WHEN f < 0 THEN 'over' ELSE 'fair' END AS side FROM p""")
def cumul_calib_sides(spark, sf):
    seg = c.cumulative_calibration_segments(staged_ranks(spark, sf), BY)
    out = c.calibration_sides(c.on_grid(seg, BY, 99, {"h": ("y0", "y1")}), BY, 99)
    return out.select("part", "i", "piece", "side",
                      *[rounded(F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1")])


def wide(df, names, digits=6):
    return df.select("part", *[rounded(F.col(f"`{n}`"), digits).alias(n.replace("(", "_")
                               .replace(")", "").replace(".", "_")) for n in names])


POINT = ["MAE", "MAE_plain", "RMSE", "R2", "MBD", "MPD", "MTD(1.2)", "MTD(1.5)", "MTD(1.7)",
         "MTD(1.9)"]


def tweedie_sql(p: float) -> str:
    a, b = f"CAST({1 - p:.1f} AS DOUBLE)", f"CAST({2 - p:.1f} AS DOUBLE)"
    return (f"round(2 * sum(w * (pow(greatest(y, 0), {b}) / ({a} * {b}) - y * pow(pred, {a}) / {a}"
            f" + pow(pred, {b}) / {b})) / sum(w), 6)")


POINT_SQL = f"""round(sqrt(sum(w * abs(y - pred)) / sum(w)), 6) AS MAE,
  round(sum(w * abs(y - pred)) / sum(w), 6) AS MAE_plain,
  round(sqrt(sum(w * (y - pred) * (y - pred)) / sum(w)), 6) AS RMSE,
  round(1 - sum(w * (y - pred) * (y - pred))
        / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS R2,
  {o.r('sum(w * (y - pred)) / sum(w)')} AS MBD,
  round(2 * sum(w * (CASE WHEN y > 0 THEN y * ln(y / pred) ELSE 0 END - y + pred))
        / sum(w), 6) AS MPD,
  {tweedie_sql(1.2)} AS MTD_1_2, {tweedie_sql(1.5)} AS MTD_1_5,
  {tweedie_sql(1.7)} AS MTD_1_7, {tweedie_sql(1.9)} AS MTD_1_9"""


@query("pointwise_metrics",
       f"WITH {o.predictions('pred_signal')} SELECT part, {POINT_SQL} FROM t GROUP BY part")
def pointwise_metrics(spark, sf):
    return wide(m.pointwise_metrics(prediction_view(spark, sf, pred="pred_signal"), BY), POINT)


@query("gamma_deviance", f"""WITH {o.predictions('pred_signal', 'ClaimSeverity_TRG',
                                                 'greatest(ClaimCountWeight, 1)')}
SELECT part, round(2 * sum(w * (ln(pred * 1000 / y) + y / (pred * 1000) - 1)) / sum(w), 6) AS MGD
FROM t GROUP BY part""")
def gamma_deviance(spark, sf):
    rows = prediction_view(spark, sf, "pred_signal", Target.SEVERITY, Weighting.CLAIM_COUNT)
    return wide(m.pointwise_metrics(rows.withColumn("pred", F.col("pred") * 1000), BY, ["MGD"]),
                ["MGD"])


SPEARMAN_SQL = """rx AS (SELECT part, pred, sum(sum(w)) OVER (PARTITION BY part ORDER BY pred)
     - sum(w) + (count(*) + 1) / CAST(2 AS DOUBLE) * (sum(w) / count(*)) AS rx
   FROM t GROUP BY part, pred),
ry AS (SELECT part, y, sum(sum(w)) OVER (PARTITION BY part ORDER BY y)
     - sum(w) + (count(*) + 1) / CAST(2 AS DOUBLE) * (sum(w) / count(*)) AS ry
   FROM t GROUP BY part, y),
z AS (SELECT t.part, t.w, rx, ry FROM t JOIN rx ON t.part = rx.part AND t.pred = rx.pred
      JOIN ry ON t.part = ry.part AND t.y = ry.y),
mu AS (SELECT part, sum(w * rx) / sum(w) AS mx, sum(w * ry) / sum(w) AS my FROM z GROUP BY part)
SELECT z.part, round(sum(w * (rx - mx) * (ry - my))
       / sqrt(sum(w * pow(rx - mx, 2)) * sum(w * pow(ry - my, 2))), 6) AS SC
FROM z JOIN mu ON z.part = mu.part GROUP BY z.part"""


@query("spearman_weighted", f"WITH {o.predictions('pred_signal')}, {SPEARMAN_SQL}")
def spearman_weighted(spark, sf):
    rows = staged_predictions(spark, sf, pred="pred_signal")
    return wide(m.weighted_spearman(rows, BY), ["SC"])


GINI_SQL = f"""{segments('pred', 'y', 'cc')}, {segments('pred', 'pred', 'lc')},
{segments('y', 'y', 'orc')},
a AS (SELECT part, 1 - sum((x1 - x0) * (y0 + y1)) AS ccgi FROM cc GROUP BY part),
b AS (SELECT part, 1 - sum((x1 - x0) * (y0 + y1)) AS lcgi FROM lc GROUP BY part),
d AS (SELECT part, 1 - sum((x1 - x0) * (y0 + y1)) AS best FROM orc GROUP BY part)"""


@query("gini_indices", f"""WITH {o.predictions('pred_signal')}, {GINI_SQL}
SELECT a.part, {o.r('lcgi')} AS LCGI, {o.r('ccgi')} AS CCGI,
       {o.r('CASE WHEN abs(best) <= 1e-5 THEN 0 ELSE ccgi / best END')} AS NCCGI
FROM a JOIN b ON a.part = b.part JOIN d ON a.part = d.part""")
def gini_indices(spark, sf):
    rows = staged_predictions(spark, sf, pred="pred_signal")
    return wide(m.gini_indices(rows, BY), ["LCGI", "CCGI", "NCCGI"])


ABC_SQL = f"""{segments('pred', 'y', 'cc')}, {segments('pred', 'pred', 'lc')},
{grid_sql('cc', 4999, 'gc')}, {grid_sql('lc', 4999, 'gl')}"""


@query("abc_sdcl", f"""WITH {o.predictions('pred_signal')}, {ABC_SQL}
SELECT gc.part, {o.r('''sum(abs(gc.h - gl.h) * CASE WHEN gc.i IN (0, 4999) THEN 0.5 ELSE 1.0 END)
       / 4999''')} AS ABC, {o.r('max(abs(gc.h - gl.h))')} AS SDCL
FROM gc JOIN gl ON gc.part = gl.part AND gc.i = gl.i GROUP BY gc.part""")
def abc_sdcl(spark, sf):
    pairs = c.pair_segments(staged_predictions(spark, sf, pred="pred_signal"), BY)
    return wide(m.abc_sdcl(pairs, BY), ["ABC", "SDCL"])


CCI_SQL = f"""{CALIB_SEG}
SELECT part,
  {o.r('''sum((x1 - x0) * ((greatest(y0, x0) - least(y0, x0))
       + (greatest(y1, x1) - least(y1, x1))) / 2)''')} AS CCI,
  {o.r('sum((x1 - x0) * ((x0 - least(y0, x0)) + (x1 - least(y1, x1))) / 2)')} AS COI,
  {o.r('sum((x1 - x0) * ((greatest(y0, x0) - x0) + (greatest(y1, x1) - x1)) / 2)')} AS CUI
FROM seg GROUP BY part"""


@query("cci_coi_cui", f"WITH {o.predictions()}, {CCI_SQL}")
def cci_coi_cui(spark, sf):
    return wide(m.calibration_indices(staged_ranks(spark, sf), BY), ["CCI", "COI", "CUI"])


def strict_groups(bins=GROUP_BINS) -> str:
    values = ", ".join(f"({b})" for b in bins)
    return f"""{RANKED},
gx AS (SELECT rk.*, n_bins, CAST(floor((rank - 1) * n_bins / n) + 1 AS INT) AS grp
       FROM rk, (VALUES {values}) nb2(n_bins)),
gm AS (SELECT part, n_bins, grp, count(*) AS n_obs, sum(w) AS sum_w,
              sum(w * pred) / sum(w) AS mp, sum(w * y) / sum(w) AS mt
       FROM gx GROUP BY part, n_bins, grp)"""


@query("bins_metrics", f"""WITH {o.predictions()}, {strict_groups()}
SELECT part, n_bins, {o.r('max(abs(mt - mp))')} AS MAB,
       {o.r('max(greatest(mt, mp) - mt)')} AS MOP, {o.r('max(mt - least(mt, mp))')} AS MUP
FROM gm GROUP BY part, n_bins""")
def bins_metrics(spark, sf):
    ranked = staged_ranks(spark, sf)
    flat = m.bin_metrics(g.bin_bias(ranked, BY), BY)
    rows = F.array(*[F.struct(F.lit(b).alias("n_bins"),
                              *[rounded(F.col(f"{k}_{b}B")).alias(k) for k in ("MAB", "MOP", "MUP")])
                     for b in GROUP_BINS])
    return flat.select("part", F.explode(rows).alias("r")).select("part", "r.*")


QUANTILE_SQL = """qv AS (
  SELECT part, n_bins, grp, y, (sum(w) OVER p - w / 2) / sum(w) OVER (PARTITION BY part, n_bins, grp)
         AS pos FROM gx
  WINDOW p AS (PARTITION BY part, n_bins, grp ORDER BY y, sha256('-' || IDpol)
               ROWS UNBOUNDED PRECEDING)),
qq AS (
  SELECT part, n_bins, grp, q, max(CASE WHEN pos <= q THEN pos END) AS p0,
         max(CASE WHEN pos <= q THEN y END) AS y0, min(CASE WHEN pos >= q THEN pos END) AS p1,
         min(CASE WHEN pos >= q THEN y END) AS y1
  FROM qv, (VALUES (0.01), (0.1), (0.25), (0.5), (0.75), (0.9), (0.99)) qs(q)
  GROUP BY part, n_bins, grp, q),
qr AS (
  SELECT part, n_bins, grp, q, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0
         WHEN p1 <= p0 THEN y0 ELSE y0 + (q - p0) / (p1 - p0) * (y1 - y0) END AS v FROM qq),
qw AS (
  SELECT part, n_bins, grp, max(v) FILTER (WHERE q = 0.01) AS q_01,
         max(v) FILTER (WHERE q = 0.1) AS q_10, max(v) FILTER (WHERE q = 0.25) AS q_25,
         max(v) FILTER (WHERE q = 0.5) AS q_50, max(v) FILTER (WHERE q = 0.75) AS q_75,
         max(v) FILTER (WHERE q = 0.9) AS q_90, max(v) FILTER (WHERE q = 0.99) AS q_99
  FROM qr GROUP BY part, n_bins, grp)"""

STATS_SQL = f"""{strict_groups()}, {QUANTILE_SQL},
gs AS (SELECT gx.part, gx.n_bins, gx.grp,
              sqrt(sum(w * pow(pred - mp, 2)) / sum(w)) AS sp,
              sqrt(sum(w * pow(y - mt, 2)) / sum(w)) AS st
       FROM gx JOIN gm ON gx.part = gm.part AND gx.n_bins = gm.n_bins AND gx.grp = gm.grp
       GROUP BY gx.part, gx.n_bins, gx.grp),
stats AS (SELECT gm.part, gm.n_bins, gm.grp, n_obs, sum_w, mp AS mean_pred, mt AS mean_target,
       sp AS std_pred, st AS std_target, q_01, q_10, q_25, q_50, q_75, q_90, q_99,
       mt - mp AS bias_deviation, greatest(mt, mp) - mt AS mean_overpricing,
       mt - least(mt, mp) AS mean_underpricing, abs(mt - mp) AS abs_bias_deviation
  FROM gm JOIN gs ON gm.part = gs.part AND gm.n_bins = gs.n_bins AND gm.grp = gs.grp
  JOIN qw ON gm.part = qw.part AND gm.n_bins = qw.n_bins AND gm.grp = qw.grp)"""
STATS = [k for k in g.AVERAGED if k != "n_obs"]


def rounded_all(df, keep, names, digits=6):
    return df.select(*keep, *[rounded(F.col(n), digits).alias(n) for n in names])


@query("group_stats", f"""WITH {o.predictions('pred_signal')}, {STATS_SQL}
SELECT part, n_bins, grp AS "group", n_obs, {o.r('sum_w', 4)} AS sum_w,
       {', '.join(f'{o.r(k, 9)} AS {k}' for k in STATS)} FROM stats""")
def group_stats(spark, sf):
    stats = g.group_statistics(staged_ranks(spark, sf, pred="pred_signal"), BY)
    return rounded_all(stats.withColumn("sum_w", rounded(F.col("sum_w"), 4)),
                       ["part", "n_bins", "group", "n_obs", "sum_w"], STATS, 9)


@query("group_stats_selected", f"""WITH {o.predictions('pred_signal')}, {STATS_SQL}
SELECT part, n_bins, grp AS "group", n_obs, {o.r('round(mean_pred, 4) - 0')} AS mean_pred,
       {o.r('q_50', 4)} AS q_50 FROM stats WHERE n_bins = 20 AND grp IN (1, 10, 20)""")
def group_stats_selected(spark, sf):
    stats = g.group_statistics(staged_ranks(spark, sf, pred="pred_signal"), BY, [20],
                               groups=[1, 10, 20], round_digits=4)
    return rounded_all(stats, ["part", "n_bins", "group", "n_obs"], ["mean_pred", "q_50"])


@query("group_stats_avg", f"""WITH {o.predictions('pred_signal')}, {STATS_SQL},
av AS (SELECT n_bins, grp, {', '.join(f'avg({k}) AS {k}' for k in g.AVERAGED)},
              {', '.join(f'stddev_samp({k}) AS std_of_{k}' for k in g.SPREAD)}
       FROM stats GROUP BY n_bins, grp)
SELECT n_bins, grp AS "group", {', '.join(f'{o.r(k)} AS {k}' for k in g.AVERAGED)},
       {', '.join(f'{o.r("std_of_" + k)} AS std_of_{k}' for k in g.SPREAD)},
       {', '.join(f'''{o.r(f"CASE WHEN abs(mean_target) > 1e-8 THEN {k} / mean_target END")}
                  AS rel_{k}''' for k in g.RELATIVE)} FROM av""")
def group_stats_avg(spark, sf):
    stats = g.group_statistics(staged_ranks(spark, sf, pred="pred_signal"), BY)
    out = g.average_statistics(stage(stats, "group_stats"), [])
    return rounded_all(out, ["n_bins", "group"], [k for k in out.columns
                                                  if k not in ("n_bins", "group")])


GROUP_MEANS = f"{strict_groups()}"


@query("lift_table", f"""WITH {o.predictions()}, {GROUP_MEANS}
SELECT n_bins, grp AS "group", {o.r('avg(mp)', 8)} AS mean_pred, {o.r('avg(mt)', 8)} AS mean_target,
       {o.r('stddev_pop(mp)', 8)} AS std_pred, {o.r('avg(greatest(mp - mt, 0))', 8)} AS overpricing,
       {o.r('avg(greatest(mt - mp, 0))', 8)} AS underpricing FROM gm GROUP BY n_bins, grp""")
def lift_table(spark, sf):
    out = g.lift_table(g.bin_bias(staged_ranks(spark, sf), BY), [])
    return rounded_all(out, ["n_bins", "group"], out.columns[2:], 8)


@query("simple_lift_table", f"""WITH {o.predictions()}, {GROUP_MEANS}
SELECT n_bins, grp AS "group", {o.r('avg(mp)', 8)} AS mean_pred, {o.r('stddev_pop(mp)', 8)} AS std_pred,
       {o.r('avg(mt)', 8)} AS mean_target, {o.r('stddev_pop(mt)', 8)} AS std_target
FROM gm GROUP BY n_bins, grp""")
def simple_lift_table(spark, sf):
    out = g.simple_lift_table(g.bin_bias(staged_ranks(spark, sf), BY), [])
    return rounded_all(out, ["n_bins", "group"], out.columns[2:], 8)


@query("auto_calibration", f"""WITH {o.predictions('pred_unique')},
e AS (SELECT part, list_sort(list_distinct(quantile_cont(pred,
        [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
      FROM t GROUP BY part),
b AS (SELECT t.*, greatest(len(list_filter(edges, lambda q : q < pred)) - 1, 0) AS bin
      FROM t JOIN e ON t.part = e.part)
SELECT part, CAST(bin AS INT) AS bin, {o.r('sum(w * pred) / sum(w)')} AS mean_pred,
       {o.r('sum(w * y) / sum(w)')} AS mean_target, round(min(pred), 6) AS min_pred,
       round(max(pred), 6) AS max_pred FROM b GROUP BY part, bin""")
def auto_calibration(spark, sf):
    out = g.auto_calibration(staged_predictions(spark, sf, pred="pred_unique"), BY, 10)
    return rounded_all(out, ["part", "bin"], out.columns[2:])
