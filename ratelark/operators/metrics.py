"""Model metrics per part: pointwise, rank, curve and bin metrics.

All of them read one frame ``(*by, key, y, pred, w)``.  Pointwise metrics share
one aggregation; the ordered ones share one ranked frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GROUP_BINS, TWEEDIE_POWERS, Target, Weighting
from ..functions.columns import (gamma_deviance, no_nan, poisson_deviance, ratio,
                                 tweedie_deviance, weighted_mean)
from ..session import outer, passing, stage
from .curves import (concentration_segments, on_grid, ordered_rows, pair_columns,
                     pair_segments)
from .groups import bin_bias
from .ordered import bucket_size, derived, ordered_prefix, plain_zero, rank_lookup

CURVE_GRID = 4999
GINI_ZERO = 1e-5
# Short metric names and whether a larger value is better.
LARGER_IS_BETTER = {
    "MAE": False, "RMSE": False, "R2": True, "MBD": None, "SC": True, "ABC": False, "SDCL": False,
    "CCI": False, "COI": False, "CUI": False, "LCGI": True, "CCGI": True, "NCCGI": True,
    "MPD": False, "MGD": False, "MTD": False, "MAB": False, "MOP": False, "MUP": False,
}
COMMON = ["MAE", "RMSE", "R2", "MBD", "SC", "ABC", "SDCL", "CCI", "COI", "CUI", "LCGI", "CCGI",
          "NCCGI"]
WEIGHT_PREFIX = {Weighting.EXPOSURE: "ew", Weighting.CLAIM_COUNT: "nw", Weighting.ONE: ""}


def tweedie_name(power: float) -> str:
    return f"MTD({power:g})"


def larger_is_better(name: str) -> bool | None:
    base = name.split("(")[0].split("_")[0]
    return LARGER_IS_BETTER[base]


def metric_names(target: Target, bins: list[int] = GROUP_BINS) -> list[str]:
    """The metric set of a target, without weight prefixes."""
    if target in (Target.CLAIMS_NUMBER, Target.FREQUENCY):
        deviances = ["MPD"]
    elif target is Target.SEVERITY:
        deviances = ["MGD"]
    else:
        deviances = [tweedie_name(p) for p in TWEEDIE_POWERS]
    by_bins = [f"{m}_{b}B" for m in ("MAB", "MOP", "MUP") for b in bins]
    return COMMON + deviances + by_bins


def display_name(name: str, weighting: Weighting, prefix: str | None = None) -> str:
    """Curve and pointwise metrics carry the weight prefix, bin metrics do not."""
    if not name.endswith("B") or "_" not in name:
        name = WEIGHT_PREFIX[weighting] + name
    return f"{prefix}_{name}" if prefix else name


def pointwise_metrics(df: DataFrame, by: list[str], names: list[str] | None = None,
                      y: str = "y", x: str = "pred", w: str = "w") -> DataFrame:
    """MAE (a root, by definition here), MAE_plain, RMSE, R2, MBD and deviances, one pass.

    A deviance is null where the data leaves its domain.
    """
    t, p, wt = F.col(y).cast("double"), F.col(x).cast("double"), F.col(w).cast("double")
    err = t - p
    mae = weighted_mean(F.abs(err), wt)
    mean = weighted_mean(t, wt)
    spread = F.sum(wt * t * t) - mean * F.sum(wt * t)
    ok_pois = F.bool_and((t >= 0) & (p > 0))
    ok_gam = F.bool_and((t > 0) & (p > 0))
    known = {
        "MAE": F.sqrt(mae), "MAE_plain": mae,
        "RMSE": F.sqrt(weighted_mean(err * err, wt)),
        "R2": 1 - F.sum(wt * err * err) / F.when(spread != 0, spread),
        "MBD": weighted_mean(err, wt),
        "MPD": F.when(ok_pois, weighted_mean(poisson_deviance(t, p), wt)),
        "MGD": F.when(ok_gam, weighted_mean(gamma_deviance(t, p), wt)),
    }
    for power in TWEEDIE_POWERS:
        known[tweedie_name(power)] = F.when(
            ok_pois, weighted_mean(tweedie_deviance(t, p, power), wt))
    for name in names or []:
        if name.startswith("MTD(") and name not in known:
            known[name] = F.when(ok_pois, weighted_mean(
                tweedie_deviance(t, p, float(name[4:-1])), wt))
    chosen = known if names is None else {n: known[n] for n in names if n in known}
    return df.groupBy(*by).agg(*[no_nan(c).alias(n) for n, c in chosen.items()])


def mid_ranks(pairs: DataFrame, by: list[str], value: str, out: str,
              rows_per_bucket: float | None = None) -> DataFrame:
    """Weighted mid-rank of each distinct value: ``(*by, value, out, _n, _total)``.

    ``pairs`` carries row counts ``n`` and weights ``w``.
    """
    per_value = derived(pairs.groupBy(*by, value).agg(
        F.sum("n").alias("_n"), F.sum("w").alias("_gw"), F.count(F.lit(1)).alias("_pairs")),
        rows_per_bucket)
    ranked = ordered_prefix(per_value, by, value, sums={"_cum": "_gw"},
                            totals={"_total": "_pairs"}, rank=None,
                            rows_per_bucket=rows_per_bucket)
    rank = F.col("_cum") - F.col("_gw") + (F.col("_n") + 1) / 2 * (F.col("_gw") / F.col("_n"))
    return ranked.select(*by, value, rank.alias(out), "_pairs", "_total")


def ranked_values(df: DataFrame, by: list[str], y: str = "y", x: str = "pred", w: str = "w",
                  rows_per_bucket: float | None = None, keep: bool = False) -> DataFrame:
    """Each distinct prediction once, ordered once: pieces of CC and LC, mid-rank ``rx``, and sums
    over its rows that have a target (``_hits``): weight ``_s``, ``_sy`` and ``_syy`` of the
    target's mid-rank.

    Rows are merged to distinct (y, pred) pairs first.  Zero targets pair with nearly every
    prediction, so their ranks are attached through a hot-key join.  With ``keep`` the running sums
    are a stage table (unless they fit one bucket), and the tables behind them are deleted.
    """
    rows_per_bucket = bucket_size(df, rows_per_bucket)
    with passing(df.sparkSession) if keep else nullcontext():
        values = _value_sums(df, by, y, x, w, rows_per_bucket, keep)
        ranked = ordered_prefix(values, by, "_v", sums={"_cw": "_w", "_cg": "_wy", "_cl": "_wx"},
                                totals={"_tw": "_w", "_tg": "_wy", "_tl": "_wx"}, rank=None,
                                rows_per_bucket=rows_per_bucket,
                                late={"_wx": F.col("_w") * F.col("_v")})
        if keep:
            with outer():
                ranked = derived(ranked.drop("_wx"), rows_per_bucket).withColumn(
                    "_wx", F.col("_w") * F.col("_v"))
    rank = F.col("_cw") - F.col("_w") + (F.col("_n") + 1) / 2 * (F.col("_w") / F.col("_n"))
    return ranked.select(*by, "_v", "_hits", "_s", "_sy", "_syy", rank.alias("rx"),
                         *pair_columns())


def _value_sums(df: DataFrame, by: list[str], y: str, x: str, w: str, rows_per_bucket: float,
                keep: bool) -> DataFrame:
    """The sums of :func:`ranked_values` over the rows of each distinct prediction."""
    with passing(df.sparkSession) if keep else nullcontext():
        pairs = derived(
            df.groupBy(*by, plain_zero(F.col(y)).alias("_y"), plain_zero(F.col(x)).alias("_x"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(w).cast("double")).alias("w")),
            rows_per_bucket)
        ry = derived(mid_ranks(pairs, by, "_y", "ry", rows_per_bucket).withColumn(
            "_met", F.lit(True)), rows_per_bucket)
        both = rank_lookup(pairs, ry, [*by, "_y"], "_pairs", "_total", how="left")
        met, wr = F.col("_met"), F.col("w") * F.col("ry")
        values = both.groupBy(*by, F.col("_x").alias("_v")).agg(
            F.sum("n").alias("_n"), F.sum("w").alias("_w"),
            F.sum(F.col("w") * F.col("_y")).alias("_wy"),
            F.count("_met").alias("_hits"), F.sum(F.when(met, F.col("w"))).alias("_s"),
            F.sum(wr).alias("_sy"), F.sum(wr * F.col("ry")).alias("_syy"))
        with outer() if keep else nullcontext():
            return derived(values, rows_per_bucket)


def weighted_spearman(df: DataFrame, by: list[str], y: str = "y", x: str = "pred", w: str = "w",
                      rows_per_bucket: float | None = None,
                      values: DataFrame | None = None) -> DataFrame:
    """Weighted Pearson correlation of weighted mid-ranks, from :func:`ranked_values`."""
    if values is None:
        values = ranked_values(df, by, y, x, w, rows_per_bucket)
    rx = F.col("rx")
    sums = values.where((F.col("_hits") > 0) & F.col("_v").isNotNull()).groupBy(*by).agg(
        F.sum("_s").alias("s"), F.sum(F.col("_s") * rx).alias("sx"), F.sum("_sy").alias("sy"),
        F.sum(F.col("_s") * rx * rx).alias("sxx"), F.sum("_syy").alias("syy"),
        F.sum(F.col("_sy") * rx).alias("sxy"))
    vx = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), F.col("s"))
    vy = F.col("syy") - ratio(F.col("sy") * F.col("sy"), F.col("s"))
    cov = F.col("sxy") - ratio(F.col("sx") * F.col("sy"), F.col("s"))
    return sums.select(*by, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("SC"))


def gini_of(segments: DataFrame, by: list[str], name: str) -> DataFrame:
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2)
    return segments.groupBy(*by).agg((1 - 2 * area).alias(name))


def gini_indices(df: DataFrame, by: list[str], y: str = "y", x: str = "pred", w: str = "w",
                 pairs: DataFrame | None = None,
                 rows_per_bucket: float | None = None) -> DataFrame:
    """Lorenz Gini, concentration Gini, and the latter relative to a perfect order."""
    pairs = pairs if pairs is not None else pair_segments(df, by, y, x, w, rows_per_bucket)
    dx = F.col("x1") - F.col("x0")
    own = pairs.groupBy(*by).agg(
        (1 - F.sum(dx * (F.col("lc0") + F.col("lc1")))).alias("LCGI"),
        (1 - F.sum(dx * (F.col("cc0") + F.col("cc1")))).alias("CCGI"))
    best = gini_of(concentration_segments(df, by, y, y, w, rows_per_bucket=rows_per_bucket),
                   by, "_best")
    relative = F.when(F.abs("_best") <= GINI_ZERO, F.lit(0.0)).otherwise(
        ratio(F.col("CCGI"), F.col("_best")))
    return own.join(best, by).select(*by, "LCGI", "CCGI", relative.alias("NCCGI"))


def abc_sdcl(pairs: DataFrame, by: list[str], m: int = CURVE_GRID) -> DataFrame:
    """Area and supremum of |CC - LC| on the even grid of m+1 points."""
    grid = on_grid(pairs, by, m, {"cc": ("cc0", "cc1"), "lc": ("lc0", "lc1")})
    gap = F.abs(F.col("cc") - F.col("lc"))
    weight = F.when(F.col("i").isin(0, m), F.lit(0.5)).otherwise(F.lit(1.0))
    return grid.groupBy(*by).agg((F.sum(gap * weight) / m).alias("ABC"), F.max(gap).alias("SDCL"))


def calibration_indices(ranked: DataFrame, by: list[str]) -> DataFrame:
    """CCI, COI and CUI: trapezoids at the rows of the cumulative calibration curve."""
    d1 = ratio(F.col("cum_wx"), F.col("tot_wx"))
    c1 = ratio(F.col("cum_wy"), F.col("tot_wy"))
    d0 = ratio(F.col("cum_wx") - F.col("wx"), F.col("tot_wx"))
    c0 = ratio(F.col("cum_wy") - F.col("wy"), F.col("tot_wy"))
    dd = ratio(F.col("wx"), F.col("tot_wx"))
    over = dd * ((d0 - F.least(c0, d0)) + (d1 - F.least(c1, d1))) / 2
    under = dd * ((F.greatest(c0, d0) - d0) + (F.greatest(c1, d1) - d1)) / 2
    return ranked.groupBy(*by).agg(
        F.sum(over + under).alias("CCI"), F.sum(over).alias("COI"), F.sum(under).alias("CUI"))


def bin_metrics(bias: DataFrame, by: list[str], bins: list[int] = GROUP_BINS) -> DataFrame:
    """Largest absolute bias, over- and underpricing over the groups of each bin count."""
    parts = []
    for b in bins:
        here = F.col("n_bins") == b
        parts += [F.max(F.when(here, F.col("abs_bias_deviation"))).alias(f"MAB_{b}B"),
                  F.max(F.when(here, F.col("mean_overpricing"))).alias(f"MOP_{b}B"),
                  F.max(F.when(here, F.col("mean_underpricing"))).alias(f"MUP_{b}B")]
    return bias.groupBy(*by).agg(*parts)


def evaluate(df: DataFrame, by: list[str], names: list[str], weighting: Weighting = Weighting.ONE,
             key: str = "IDpol", y: str = "y", x: str = "pred", w: str = "w",
             keys: DataFrame | None = None,
             ranked: DataFrame | Callable[[], DataFrame] | None = None,
             rows_per_bucket: float | None = None) -> DataFrame:
    """Named metrics as a long table ``(*by, metric, value)``; undefined ones are null.

    A key restriction is applied first, to every metric alike.  ``df`` (and
    ``ranked``) are read several times, so pass stage tables.  ``ranked`` may be a function that
    makes the frame, called once the tables of the other curves are gone.
    """
    if keys is not None:
        df = df.join(keys, keys.columns, "left_semi")
        ranked = None
    wanted = set(names)
    rows_per_bucket = bucket_size(df, rows_per_bucket)
    frames = []
    point = [n for n in names if n in ("MAE", "RMSE", "R2", "MBD", "MPD", "MGD", "MAE_plain")
             or n.startswith("MTD(")]
    if point:
        frames.append(pointwise_metrics(df, by, point, y, x, w))
    curves = wanted & {"ABC", "SDCL", "LCGI", "CCGI", "NCCGI"}
    with passing(df.sparkSession):
        ours = []
        if "SC" in wanted:
            pairs = ranked_values(df, by, y, x, w, rows_per_bucket, keep=bool(curves))
            ours.append(weighted_spearman(df, by, y, x, w, values=pairs))
        elif curves:
            pairs = derived(pair_segments(df, by, y, x, w, rows_per_bucket), rows_per_bucket)
        if wanted & {"ABC", "SDCL"}:
            ours.append(abc_sdcl(pairs, by))
        if wanted & {"LCGI", "CCGI", "NCCGI"}:
            ours.append(gini_indices(df, by, y, x, w, pairs, rows_per_bucket))
        if ours and rows_per_bucket != math.inf:
            with outer():
                ours = [stage(reduce(lambda a, b: a.join(b, by, "full"), ours), "curve_metrics")]
        frames += ours
    bins = sorted({int(n.split("_")[1][:-1]) for n in names if n[:4] in ("MAB_", "MOP_", "MUP_")})
    if bins or wanted & {"CCI", "COI", "CUI"}:
        if callable(ranked):
            ranked = ranked()
        if ranked is None:
            ranked = derived(ordered_rows(df, by, key, y, x, w, rows_per_bucket).select(
                *by, y, x, w, "wy", "wx", "cum_wy", "cum_wx", "tot_wy", "tot_wx", "rank", "n"),
                rows_per_bucket)
        if wanted & {"CCI", "COI", "CUI"}:
            frames.append(calibration_indices(ranked, by))
        if bins:
            frames.append(bin_metrics(bin_bias(ranked, by, bins, y, x, w), by, bins))
    wide = reduce(lambda a, b: a.join(b, by, "full"), frames)
    entries = F.array(*[F.struct(F.lit(display_name(n, weighting)).alias("metric"),
                                 no_nan(F.col(f"`{n}`").cast("double")).alias("value"))
                        for n in names])
    return wide.select(*by, F.explode(entries).alias("m")).select(*by, "m.metric", "m.value")


def cv_summary(by_part: DataFrame, labels: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over parts."""
    return by_part.groupBy(*labels, "metric").agg(
        F.avg("value").alias("cv_mean"), F.stddev_samp("value").alias("cv_std"))


def metrics_wide(by_part: DataFrame, labels: list[str], parts: list[str]) -> DataFrame:
    """One column per part."""
    return by_part.groupBy(*labels, "metric").pivot("part", parts).agg(F.first("value"))
