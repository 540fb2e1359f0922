"""Strict-bin group statistics, lift tables and auto-calibration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GROUP_BINS
from ..functions.columns import ratio, weighted_mean
from ..session import stage
from .ordered import bucket_size, derived, exact_quantiles, ordered_prefix, plain_zero, tie_hash

GROUP_QUANTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
AVERAGED = ["n_obs", "mean_pred", "mean_target", "std_pred", "std_target",
            *[f"q_{int(q * 100):02d}" for q in GROUP_QUANTILES],
            "bias_deviation", "mean_overpricing", "mean_underpricing", "abs_bias_deviation"]
SPREAD = ["mean_pred", "mean_target", "bias_deviation", "mean_overpricing",
          "mean_underpricing", "abs_bias_deviation"]
PLACE_DIGITS = 15
RELATIVE = ["bias_deviation", "mean_overpricing", "mean_underpricing", "abs_bias_deviation"]


def strict_bin(rank: Column, n: Column, n_bins: Column | int) -> Column:
    """1-based group of a 1-based rank; ties are split and groups are as even as possible."""
    n_bins = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    return (F.floor((rank - 1) * n_bins / n) + 1).cast("int")


def with_cells(ranked: DataFrame, bins: list[int]) -> DataFrame:
    """Rows with their group under every bin count, as columns ``_g<bins>``.

    The groups of all bin counts together cut a part into at most ``sum(bins)``
    cells, so rows are summed once per cell and only cells are repeated per bin
    count.
    """
    return ranked.withColumns({
        f"_g{b}": strict_bin(F.col("rank"), F.col("n"), b) for b in bins})


def _cell_columns(bins: list[int]) -> list[str]:
    return [f"_g{b}" for b in bins]


def cells_to_groups(cells: DataFrame, bins: list[int]) -> DataFrame:
    """One row per cell and bin count, with ``n_bins`` and ``group``."""
    pairs = F.array(*[F.struct(F.lit(b).alias("n_bins"), F.col(f"_g{b}").alias("group"))
                      for b in bins])
    rest = [c for c in cells.columns if c not in _cell_columns(bins)]
    return cells.select(*rest, F.explode(pairs).alias("_g")).select(*rest, "_g.n_bins", "_g.group")


def _cell_sums(rows: DataFrame, by: list[str], bins: list[int], y: str, x: str, w: str
               ) -> DataFrame:
    wt = F.col(w)
    return rows.groupBy(*by, *_cell_columns(bins)).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(wt).alias("_w"),
        F.sum(F.col(x) * wt).alias("_wx"), F.sum(F.col(y) * wt).alias("_wy"))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, w: str, probs: list[float],
                       key: str = "IDpol", rows_per_bucket: float | None = None) -> DataFrame:
    """Weighted quantiles ``(*by, prob, quantile)``: values interpolated at ``(cum_w - w/2)/sum_w``.

    Rows of equal value only matter through the first and the last of them in
    tie order, so each distinct value is reduced to one row before ordering.
    """
    return run_quantiles(value_runs(df, by, value, w, key), by, probs, rows_per_bucket)


def value_runs(df: DataFrame, by: list[str], value: str, w: str, key: str = "IDpol") -> DataFrame:
    """Rows of equal value: their weight, and weight and place of the first and last one.

    The place is the leading 60 bits of the tie hash, a number that hash
    aggregation can compare in place.
    """
    tie = F.col("tie") if "tie" in df.columns else tie_hash(key)
    place = F.conv(F.substring(tie, 1, PLACE_DIGITS), 16, 10).cast("long")
    tied = df.select(*by, plain_zero(F.col(value)).alias("_v"), F.col(w).alias("_w"),
                     place.alias("_t"))
    return tied.groupBy(*by, "_v").agg(
        F.sum("_w").alias("_w"), F.min_by("_w", "_t").alias("_wf"), F.min("_t").alias("_tf"),
        F.max_by("_w", "_t").alias("_wl"), F.max("_t").alias("_tl"))


def merge_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by, "_v").agg(
        F.sum("_w").alias("_w"), F.min_by("_wf", "_tf").alias("_wf"),
        F.max_by("_wl", "_tl").alias("_wl"))


def run_quantiles(runs: DataFrame, by: list[str], probs: list[float],
                  rows_per_bucket: float | None = None) -> DataFrame:
    """Weighted quantiles from runs of equal values."""
    runs = derived(runs.select(*by, "_v", "_w", "_wf", "_wl"), rows_per_bucket)
    ranked = ordered_prefix(runs, by, "_v", sums={"_cum": "_w"}, totals={"_tot": "_w"},
                            rank=None, rows_per_bucket=rows_per_bucket)
    placed = ranked.select(
        *by, "_v",
        ratio(F.col("_cum") - F.col("_w") + F.col("_wf") / 2, F.col("_tot")).alias("_p0"),
        ratio(F.col("_cum") - F.col("_wl") / 2, F.col("_tot")).alias("_p1"))
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    # the nearest position at or below p, and the nearest at or above p
    below = F.max(F.when(F.col("_p0") <= F.col("p"),
                         F.struct(F.least(F.col("_p1"), F.col("p")).alias("at"),
                                  F.col("_v").alias("v"), F.col("_p1").alias("end"))))
    above = F.min(F.when(F.col("_p1") >= F.col("p"),
                         F.struct(F.greatest(F.col("_p0"), F.col("p")).alias("at"),
                                  F.col("_v").alias("v"), F.col("_p0").alias("start"))))
    found = (placed.withColumn("p", F.explode(wanted))
             .groupBy(*by, F.col("p").alias("prob")).agg(below.alias("b"), above.alias("a")))
    # inside a run of equal values both sides agree
    x0, x1 = F.col("b.end"), F.col("a.start")
    slope = ratio(F.col("prob") - x0, x1 - x0)
    inner = F.when((F.col("b.v") == F.col("a.v")) | (x1 <= x0), F.col("b.v")).otherwise(
        F.col("b.v") + slope * (F.col("a.v") - F.col("b.v")))
    value_at = F.when(F.col("b").isNull(), F.col("a.v")).when(
        F.col("a").isNull(), F.col("b.v")).otherwise(inner)
    return found.select(*by, "prob", value_at.alias("quantile"))


def group_statistics(ranked: DataFrame, by: list[str], bins: list[int] = GROUP_BINS,
                     groups: list[int] | None = None, round_digits: int | None = None,
                     as_int: bool = False, y: str = "y", x: str = "pred", w: str = "w",
                     key: str = "IDpol", rows_per_bucket: float | None = None) -> DataFrame:
    """Statistics of each strict bin, for all bin counts from one ranked frame."""
    rows_per_bucket = bucket_size(ranked, rows_per_bucket, len(bins))
    tie = ["tie"] if "tie" in ranked.columns else []
    rows = with_cells(ranked.select(*by, key, y, x, w, "rank", "n", *tie), bins)
    level, cell = [*by, "n_bins", "group"], [*by, *_cell_columns(bins)]
    sums = _cell_sums(rows, by, bins, y, x, w).withColumns({
        "_mx": ratio(F.col("_wx"), F.col("_w")), "_my": ratio(F.col("_wy"), F.col("_w"))})
    # second pass around the cell means, so that near-constant bins keep their digits
    wt = F.col(w)
    inside = rows.join(F.broadcast(sums.select(*cell, "_mx", "_my")), cell).groupBy(*cell).agg(
        F.sum(wt * F.pow(F.col(x) - F.col("_mx"), 2)).alias("_sx"),
        F.sum(wt * F.pow(F.col(y) - F.col("_my"), 2)).alias("_sy"))
    parts = cells_to_groups(stage(sums.join(inside, cell), "cells"), bins)
    if groups is not None:
        parts = parts.where(F.col("group").isin(groups))
    means = parts.groupBy(*level).agg(
        F.sum("n_obs").alias("n_obs"), F.sum("_w").alias("sum_w"),
        ratio(F.sum("_wx"), F.sum("_w")).alias("mean_pred"),
        ratio(F.sum("_wy"), F.sum("_w")).alias("mean_target"))

    def spread_of(within: str, own: str, mean: str) -> Column:
        between = F.col("_w") * F.pow(F.col(own) - F.col(mean), 2)
        return F.sqrt(ratio(F.sum(F.col(within) + between), F.sum("_w")))

    spread = parts.join(F.broadcast(means.select(*level, "mean_pred", "mean_target")), level) \
        .groupBy(*level).agg(spread_of("_sx", "_mx", "mean_pred").alias("std_pred"),
                             spread_of("_sy", "_my", "mean_target").alias("std_target"))
    runs = cells_to_groups(value_runs(rows, cell, y, w, key), bins)
    if groups is not None:
        runs = runs.where(F.col("group").isin(groups))
    quantiles = run_quantiles(merge_runs(runs, level), level, GROUP_QUANTILES, rows_per_bucket)
    wide = quantiles.groupBy(*level).agg(
        *[F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(f"q_{int(q * 100):02d}")
          for q in GROUP_QUANTILES])
    out = means.join(spread, level).join(wide, level)

    def tidy(c: str) -> Column:
        value = F.col(c)
        if round_digits is not None:
            value = F.bround(value, round_digits)
        return (value.cast("long").cast("double") if as_int else value).alias(c)

    stats = ["mean_pred", "mean_target", "std_pred", "std_target",
             *[f"q_{int(q * 100):02d}" for q in GROUP_QUANTILES]]
    return with_bias(out.select(*level, "n_obs", "sum_w", *[tidy(c) for c in stats]))


def with_bias(stats: DataFrame) -> DataFrame:
    target, pred = F.col("mean_target"), F.col("mean_pred")
    return stats.withColumns({
        "bias_deviation": target - pred,
        "mean_overpricing": F.greatest(target, pred) - target,
        "mean_underpricing": target - F.least(target, pred),
        "abs_bias_deviation": F.abs(target - pred)})


def bin_bias(ranked: DataFrame, by: list[str], bins: list[int] = GROUP_BINS, y: str = "y",
             x: str = "pred", w: str = "w") -> DataFrame:
    """Only the means and bias columns of each strict bin."""
    rows = with_cells(ranked.select(*by, y, x, w, "rank", "n"), bins)
    parts = cells_to_groups(_cell_sums(rows, by, bins, y, x, w), bins)
    return with_bias(parts.groupBy(*by, "n_bins", "group").agg(
        ratio(F.sum("_wx"), F.sum("_w")).alias("mean_pred"),
        ratio(F.sum("_wy"), F.sum("_w")).alias("mean_target")))


def average_statistics(stats: DataFrame, labels: list[str]) -> DataFrame:
    """Mean over parts, sample deviation of six columns, and columns relative to the target."""
    out = stats.groupBy(*labels, "n_bins", "group").agg(
        *[F.avg(c).alias(c) for c in AVERAGED],
        *[F.stddev_samp(c).alias(f"std_of_{c}") for c in SPREAD])
    base = F.when(F.abs("mean_target") > 1e-8, F.col("mean_target"))
    return out.withColumns({f"rel_{c}": F.col(c) / base for c in RELATIVE})


def lift_table(stats: DataFrame, labels: list[str]) -> DataFrame:
    """Per group over parts: means, prediction spread, mean over- and underpricing."""
    gap = F.col("mean_pred") - F.col("mean_target")
    return stats.groupBy(*labels, "n_bins", "group").agg(
        F.avg("mean_pred").alias("mean_pred"), F.avg("mean_target").alias("mean_target"),
        F.stddev_pop("mean_pred").alias("std_pred"),
        F.avg(F.greatest(gap, F.lit(0.0))).alias("overpricing"),
        F.avg(F.greatest(-gap, F.lit(0.0))).alias("underpricing"))


def simple_lift_table(stats: DataFrame, labels: list[str]) -> DataFrame:
    return stats.groupBy(*labels, "n_bins", "group").agg(
        F.avg("mean_pred").alias("mean_pred"), F.stddev_pop("mean_pred").alias("std_pred"),
        F.avg("mean_target").alias("mean_target"),
        F.stddev_pop("mean_target").alias("std_target"))


def quantile_edges(df: DataFrame, by: list[str], value: str, n_bins: int,
                   rows_per_bucket: float | None = None) -> DataFrame:
    """Distinct quantile edges per ``by`` as one sorted array of at most ``n_bins + 1``."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    return (exact_quantiles(df, by, value, probs, rows_per_bucket)
            .groupBy(*by).agg(F.array_sort(F.collect_set("quantile")).alias("edges")))


def right_closed_bin(value: Column, edges: Column) -> Column:
    """0-based bin in ``(e_i, e_{i+1}]``, the lowest edge included."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0))


def auto_calibration(df: DataFrame, by: list[str], n_bins: int, y: str = "y", x: str = "pred",
                     w: str = "w", rows_per_bucket: float | None = None) -> DataFrame:
    """Quantile bins of the prediction: weighted means and prediction range."""
    edges = quantile_edges(df, by, x, n_bins, rows_per_bucket)
    wt = F.col(w)
    rows = df.join(F.broadcast(edges), by).withColumn(
        "bin", right_closed_bin(F.col(x), F.col("edges")))
    return rows.groupBy(*by, "bin").agg(
        weighted_mean(F.col(x), wt).alias("mean_pred"),
        weighted_mean(F.col(y), wt).alias("mean_target"),
        F.min(x).alias("min_pred"), F.max(x).alias("max_pred"))
