"""Recalibration of predictions and rebalancing of totals, for all parts at once.

Frames carry ``(part, key, y, pred, w)``.  A fitted calibrator turns a frame
into the same frame with a ``calibrated`` column; a row of a part it was not
fitted on is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (kernel_weight, no_model, ratio, sorted_place, step_bin,
                                 weighted_mean)
from ..functions.lookup import resolve
from ..session import outer, passing, stage
from .glm import GlmSpec, PartModels, fit_parts
from .groups import quantile_edges
from .isotonic import interpolated, isotonic_blocks
from .local_moments import GAUSSIAN, TRICUBE, Kernel, kernel_moments
from .ordered import (assign_bucket, derived, hot_join, nearest_value, ordered_prefix, plain_zero,
                      plan_buckets, tie_hash, value_neighbours)

OUT = "calibrated"
#: Knots of all parts up to which a curve is sent to every task as arrays.
KNOTS_SENT = 1 << 17


# --- tail pooling ---------------------------------------------------------------------

def pool_tails(df: DataFrame, by: list[str], low: float = 0.0, high: float = 0.0,
               force_positive: bool = True, y: str = "y", x: str = "pred", w: str = "w",
               key: str = "IDpol", rows_per_bucket: float | None = None) -> DataFrame:
    """Replace the target of the lowest and highest predictions by their weighted means.

    With ``force_positive`` the low pool reaches at least to the first positive
    target.  Adds ``y_pooled``.
    """
    if not (0 <= low <= 1 and 0 <= high <= 1 and low + high <= 1):
        raise ValueError("tail shares must lie in [0, 1] and sum to at most 1")
    base = df.withColumns({"_x": plain_zero(F.col(x)), "_tie": tie_hash(key)})
    ranked = stage(ordered_prefix(base, by, "_x", "_tie", rank="_rank", count="_n",
                                  rows_per_bucket=rows_per_bucket, key=key), "tails")
    n_low = F.floor(F.col("_n") * low)
    facts = ranked.groupBy(*by).agg(
        F.max(n_low).alias("_n_low"), F.max(F.floor(F.col("_n") * high)).alias("_n_high"),
        F.max(F.when(F.col("_rank") <= n_low, F.col(y))).alias("_top_low"),
        F.min(F.when(F.col(y) > 0, F.col("_rank"))).alias("_first_pos"))
    extend = F.lit(force_positive) & ((F.col("_n_low") == 0) | (F.col("_top_low") <= 0))
    facts = facts.withColumn("_low_end", F.when(
        extend, F.coalesce("_first_pos", "_n_low")).otherwise(F.col("_n_low")))
    rows = ranked.join(F.broadcast(facts), by) if by else ranked.crossJoin(F.broadcast(facts))
    in_low = F.col("_rank") <= F.col("_low_end")
    in_high = F.col("_rank") > F.col("_n") - F.col("_n_high")

    def pooled(inside):
        return ratio(F.sum(F.when(inside, F.col(y) * F.col(w))),
                     F.sum(F.when(inside, F.col(w))))

    means = rows.groupBy(*by).agg(pooled(in_low).alias("_low_mean"),
                                  pooled(in_high).alias("_high_mean"))
    rows = rows.join(F.broadcast(means), by) if by else rows.crossJoin(F.broadcast(means))
    value = F.when(in_high, F.col("_high_mean")).when(in_low, F.col("_low_mean")).otherwise(
        F.col(y))
    return rows.select(*df.columns, value.alias("y_pooled"))


# --- calibrators ----------------------------------------------------------------------

@dataclass(frozen=True)
class PureCalibration:
    """Predictions as they are."""

    def fit(self, df: DataFrame, parts: list[str]) -> "PureCalibration":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(OUT, F.col("pred"))


@dataclass(frozen=True)
class EqualBinsMeans:
    """Weighted mean target of each quantile bin of the prediction."""

    n_bins: int = 10
    table: DataFrame | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "EqualBinsMeans":
        with passing(df.sparkSession):
            edges = quantile_edges(df, ["part"], "pred", self.n_bins).select(
                "part", F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2))
                .otherwise(F.array().cast("array<double>")).alias("inner"))
            binned = df.join(F.broadcast(edges), "part").withColumn(
                "_bin", step_bin(F.col("pred"), F.col("inner")))
            mean = weighted_mean(F.col("y"), F.col("w"))
            means = binned.groupBy("part", "_bin").agg(mean.alias("_mean"))
            lookup = means.groupBy("part").agg(
                F.map_from_entries(F.collect_list(F.struct("_bin", "_mean"))).alias("means"))
            overall = df.groupBy("part").agg(mean.alias("overall"))
            table = edges.join(lookup, "part").join(overall, "part")
            with outer():
                return EqualBinsMeans(self.n_bins, stage(table, "bin_means"))

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.join(F.broadcast(self.table), "part", "left")
        value = F.coalesce(F.try_element_at("means", step_bin(F.col("pred"), F.col("inner"))),
                           F.col("overall"))
        return rows.select(*df.columns, F.when(F.col("inner").isNull(), no_model())
                           .otherwise(value).alias(OUT))


def _by_value(df: DataFrame, y: str) -> DataFrame:
    """Equal predictions merged; the isotonic fit only needs their weighted mean."""
    return df.groupBy("part", plain_zero(F.col("pred")).alias("x")).agg(
        weighted_mean(F.col(y), F.col("w")).alias("y"), F.sum("w").alias("w"))


@dataclass(frozen=True)
class Isotonic:
    """Weighted isotonic regression, linear between blocks and clipped outside the fitted range.

    ``centered`` replaces each flat block by its weighted centre and
    interpolates between centres.  The fitted curve is a table of knots
    ``(part, pred, calibrated)``.
    """

    centered: bool = False
    increasing: bool = True
    low: float = 0.0
    high: float = 0.0
    force_positive: bool = True
    rows_per_bucket: float | None = None
    table: DataFrame | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "Isotonic":
        if self.low or self.high or self.force_positive:
            pooled = pool_tails(df, ["part"], self.low, self.high, self.force_positive,
                                rows_per_bucket=self.rows_per_bucket)
            points = _by_value(pooled, "y_pooled")
        else:
            points = _by_value(df, "y")
        blocks = isotonic_blocks(points.where("w > 0"), ["part"], self.increasing,
                                 self.rows_per_bucket)
        if self.centered:
            knots = blocks.groupBy("part", F.col("value").alias(OUT)).agg(
                (F.sum("wx") / F.sum("w")).alias("pred"))
        else:
            ends = F.array_distinct(F.array("x_lo", "x_hi"))
            knots = blocks.select("part", F.explode(ends).alias("pred"), F.col("value").alias(OUT))
        return replace(self, table=stage(knots.select("part", "pred", OUT), "isotonic"))

    def transform(self, df: DataFrame) -> DataFrame:
        return on_knots(df, self.table, self.rows_per_bucket, KNOTS_SENT)


@dataclass(frozen=True)
class GlmCalibration:
    """A GLM of the target with the prediction as its only feature."""

    spec: GlmSpec = GlmSpec("gamma", "inverse")
    weighted: bool = False
    models: PartModels | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "GlmCalibration":
        fits = fit_parts(df, parts, ["pred"], "y", "w" if self.weighted else None, self.spec)
        return GlmCalibration(self.spec, self.weighted, fits)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.models.predict(df, OUT)


# --- local regressions ----------------------------------------------------------------

def nearest_windows(ranked: DataFrame, centers: DataFrame, k_share: float, sums: list[str],
                    rows_per_bucket: float | None = None) -> DataFrame:
    """For each centre ``c`` its window of the ``k = ceil(k_share*n)`` nearest rows.

    ``ranked`` has ``part, x, next, rank, n`` and the running ``sums``.  In value
    order a window is a run of k rows; the run starting at l+1 is nearer than the
    one at l exactly when c lies above the midpoint of x_l and x_{l+k}.  Midpoints
    rise with l, so the last one below c tells the window.  It carries the ends
    of that window, and a centre takes them from it where both are merged in
    value order; no centre looks its ends up by rank, as many may share one.
    Returns ``centers`` with ``x_lo, x_hi``, the largest distance ``h``, and per
    running sum its value before (``_a``) and through (``_b``) the window.
    """
    k = F.ceil(F.col("n") * k_share).cast("long")
    left = ranked.where(F.col("rank") <= F.col("n") - k).select(
        "part", "rank", F.col("x").alias("_xl"), F.col("next").alias("x_lo"),
        *[F.col(s).alias(f"{s}_a") for s in sums])
    right = ranked.where(F.col("rank") > k).select(
        "part", (F.col("rank") - k).alias("rank"), F.col("x").alias("x_hi"),
        F.col("next").alias("_over"), *[F.col(s).alias(f"{s}_b") for s in sums])
    ends = ["x_lo", "x_hi", *[f"{s}_{e}" for e in ("a", "b") for s in sums]]
    middle = (F.col("_xl") + F.col("x_hi")) / 2
    # of equal midpoints the last one decides, so every value has one
    last = F.col("_over").isNull() | ((F.col("x_lo") + F.col("_over")) / 2 > middle)
    mids = left.join(right, ["part", "rank"]).where(last).select(
        "part", middle.alias("v"), F.col("rank").alias("_l"), *ends)
    own = [c for c in centers.columns if c not in ("part", "c")]
    merged = derived(mids.unionByName(centers.select(
        "part", F.col("c").alias("v"), *own, F.lit(True).alias("_c")), allowMissingColumns=True),
        rows_per_bucket)
    buckets = plan_buckets(merged, "v", ["part", "v", "_c"], rows_per_bucket)
    keyed = assign_bucket(merged, "v", None, buckets, "_bkt", "_sub")
    # a midpoint equal to the centre is not below it: centres come first
    upto = Window.partitionBy("part", "_bkt").orderBy("v", F.col("_c").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)
    window = F.struct(*ends)
    found = keyed.withColumn("_w", F.last(F.when(F.col("_l").isNotNull(), window),
                                          ignorenulls=True).over(upto)).where("_c")
    # the last midpoint of the buckets before, one row per bucket
    earlier = Window.partitionBy("part").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carried = keyed.groupBy("part", "_bkt").agg(F.max("_l").alias("_l")).select(
        "part", "_bkt", F.max("_l").over(earlier).alias("_l"))
    carried = F.broadcast(stage(merged.select("part", "_l", window.alias("_before")).join(
        F.broadcast(carried), ["part", "_l"]).select("part", "_bkt", "_before"), "carried"))
    # where no midpoint is below: the first k rows
    first = ranked.where((F.col("rank") == 1) | (F.col("rank") == k)).groupBy("part").agg(
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
        *[(F.min(F.lit(0.0)) if e == "a" else F.max_by(s, "rank")).alias(f"{s}_{e}")
          for e in ("a", "b") for s in sums])
    first = first.select("part", window.alias("_first"))
    spans = found.join(carried, ["part", "_bkt"], "left").join(F.broadcast(first), "part")
    spans = spans.withColumn("_w", F.coalesce("_w", "_before", "_first")).select(
        "part", F.col("v").alias("c"), *own, "_w.*")
    return spans.withColumn("h", F.greatest(F.col("c") - F.col("x_lo"),
                                            F.col("x_hi") - F.col("c")))


def _ranked_xy(df: DataFrame, sums: list[str], rows_per_bucket: float | None = None) -> DataFrame:
    """Rows in prediction order with running ``sums``: some of cw, cwx, cwy and cwxy, those of w, wx,
    wy and wxy."""
    made = {"wx": F.col("w") * F.col("x"), "wy": F.col("w") * F.col("y"),
            "wxy": F.col("w") * F.col("x") * F.col("y")}
    base = df.select("part", "IDpol", "y", "w", plain_zero(F.col("pred")).alias("x"),
                     tie_hash("IDpol").alias("tie"))
    base = base.withColumns({c: v for c, v in made.items() if f"c{c}" in sums}).drop("y")
    ranked = ordered_prefix(base, ["part"], "x", "tie", sums={s: s[1:] for s in sums}, rank="rank",
                            count="n", rows_per_bucket=rows_per_bucket, key="IDpol",
                            following="next")
    return ranked.select("part", "x", "next", "rank", "n", "w", "wy", *sums)


def _last_of_ties() -> Column:
    return F.col("next").isNull() | (F.col("next") > F.col("x"))


@dataclass(frozen=True)
class LocalMean:
    """Kernel-weighted mean of the ``frac`` nearest rows.

    A GLM with nothing but an intercept estimates its weighted mean, for every
    family and link, so no model is fitted.  Rectangular and triangular kernels
    are differences of running sums, the Gaussian one is summed from moments of
    cells (its series ends below 2.7e-10 of a weight); all are evaluated at every
    distinct prediction.  With ``nodes`` the Gaussian one is only evaluated at so
    many evenly spaced ones, and a prediction takes the nearest.
    """

    frac: float = 0.2
    kernel: str = "gaussian"
    nodes: int | None = None
    rows_per_bucket: float | None = None
    table: DataFrame | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "LocalMean":
        sums = ["cw", "cwy"] + (["cwx", "cwxy"] if self.kernel == "triangular" else [])
        ranked = stage(_ranked_xy(df, sums, self.rows_per_bucket), "local")
        if self.kernel == "gaussian":
            curve = self._by_moments(df, ranked)
        else:
            curve = self._by_sums(ranked, sums)
        return LocalMean(self.frac, self.kernel, self.nodes, self.rows_per_bucket,
                         stage(curve, "local_mean"))

    def _by_sums(self, ranked: DataFrame, sums: list[str]) -> DataFrame:
        # running sums through the last row of each distinct prediction
        at = ranked.where(_last_of_ties()).select(
            "part", F.col("x").alias("c"), *[F.col(s).alias(f"{s}_c") for s in sums])
        rows = nearest_windows(ranked, at, self.frac, sums, self.rows_per_bucket)

        def flat(s):
            return F.col(f"{s}_b") - F.col(f"{s}_a")

        if self.kernel == "rectangular":
            value = ratio(flat("cwy"), flat("cw"))
        else:
            # the centre's own rows count to the left side, at distance zero; when the
            # window ends inside or before them the cut moves to the window's end
            def side(s, end, start):
                return F.col(f"{s}_{end}") - F.col(f"{s}_{start}")

            cut_low = F.col("cw_c") > F.col("cw_b")
            h, c = F.col("h"), F.col("c")

            def tri(s, sx):
                whole = (1 - c / h) * flat(s) + flat(sx) / h
                left = (1 - c / h) * side(s, "c", "a") + side(sx, "c", "a") / h
                right = (1 + c / h) * side(s, "b", "c") - side(sx, "b", "c") / h
                return F.when(cut_low, whole).otherwise(left + right)

            value = F.when(h > 0, ratio(tri("cwy", "cwxy"), tri("cw", "cwx")))
            value = F.coalesce(value, ratio(flat("cwy"), flat("cw")))
        return rows.select("part", F.col("c").alias("pred"), value.alias(OUT))

    def _by_moments(self, df: DataFrame, ranked: DataFrame) -> DataFrame:
        sums = windows_of(df, ranked, self.frac, self.nodes, GAUSSIAN, 0, self.rows_per_bucket)
        return sums.select("part", F.col("c").alias("pred"),
                           ratio(F.col("t0"), F.col("s0")).alias(OUT))

    def transform(self, df: DataFrame) -> DataFrame:
        def nearest(queries: DataFrame) -> DataFrame:
            return nearest_value(queries, self.table, ["part"], "pred", OUT, self.rows_per_bucket)

        return _looked_up(df, self.table, nearest)


def _looked_up(df: DataFrame, table: DataFrame, between: Callable[[DataFrame], DataFrame]
               ) -> DataFrame:
    """``df`` with the value of the table's entry at each prediction; only predictions without an
    entry go through ``between``, which gives ``(part, pred, calibrated)`` for ``(part, pred)``."""
    rows = df.withColumn("_p", plain_zero(F.col("pred")))
    entries = table.select("part", F.col("pred").alias("_p"), F.col(OUT).alias("_v"),
                           F.lit(True).alias("_hit"))
    met = stage(hot_join(rows, entries, ["part", "_p"], how="left"), "looked_up")
    out = met.where("_hit").withColumn(OUT, F.col("_v"))
    left = met.where(F.col("_hit").isNull())
    if not left.isEmpty():
        found = stage(between(left.select("part", F.col("_p").alias("pred")))
                      .withColumnRenamed("pred", "_p"), "between")
        out = out.unionByName(hot_join(left, found, ["part", "_p"]))
    return out.select(*df.columns, OUT)


def quantile_nodes(df: DataFrame, nodes: int, rows_per_bucket: float | None = None) -> DataFrame:
    """At most ``nodes`` distinct values per part: all of them, or evenly spaced ones."""
    values = derived(df.select("part", plain_zero(F.col("pred")).alias("c")).distinct(),
                     rows_per_bucket)
    ranked = ordered_prefix(values, ["part"], "c", rank="r", count="n",
                            rows_per_bucket=rows_per_bucket)
    gaps = F.greatest(F.col("n") - 1, F.lit(1))
    here = F.floor((F.col("r") - 1) * (nodes - 1) / gaps)
    before = F.floor((F.col("r") - 2) * (nodes - 1) / gaps)
    return ranked.where((F.col("r") == 1) | (here > before)).select("part", "c")


def windows_of(df: DataFrame, ranked: DataFrame, share: float, nodes: int | None, kernel: Kernel,
               highest: int, rows_per_bucket: float | None = None) -> DataFrame:
    """Kernel-weighted moments of the nearest ``share`` of rows, at every distinct prediction or
    at ``nodes`` of them."""
    centers = (ranked.where(_last_of_ties()).select("part", F.col("x").alias("c")) if nodes is None
               else quantile_nodes(df, nodes, rows_per_bucket))
    windows = nearest_windows(ranked, centers, share, ["cw", "cwy"], rows_per_bucket)
    return kernel_moments(ranked, windows, kernel, highest)


@dataclass(frozen=True)
class LocalPolynomial:
    """Tricube-weighted local polynomial (degree 0 to 2), linear between the places of the fit.

    It is fitted at every distinct prediction, from moments of cells; with
    ``nodes`` at so many evenly spaced ones.  The fitted curve is a table of
    knots ``(part, pred, calibrated)``.
    """

    span: float = 0.5
    degree: int = 2
    nodes: int | None = None
    rows_per_bucket: float | None = None
    table: DataFrame | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "LocalPolynomial":
        if self.degree not in (0, 1, 2) or not 0 < self.span <= 1:
            raise ValueError("degree must be 0, 1 or 2 and span in (0, 1]")
        ranked = stage(_ranked_xy(df, ["cw", "cwy"], self.rows_per_bucket), "loess")
        sums = windows_of(df, ranked, self.span, self.nodes, TRICUBE, self.degree,
                          self.rows_per_bucket)
        curve = sums.select("part", F.col("c").alias("pred"), self._solve().alias(OUT))
        return replace(self, table=stage(curve, "loess_knots"))

    def _solve(self):
        """Value at the node: the constant term of the weighted normal equations."""
        s = [F.col(f"s{i}") for i in range(2 * self.degree + 1)]
        t = [F.col(f"t{i}") for i in range(self.degree + 1)]
        flat = ratio(t[0], s[0])
        if self.degree == 0:
            return flat
        det1 = s[0] * s[2] - s[1] * s[1]
        line = F.when(det1 > 1e-12 * s[0] * s[0], (t[0] * s[2] - t[1] * s[1]) / det1)
        if self.degree == 1:
            return F.coalesce(line, flat)
        det2 = (s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3])
                + s[2] * (s[1] * s[3] - s[2] * s[2]))
        top = (t[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (t[1] * s[4] - t[2] * s[3])
               + s[2] * (t[1] * s[3] - t[2] * s[2]))
        bow = F.when(det2 > 1e-12 * s[0] * s[0] * s[0], top / det2)
        return F.coalesce(bow, line, flat)

    def transform(self, df: DataFrame) -> DataFrame:
        return on_knots(df, self.table, self.rows_per_bucket)


def on_knots(df: DataFrame, table: DataFrame, rows_per_bucket: float | None = None,
             sent: int = 0) -> DataFrame:
    """The curve through the knots ``(part, pred, calibrated)`` at each prediction, level beyond
    its ends.  Up to ``sent`` knots are sent to every task, more are merged with the rows."""
    n = table.count()
    x = plain_zero(F.col("pred"))
    if n <= sent:
        knot = F.struct(F.col("pred").alias("at"), F.col(OUT).alias("v"))
        curves = table.groupBy("part").agg(F.sort_array(F.collect_list(knot)).alias("_knots"))
        # a column of its own, so that the places are not taken out of the knots for every row
        curves = curves.withColumn("_places", F.col("_knots.at"))
        rows = df.join(F.broadcast(curves), "part", "left").withColumn(
            "_at", sorted_place(x, F.col("_places"), n))
        value = interpolated(x, F.get("_knots", F.col("_at") - 1), F.get("_knots", F.col("_at")))
        return rows.select(*df.columns, F.when(F.col("_knots").isNull(), no_model())
                           .otherwise(value).alias(OUT))

    def between(queries: DataFrame) -> DataFrame:
        found = value_neighbours(queries, table, ["part"], "pred", OUT, rows_per_bucket)
        value = F.when(F.col("prev").isNull() & F.col("next").isNull(), no_model()).otherwise(
            interpolated(F.col("pred"), F.col("prev"), F.col("next")))
        return found.select("part", "pred", value.alias(OUT))

    return _looked_up(df, table, between)


# --- totals ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Rebalanced:
    """A calibrator followed by a scale or shift that restores each part's weighted total."""

    inner: object
    method: str
    table: DataFrame | None = None

    def fit(self, df: DataFrame, parts: list[str]) -> "Rebalanced":
        fitted = self.inner.fit(df, parts)
        return Rebalanced(fitted, self.method,
                          stage(balance(fitted.transform(df), self.method), "rebalance"))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.transform(df)
        return apply_balance(out, self.table, self.method)


def balance(df: DataFrame, method: str, by: list[str] = ["part"], y: str = "y", x: str = OUT,
            w: str = "w") -> DataFrame:
    """One factor or shift per part that makes the weighted means equal."""
    target = weighted_mean(F.col(y), F.col(w))
    pred = weighted_mean(F.col(x), F.col(w))
    if method not in ("scale", "shift"):
        raise ValueError(f"unknown rebalancing method {method!r}")
    return df.groupBy(*by).agg(
        (ratio(target, pred) if method == "scale" else target - pred).alias("_balance"))


def apply_balance(df: DataFrame, table: DataFrame, method: str, by: list[str] = ["part"],
                  x: str = OUT) -> DataFrame:
    rows = df.join(F.broadcast(table.withColumn("_fitted", F.lit(True))), by, "left")
    value = F.col(x) * F.col("_balance") if method == "scale" else F.col(x) + F.col("_balance")
    return rows.withColumn(x, F.when(F.col("_fitted").isNull(), no_model()).otherwise(value)) \
        .select(*df.columns)


CALIBRATORS = {
    "pure": PureCalibration, "isotonic": Isotonic,
    "centered_isotonic": lambda **kw: Isotonic(centered=True, **kw),
    "equal_bins_means": EqualBinsMeans, "local_mean": LocalMean,
    "local_polynomial": LocalPolynomial,
    "gamma_glm": lambda link="inverse", **kw: GlmCalibration(GlmSpec("gamma", link, **kw), True),
    "poisson_glm": lambda **kw: GlmCalibration(GlmSpec("poisson", "log", **kw)),
    "tweedie_glm": lambda power, **kw: GlmCalibration(GlmSpec("tweedie", "log", power, **kw)),
}


def make_calibrator(name: str, params: dict | None = None, rebalance: str | None = None):
    model = resolve(name, CALIBRATORS)(**(params or {}))
    return Rebalanced(model, rebalance) if rebalance else model


def prediction_columns(df: DataFrame) -> DataFrame:
    """Pure, calibrated and final prediction; the final one is the calibrated one."""
    return df.withColumns({"pure_pred": F.col("pred"), "calibrated_pred": F.col(OUT),
                           "pred": F.col(OUT)}).drop(OUT)
