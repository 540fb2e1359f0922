"""Feature engineering: custom features, imputing, scaling, category handling, products.

Fitting returns small parameter tables keyed by part; applying them is a
projection (or a join with the table), so new data is never used to fit.
``by`` holds the part column, or is empty for a single model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import escape_name, interval_label
from ..functions.lookup import resolve
from .ordered import exact_quantiles

INF = math.inf
# Interval edges and caps of the named features.
DRIVER_AGE_EDGES = [18, 21, 26, 31, 41, 51, 71, INF]
VEHICLE_AGE_EDGES = [0, 1, 10, INF]
VEHICLE_POWER_EDGES = [4, 5, 6, 7, 8, 9, INF]
BONUS_MALUS_EDGES = [50, 51, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100, INF]
BONUS_MALUS_CAP = 150
AREA_ORDER = "ABCDEF"

Feature = Callable[[], Column]
CUSTOM_FEATURES: dict[str, tuple[str, Feature]] = {}


def custom_feature(name: str, column: str):
    """Register a feature under ``name``; it replaces ``column`` when applied."""
    def add(fn: Feature) -> Feature:
        CUSTOM_FEATURES[name] = (column, fn)
        return fn
    return add


@custom_feature("driver_age_bins", "DrivAge")
def driver_age_bins(column: str = "DrivAge") -> Column:
    return interval_label(F.col(column), DRIVER_AGE_EDGES)


@custom_feature("vehicle_age_bins", "VehAge")
def vehicle_age_bins(column: str = "VehAge") -> Column:
    return interval_label(F.col(column), VEHICLE_AGE_EDGES)


@custom_feature("vehicle_power_bins", "VehPower")
def vehicle_power_bins(column: str = "VehPower") -> Column:
    return interval_label(F.col(column), VEHICLE_POWER_EDGES)


@custom_feature("bonus_malus_cap", "BonusMalus")
def bonus_malus_cap(column: str = "BonusMalus") -> Column:
    value = F.col(column)
    return F.when(value.isNotNull(), F.least(value, F.lit(BONUS_MALUS_CAP)))


@custom_feature("bonus_malus_bins", "BonusMalusCat")
def bonus_malus_bins(column: str = "BonusMalus") -> Column:
    return interval_label(F.col(column), BONUS_MALUS_EDGES, right_closed=True)


@custom_feature("log_density", "Density")
def log_density(column: str = "Density") -> Column:
    return F.log(F.col(column).cast("double"))


@custom_feature("area_order", "Area")
def area_order(column: str = "Area") -> Column:
    """1 for A up to 6 for F; any other value is an error."""
    place = F.instr(F.lit(AREA_ORDER), F.col(column))
    known = (F.length(column) == 1) & (place > 0)
    return F.when(known, place.cast("double")).when(
        F.col(column).isNotNull(),
        F.raise_error(F.concat(F.lit("unknown area "), F.col(column))).cast("double"))


def unknown_levels(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()
                                   & ~F.col(column).isin(allowed)).distinct()


def apply_custom(df: DataFrame, names: list[str]) -> DataFrame:
    """New columns replace columns of the same name; all read the original values."""
    chosen = [resolve(n, CUSTOM_FEATURES) for n in names]
    return df.withColumns({column: make() for column, make in chosen})


def split_types(df: DataFrame, skip: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns; anything else is an error."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            categorical.append(f.name)
        else:
            raise TypeError(f"feature {f.name} is neither numeric nor categorical")
    return numeric, categorical


def tall(df: DataFrame, by: list[str], columns: list[str], kind: str = "double") -> DataFrame:
    """``(*by, column, value)`` for all columns from one scan."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value"))
                        for c in columns])
    return df.select(*by, F.explode(entries).alias("e")).select(*by, "e.column", "e.value")


def per_part(values: dict[str | None, object], by: list[str], kind: str = "double") -> Column:
    """The fitted value of the row's part; a literal without parts."""
    if not by:
        return F.lit(values[None]).cast(kind)
    branches = [(F.col(by[0]) == p, F.lit(v).cast(kind)) for p, v in values.items()]
    first, *rest = branches
    return reduce(lambda acc, br: acc.when(*br), rest, F.when(*first))


def _table(rows, by: list[str], name: str, value: str) -> dict[str, dict]:
    """Collected ``(part?, column, value)`` rows as ``{column: {part: value}}``."""
    out: dict[str, dict] = {}
    for r in rows:
        out.setdefault(r[name], {})[r[by[0]] if by else None] = r[value]
    return out


# --- imputers -------------------------------------------------------------------------

def modes(df: DataFrame, by: list[str], columns: list[str], kind: str) -> DataFrame:
    """Most frequent value per column, the smallest among equally frequent ones."""
    counts = (tall(df, by, columns, kind).where(F.col("value").isNotNull())
              .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(*by, "column").agg(F.max("n").alias("n"))
    return counts.join(best, [*by, "column", "n"]).groupBy(*by, "column").agg(
        F.min("value").alias("value"))


def numeric_fill_values(df: DataFrame, by: list[str], columns: list[str], how: str,
                        constant: float = 0.0) -> DataFrame:
    """``(*by, column, value)`` to put in place of nulls."""
    if how == "mean":
        wide = df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])
        return tall(wide, by, columns)
    if how == "median":
        return exact_quantiles(tall(df, by, columns), [*by, "column"], "value", [0.5]).select(
            *by, "column", F.col("quantile").alias("value"))
    if how == "most_frequent":
        return modes(df, by, columns, "double")
    if how == "constant":
        wide = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        return tall(wide.select(*by, *[F.lit(float(constant)).alias(c) for c in columns]),
                    by, columns)
    raise ValueError(f"unknown imputer {how!r}")


def categorical_fill_values(df: DataFrame, by: list[str], columns: list[str], how: str,
                            constant: str = "missing") -> DataFrame:
    if how == "most_frequent":
        return modes(df, by, columns, "string")
    if how == "constant":
        wide = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        return tall(wide.select(*by, *[F.lit(constant).alias(c) for c in columns]), by, columns,
                    "string")
    raise ValueError(f"unknown imputer {how!r}")


def fill_nulls(df: DataFrame, by: list[str], values: dict[str, dict], kind: str) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast(kind), per_part(v, by, kind)) for c, v in values.items()})


# --- scalers --------------------------------------------------------------------------

def scaler_values(df: DataFrame, by: list[str], columns: list[str], kind: str,
                  with_center: bool = True, with_scale: bool = True,
                  quantile_range: tuple[float, float] = (25.0, 75.0),
                  feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``(*by, column, shift, factor)`` so that scaled = (x - shift) * factor.

    A column without spread keeps its scale.
    """
    def one_pass(*aggs) -> DataFrame:
        stats = df.groupBy(*by).agg(*[a(F.col(c)).alias(f"{c}|{i}") for c in columns
                                      for i, a in enumerate(aggs)])
        entries = F.array(*[F.struct(F.lit(c).alias("column"),
                                     *[F.col(f"`{c}|{i}`").cast("double").alias(f"s{i}")
                                       for i in range(len(aggs))]) for c in columns])
        return stats.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")

    def safe(spread: Column) -> Column:
        return F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    zero, one = F.lit(0.0), F.lit(1.0)
    if kind == "standard":
        out = one_pass(F.avg, F.stddev_pop)
        shift, factor = F.col("s0"), one / safe(F.col("s1"))
    elif kind == "minmax":
        low, high = feature_range
        out = one_pass(F.min, F.max)
        factor = (high - low) / safe(F.col("s1") - F.col("s0"))
        return out.select(*by, "column", (F.col("s0") - low / factor).alias("shift"),
                          factor.alias("factor"))
    elif kind == "maxabs":
        out = one_pass(lambda c: F.max(F.abs(c)))
        shift, factor = zero, one / safe(F.col("s0"))
    elif kind == "robust":
        lo, hi = quantile_range[0] / 100, quantile_range[1] / 100
        out = exact_quantiles(tall(df, by, columns), [*by, "column"], "value", [lo, 0.5, hi]) \
            .groupBy(*by, "column").agg(*[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"s{i}")
                for i, p in enumerate([lo, 0.5, hi])])
        shift, factor = F.col("s1"), one / safe(F.col("s2") - F.col("s0"))
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return out.select(*by, "column", (shift if with_center else zero).alias("shift"),
                      (factor if with_scale else one).alias("factor"))


def apply_scaler(df: DataFrame, by: list[str], shift: dict[str, dict],
                 factor: dict[str, dict]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c).cast("double") - per_part(shift[c], by)) * per_part(factor[c], by)
        for c in shift})


# --- category reducer -----------------------------------------------------------------

def fit_category_map(df: DataFrame, by: list[str], columns: list[str],
                     max_categories: int | None = None, min_frequency: int | None = None,
                     join_exceeding: str | None = None,
                     join_infrequent: str | None = None) -> DataFrame:
    """``(*by, column, old, new)`` for every category that survives under some name.

    Categories beyond the ``max_categories`` most frequent (ties by name) join
    one label, or disappear without it; so do infrequent ones, for which the
    exceeding label wins when both apply.
    """
    level = [*by, "column"]
    counts = (tall(df, by, columns, "string").where(F.col("value").isNotNull())
              .groupBy(*level, "value").agg(F.count(F.lit(1)).alias("n")))
    beyond = F.lit(False)
    if max_categories is not None:
        place = Window.partitionBy(*level).orderBy(F.col("n").desc(), "value")
        top = (counts.withColumn("_k", F.row_number().over(place))
               .where(F.col("_k") <= max_categories).select(*level, "value", F.lit(True).alias("_top")))
        counts = counts.join(top, [*level, "value"], "left")
        beyond = F.col("_top").isNull()
    rare = F.lit(False) if min_frequency is None else F.col("n") < min_frequency
    other = None if join_exceeding is None else escape_name(F.lit(join_exceeding))
    if max_categories is not None and join_exceeding is not None:
        small = other
    else:
        small = None if join_infrequent is None else escape_name(F.lit(join_infrequent))
    none = F.lit(None).cast("string")
    new = F.when(beyond, none if other is None else other).when(
        rare, none if small is None else small).otherwise(escape_name(F.col("value")))
    return counts.select(*level, F.col("value").alias("old"), new.alias("new")).where(
        F.col("new").isNotNull())


def apply_category_map(df: DataFrame, mapping: DataFrame, by: list[str],
                       columns: list[str]) -> DataFrame:
    """Mapped categories; unmapped and unseen ones become null."""
    out = df
    for c in columns:
        names = (mapping.where(F.col("column") == c)
                 .select(*by, F.col("old").alias(c), F.col("new").alias(f"_{c}_new")))
        out = out.join(names, [*by, c], "left").withColumn(c, F.col(f"_{c}_new")).drop(f"_{c}_new")
    return out.select(*df.columns)


# --- one-hot --------------------------------------------------------------------------

def fit_levels(df: DataFrame, by: list[str], columns: list[str],
               reference: dict[str, str] | None = None, drop_first: bool = False,
               drop_binary: bool = False, max_categories: int | None = None,
               min_frequency: int | float | None = None) -> DataFrame:
    """``(*by, column, level, kept, rare)``: levels that become columns, and grouped rare ones.

    One level per column may be left out: its reference level, else its first
    level, else the first of two.  A reference level that was never seen is an
    error.  The output has one row per level, and encoding makes one column of
    each, so the table is small.
    """
    reference = reference or {}
    level = [*by, "column"]
    counts = (tall(df, by, columns, "string").where(F.col("value").isNotNull())
              .groupBy(*level, "value").agg(F.count(F.lit(1)).alias("n")))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in reference.items() for x in kv]),
                          F.col("column")) if reference else F.lit(None).cast("string")
    # one row per part and column
    facts = counts.groupBy(*level).agg(
        F.count(F.lit(1)).alias("_levels"), F.sum("n").alias("_rows"),
        F.min("value").alias("_first"),
        F.max((F.col("value") == wanted).cast("int")).alias("_seen"))
    counts = counts.join(F.broadcast(facts), level)
    checked = F.when(wanted.isNotNull() & (F.col("_seen") == 0), F.raise_error(
        F.concat(F.lit("reference level never seen in "), F.col("column"))).cast("boolean"))
    first = F.col("value") == F.col("_first")
    dropped = F.when(wanted.isNotNull(), F.col("value") == wanted)
    if drop_first:
        dropped = dropped.otherwise(first)
    elif drop_binary:
        dropped = dropped.otherwise((F.col("_levels") == 2) & first)
    counts = counts.withColumn("_drop", F.coalesce(checked, dropped, F.lit(False)))
    rare = F.lit(False)
    if min_frequency is not None:
        limit = F.col("_rows") * min_frequency if isinstance(min_frequency, float) else \
            F.lit(min_frequency)
        rare = F.col("n") < limit
    counts = counts.withColumn("_rare", rare & ~F.col("_drop"))
    if max_categories is not None:
        live = counts.groupBy(*level).agg(
            F.count_if("_rare").alias("_n_rare"), F.count_if(~F.col("_drop")).alias("_n_live"))
        place = Window.partitionBy(*level).orderBy(F.col("n").desc(), F.col("value").desc())
        top = (counts.where(~F.col("_drop")).withColumn("_k", F.row_number().over(place))
               .where(F.col("_k") <= max_categories - 1)
               .select(*level, "value", F.lit(True).alias("_top")))
        counts = counts.join(F.broadcast(live), level).join(top, [*level, "value"], "left")
        shown = F.col("_n_live") - F.col("_n_rare") + (F.col("_n_rare") > 0).cast("int")
        late = (shown > max_categories) & F.col("_top").isNull()
        counts = counts.withColumn("_rare", ~F.col("_drop") & (F.col("_rare") | late))
    return counts.select(*level, F.col("value").alias("level"),
                         (~F.col("_drop") & ~F.col("_rare")).alias("kept"),
                         F.col("_rare").alias("rare"))


def one_hot(df: DataFrame, by: list[str], levels: list, keep: bool = False) -> DataFrame:
    """Columns ``{column}_{level}`` of 0/1; unknown values are all zero.

    ``levels`` are the collected rows of :func:`fit_levels`.
    """
    parts_of: dict[tuple[str, str], set] = {}
    rare_of: dict[str, dict] = {}
    for r in levels:
        part = r[by[0]] if by else None
        if r["kept"]:
            parts_of.setdefault((r["column"], r["level"]), set()).add(part)
        elif r["rare"]:
            rare_of.setdefault(r["column"], {}).setdefault(part, []).append(r["level"])
    every = {r[by[0]] if by else None for r in levels}

    def here(parts: set) -> Column:
        return F.lit(True) if not by or parts == every else F.col(by[0]).isin(sorted(parts))

    made = {}
    for (c, value), parts in sorted(parts_of.items()):
        name = f"{c}_{value}"
        if not name.endswith(("_None", "_nan")):
            made[name] = F.coalesce((F.col(c) == value) & here(parts), F.lit(False)).cast("double")
    for c, groups in sorted(rare_of.items()):
        hit = reduce(lambda a, b: a | b,
                     [F.col(c).isin(vals) & here({p}) for p, vals in groups.items()])
        made[f"{c}_infrequent_sklearn"] = F.coalesce(hit, F.lit(False)).cast("double")
    encoded = sorted({r["column"] for r in levels})
    rest = [c for c in df.columns if keep or c not in encoded]
    return df.select(*rest, *[v.alias(n) for n, v in made.items()])


# --- products and columns -------------------------------------------------------------

def drop_listed(df: DataFrame, blacklist: list[str]) -> DataFrame:
    return df.drop(*blacklist)


def polynomial_terms(columns: list[str], degree: int, interaction_only: bool = False,
                     include_bias: bool = False) -> list[tuple[str, list[str]]]:
    """Name and factors of every product up to ``degree``: ``a``, ``a b``, ``a^2``."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [("1", [])] if include_bias else []
    for d in range(1, degree + 1):
        for factors in pick(columns, d):
            parts = []
            for c in dict.fromkeys(factors):
                power = factors.count(c)
                parts.append(c if power == 1 else f"{c}^{power}")
            terms.append((" ".join(parts), list(factors)))
    return terms


def polynomial(df: DataFrame, columns: list[str], degree: int, interaction_only: bool = False,
               include_bias: bool = False) -> DataFrame:
    terms = polynomial_terms(columns, degree, interaction_only, include_bias)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[
        reduce(lambda a, b: a * b, [F.col(f"`{c}`").cast("double") for c in factors],
               F.lit(1.0)).alias(name) for name, factors in terms])
