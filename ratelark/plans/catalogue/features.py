"""Feature engineering and target transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .. import oracle as o
from ...functions.columns import escape_name, round_significant, rounded
from ...operators import features as ft
from ...operators.pca import PrincipalComponents
from ...operators.targets import LogTarget, PowerTarget
from ...session import stage
from ...sources.portfolio_views import prepared_view, read_table

BY = ["part"]


def rows(spark, sf):
    return prepared_view(spark, sf)


def case_bins(column, edges, right=False):
    out = "CASE"
    for a, b in zip(edges[:-1], edges[1:]):
        top = "infty" if b == ft.INF else f"{b:g}"
        if right:
            test = f"{column} > {a}" + ("" if b == ft.INF else f" AND {column} <= {b}")
            out += f" WHEN {test} THEN '({a:g},{top}]'"
        else:
            test = f"{column} >= {a}" + ("" if b == ft.INF else f" AND {column} < {b}")
            out += f" WHEN {test} THEN '[{a:g},{top})'"
    return out + " END"


def bin_query(name, column, edges, expr, right=False):
    @query(name, f"WITH {o.PREPARED} SELECT IDpol, {case_bins(column, edges, right)} AS bin FROM prep")
    def run(spark, sf):
        return rows(spark, sf).select("IDpol", expr().alias("bin"))
    return run


bin_query("bin_drivage", "DrivAge", ft.DRIVER_AGE_EDGES, ft.driver_age_bins)
bin_query("bin_vehage", "VehAge", ft.VEHICLE_AGE_EDGES, ft.vehicle_age_bins)
bin_query("bin_vehpower", "VehPower", ft.VEHICLE_POWER_EDGES, ft.vehicle_power_bins)
bin_query("bin_bonusmalus", "BonusMalus", ft.BONUS_MALUS_EDGES, ft.bonus_malus_bins, True)


@query("custom_features", f"""WITH {o.PREPARED}
SELECT IDpol, {case_bins('DrivAge', ft.DRIVER_AGE_EDGES)} AS DrivAge,
       least(BonusMalus, 150) AS BonusMalus,
       {case_bins('BonusMalus', ft.BONUS_MALUS_EDGES, True)} AS BonusMalusCat,
       {o.r('ln(Density)')} AS Density, cust6 + 1 AS Area FROM prep""")
def custom_features(spark, sf):
    out = ft.apply_custom(rows(spark, sf), ["driver_age_bins", "bonus_malus_cap",
                                            "bonus_malus_bins", "log_density", "area_order"])
    return out.select("IDpol", "DrivAge", "BonusMalus", "BonusMalusCat",
                      rounded(F.col("Density")).alias("Density"), "Area")


NUMERIC = ["DrivAge", "VehAge", "VehPower", "BonusMalus", "Density"]
SPARSE = ", ".join(f"CASE WHEN (IDpol + {i}) % 7 <> 0 THEN CAST({c} AS DOUBLE) END AS {c}"
                   for i, c in enumerate(NUMERIC))
SPARSE_CTE = f"""sp AS (SELECT IDpol, part, {SPARSE},
  CASE WHEN IDpol % 5 <> 1 THEN Region END AS Region,
  CASE WHEN IDpol % 3 <> 1 THEN Brand END AS Brand FROM prep),
ta AS (SELECT IDpol, part, unnest([{', '.join(f"'{c}'" for c in NUMERIC)}]) AS "column",
              unnest([{', '.join(NUMERIC)}]) AS value FROM sp)"""


def sparse(spark, sf):
    """Features with planted nulls."""
    base = rows(spark, sf)
    return base.select(
        "IDpol", "part",
        *[F.when((F.col("IDpol") + i) % 7 != 0, F.col(c).cast("double")).alias(c)
          for i, c in enumerate(NUMERIC)],
        F.when(F.col("IDpol") % 5 != 1, F.col("Region")).alias("Region"),
        F.when(F.col("IDpol") % 3 != 1, F.col("Brand")).alias("Brand"))


def fill_values(how, sql):
    @query(f"impute_{how}", f"""WITH {o.PREPARED}, {SPARSE_CTE} {sql}""")
    def run(spark, sf):
        out = ft.numeric_fill_values(stage(sparse(spark, sf), "sparse"), BY, NUMERIC, how)
        return out.select("part", "column", rounded(F.col("value")).alias("value"))
    return run


fill_values("mean", f"""SELECT part, "column", {o.r('avg(value)')} AS value
FROM ta GROUP BY part, "column" """)
fill_values("median", f"""SELECT part, "column", {o.r('quantile_cont(value, 0.5)')} AS value
FROM ta GROUP BY part, "column" """)
fill_values("most_frequent", """, c AS (SELECT part, "column", value, count(*) AS n FROM ta
  WHERE value IS NOT NULL GROUP BY ALL)
SELECT part, "column", round(value, 6) AS value FROM c
QUALIFY row_number() OVER (PARTITION BY part, "column" ORDER BY n DESC, value) = 1""")


def collected(frame, by, value):
    return ft._table(frame.collect(), by, "column", value)


@query("impute_apply", f"""WITH {o.PREPARED}, {SPARSE_CTE},
md AS (SELECT part, {', '.join(f'quantile_cont({c}, 0.5) AS m{c}' for c in NUMERIC)}
       FROM sp GROUP BY part)
SELECT IDpol, {', '.join(f'coalesce({c}, m{c}) AS {c}' for c in NUMERIC)},
       coalesce(Region, 'missing') AS Region, coalesce(Brand, 'missing') AS Brand
FROM sp JOIN md ON sp.part = md.part""")
def impute_apply(spark, sf):
    base = stage(sparse(spark, sf), "sparse")
    num = collected(ft.numeric_fill_values(base, BY, NUMERIC, "median"), BY, "value")
    cat = collected(ft.categorical_fill_values(base, BY, ["Region", "Brand"], "constant"),
                    BY, "value")
    out = ft.fill_nulls(ft.fill_nulls(base, BY, num, "double"), BY, cat, "string")
    return out.drop("part")


@query("impute_modes", f"""WITH {o.PREPARED}, {SPARSE_CTE},
u AS (SELECT part, 'Region' AS "column", Region AS value FROM sp UNION ALL
      SELECT part, 'Brand', Brand FROM sp),
c AS (SELECT part, "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT part, "column", value FROM c
QUALIFY row_number() OVER (PARTITION BY part, "column" ORDER BY n DESC, value) = 1""")
def impute_modes(spark, sf):
    return ft.categorical_fill_values(sparse(spark, sf), BY, ["Region", "Brand"], "most_frequent")


def scale_query(kind, shift, factor, **kw):
    @query(f"scale_{kind}", f"""WITH {o.PREPARED}, {SPARSE_CTE.replace('% 7 <> 0', '% 7 >= 0')},
f AS (SELECT part, "column", {shift} AS shift, {factor} AS factor FROM ta GROUP BY part, "column")
SELECT ta.IDpol, ta.part, {', '.join(
        f'''round(max((value - shift) * factor) FILTER (WHERE ta."column" = '{c}'), 6) + 0.0
        AS {c}''' for c in NUMERIC)}
FROM ta JOIN f ON ta.part = f.part AND ta."column" = f."column" GROUP BY ta.IDpol, ta.part""")
    def run(spark, sf):
        base = stage(rows(spark, sf).select("IDpol", "part", *NUMERIC), "numeric")
        fitted = ft.scaler_values(base, BY, NUMERIC, kind, **kw).collect()
        shifts = ft._table(fitted, BY, "column", "shift")
        factors = ft._table(fitted, BY, "column", "factor")
        out = ft.apply_scaler(base, BY, shifts, factors)
        return out.select("IDpol", "part", *[rounded(F.col(c)).alias(c) for c in NUMERIC])
    return run


scale_query("standard", "avg(value)",
            "1 / (CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END)")
scale_query("minmax", "min(value)",
            "1 / (CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END)")
scale_query("maxabs", "0", "1 / (CASE WHEN max(abs(value)) = 0 THEN 1 ELSE max(abs(value)) END)")
IQR = "(quantile_cont(value, 0.75) - quantile_cont(value, 0.25))"
scale_query("robust", "quantile_cont(value, 0.5)",
            f"1 / (CASE WHEN {IQR} = 0 THEN 1 ELSE {IQR} END)")

REDUCE = dict(max_categories=4, min_frequency=30, join_exceeding="other kinds",
              join_infrequent="rare")
PARTS_SQL = """pt AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand, p_type FROM part),
u AS (SELECT 'p_brand' AS "column", p_brand AS old FROM pt UNION ALL
      SELECT 'p_type', p_type FROM pt),
c AS (SELECT "column", old, count(*) AS n FROM u WHERE old IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, old) AS i FROM c),
mp AS (SELECT "column", old, CASE WHEN i > 4 OR n < 30 THEN 'other_kinds' ELSE
       regexp_replace(regexp_replace(regexp_replace(old, '[- ]', '_', 'g'),
                      '[^a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g') END AS new FROM k)"""


def part_rows(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("id"), "p_brand", "p_type")


@query("category_reduce_fit", f"""WITH {PARTS_SQL} SELECT "column", old, new FROM mp""")
def category_reduce_fit(spark, sf):
    return ft.fit_category_map(part_rows(spark, sf), [], ["p_brand", "p_type"], **REDUCE)


@query("category_reduce", f"""WITH {PARTS_SQL}
SELECT id, a.new AS p_brand, b.new AS p_type FROM pt
LEFT JOIN mp a ON a."column" = 'p_brand' AND a.old = p_brand
LEFT JOIN mp b ON b."column" = 'p_type' AND b.old = p_type""")
def category_reduce(spark, sf):
    base = part_rows(spark, sf)
    mapping = ft.fit_category_map(base, [], ["p_brand", "p_type"], **REDUCE)
    return ft.apply_category_map(base, mapping, [], ["p_brand", "p_type"])


@query("escape_names", """SELECT CAST(p_partkey AS BIGINT) AS id,
  regexp_replace(regexp_replace(regexp_replace(strip_accents(p_name || ' Ćma-é #' || p_type),
  '[- ]', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g') AS name FROM part""")
def escape_names(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("id"),
        escape_name(F.concat("p_name", F.lit(" Ćma-é #"), "p_type")).alias("name"))


AREAS = ["A", "B", "C", "D", "E", "F"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("one_hot", f"""WITH {o.PREPARED} SELECT IDpol,
{', '.join(f"CAST(Area = '{a}' AS DOUBLE) AS Area_{a}" for a in AREAS[1:])},
{', '.join(f'''CAST(Region = '{x}' AS DOUBLE) AS "Region_{x}"''' for x in REGIONS if x != 'ASIA')}
FROM prep""")
def one_hot(spark, sf):
    base = rows(spark, sf).select("IDpol", "part", "Area", "Region")
    levels = ft.fit_levels(base, BY, ["Area", "Region"], {"Region": "ASIA"}, drop_first=True)
    return ft.one_hot(base, BY, levels.collect()).drop("part")


@query("one_hot_levels", f"""WITH {PARTS_SQL},
z AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, old DESC) AS place,
             count(*) OVER (PARTITION BY "column") AS m FROM c)
SELECT "column", old AS level, NOT (m > 6 AND place > 5) AS kept, (m > 6 AND place > 5) AS rare
FROM z""")
def one_hot_levels(spark, sf):
    return ft.fit_levels(part_rows(spark, sf), [], ["p_brand", "p_type"], max_categories=6)


@query("blacklist_drop", f"WITH {o.PREPARED} SELECT IDpol, Area, VehAge FROM prep")
def blacklist_drop(spark, sf):
    base = rows(spark, sf).select("IDpol", "Area", "VehAge", "Density")
    return ft.drop_listed(base, ["Density", "NoSuchColumn"])


@query("poly_interactions", f"""WITH {o.PREPARED}
SELECT IDpol, CAST(VehAge AS DOUBLE) AS "VehAge", CAST(VehPower AS DOUBLE) AS "VehPower",
  CAST(DrivAge AS DOUBLE) AS "DrivAge", CAST(VehAge * VehPower AS DOUBLE) AS "VehAge VehPower",
  CAST(VehAge * DrivAge AS DOUBLE) AS "VehAge DrivAge",
  CAST(VehPower * DrivAge AS DOUBLE) AS "VehPower DrivAge" FROM prep""")
def poly_interactions(spark, sf):
    base = rows(spark, sf).select("IDpol", "VehAge", "VehPower", "DrivAge")
    return ft.polynomial(base, ["VehAge", "VehPower", "DrivAge"], 2, interaction_only=True)


@query("poly_full", f"""WITH {o.PREPARED}
SELECT IDpol, CAST(1 AS DOUBLE) AS "1", CAST(VehAge AS DOUBLE) AS "VehAge",
  CAST(VehPower AS DOUBLE) AS "VehPower", CAST(VehAge * VehAge AS DOUBLE) AS "VehAge^2",
  CAST(VehAge * VehPower AS DOUBLE) AS "VehAge VehPower",
  CAST(VehPower * VehPower AS DOUBLE) AS "VehPower^2" FROM prep""")
def poly_full(spark, sf):
    base = rows(spark, sf).select("IDpol", "VehAge", "VehPower")
    return ft.polynomial(base, ["VehAge", "VehPower"], 2, include_bias=True)


@query("pca")
def pca(spark, sf):
    base = stage(rows(spark, sf).select("IDpol", *NUMERIC), "numeric")
    return PrincipalComponents.fit(base, NUMERIC, 3).transform(base)


@query("pca_variance")
def pca_variance(spark, sf):
    base = stage(rows(spark, sf).select("IDpol", *NUMERIC), "numeric")
    return PrincipalComponents.fit(base, NUMERIC, 0.99).explained_variance(spark)


def roundtrip(name, transform, sql):
    @query(name, f"""WITH {o.PREPARED} SELECT IDpol, {o.r(sql)} AS z,
           {o.r('ClaimFreq_TRG')} AS y FROM prep""")
    def run(spark, sf):
        z = transform.apply(F.col("ClaimFreq_TRG"))
        out = rows(spark, sf).select("IDpol", z.alias("z")).withColumn(
            "y", rounded(transform.invert(F.col("z"))))
        return out.withColumn("z", rounded(F.col("z")))
    return run


roundtrip("target_log_roundtrip", LogTarget(0.5), "ln(ClaimFreq_TRG + 0.5)")
roundtrip("target_power_roundtrip", PowerTarget(0.5, 3.0),
          "pow(ClaimFreq_TRG + 0.5, CAST(1 AS DOUBLE) / 3)")


@query("round_significant", f"""WITH {o.PREPARED}
SELECT IDpol, CASE WHEN x = 0 THEN 0 ELSE
  round(x * pow(CAST(10 AS DOUBLE), 2 - floor(log10(abs(x)))))
  / pow(CAST(10 AS DOUBLE), 2 - floor(log10(abs(x)))) END AS amount
FROM (SELECT IDpol, ClaimTotalAmount_TRG + CAST(0.00003 AS DOUBLE) AS x FROM prep)""")
def round_significant_query(spark, sf):
    return rows(spark, sf).select(
        "IDpol", round_significant(F.col("ClaimTotalAmount_TRG") + 0.00003, 3).alias("amount"))
