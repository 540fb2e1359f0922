"""Splits, folds, samples and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .. import oracle as o
from ...config import TARGET_COLUMN, Sampling, Target
from ...functions.columns import rounded
from ...operators import keys as ks
from ...operators import sampling as smp
from ...operators import splits as sp
from ...session import stage
from ...sources.portfolio_views import prepared_view

FREQ, PREMIUM = TARGET_COLUMN[Target.FREQUENCY], TARGET_COLUMN[Target.PURE_PREMIUM]


def targets(spark, sf):
    return stage(prepared_view(spark, sf).select(
        "IDpol", "part", "Exposure", FREQ, PREMIUM, "ClaimTotalAmount_TRG"), "targets")


FOLDS = """bl AS (SELECT IDpol, CAST(floor((row_number() OVER (
      ORDER BY ClaimPurePremium_TRG DESC, sha256('-' || IDpol)) - 1) / 5) AS BIGINT) AS block
    FROM prep),
fo AS (SELECT IDpol, CAST(row_number() OVER (PARTITION BY block ORDER BY sha256('1-' || IDpol)) - 1
              AS INT) AS fold FROM bl)"""


@query("fold_labels_block", f"WITH {o.PREPARED}, {FOLDS} SELECT IDpol, fold FROM fo")
def fold_labels_block(spark, sf):
    return sp.block_folds(targets(spark, sf), "IDpol", PREMIUM, 5)


def cv_sql(role: str) -> str:
    return f"""WITH {o.PREPARED}, {FOLDS}
SELECT CAST(p AS VARCHAR) AS part, IDpol, {role} AS role FROM fo, range(5) pp(p)"""


@query("cv_assignment", cv_sql("CASE WHEN fold = p THEN 'test' WHEN fold = (p + 1) % 5 "
                               "THEN 'calib' ELSE 'train' END"))
def cv_assignment(spark, sf):
    return sp.cv_assignment(sp.block_folds(targets(spark, sf), "IDpol", PREMIUM, 5), "IDpol", 5)


@query("cv_assignment_train_test", cv_sql("CASE WHEN fold = p THEN 'test' ELSE 'train' END"))
def cv_assignment_train_test(spark, sf):
    folds = sp.block_folds(targets(spark, sf), "IDpol", PREMIUM, 5)
    return sp.cv_assignment(folds, "IDpol", 5, None)


@query("cv_assignment_shared_calib", cv_sql(
    "unnest(CASE WHEN fold = p THEN ['test'] ELSE ['train', 'calib'] END)"))
def cv_assignment_shared_calib(spark, sf):
    folds = sp.block_folds(targets(spark, sf), "IDpol", PREMIUM, 5)
    return sp.cv_assignment(folds, "IDpol", 5, "shared")


QS = ", ".join(f"quantile_cont(y, {q}) AS {sp._q_name(q)}" for q in sp.REPORT_QUANTILES)
REPORT_COLS = ["weighted_mean", "min", *[sp._q_name(q) for q in sp.REPORT_QUANTILES]]
TOPS = [f"top_{i}" for i in range(1, sp.TOP_VALUES + 1)]


@query("split_distribution", f"""WITH {o.PREPARED},
v AS (SELECT part, ClaimFreq_TRG AS y, Exposure AS w FROM prep),
b AS (SELECT part, count(*) AS n, avg(y) AS mean, sum(y * w) / sum(w) AS weighted_mean,
             min(y) AS min, {QS} FROM v GROUP BY part),
k AS (SELECT part, y, row_number() OVER (PARTITION BY part ORDER BY y DESC) AS i FROM v),
tp AS (SELECT part, {', '.join(f'max(y) FILTER (WHERE i = {i}) AS top_{i}' for i in range(1, 7))}
       FROM k WHERE i <= 6 GROUP BY part),
al AS (SELECT avg(y) > 1000 AS large FROM v)
SELECT b.part, n, {', '.join(f'{o.r(f"CASE WHEN large THEN round({c}, 0) ELSE {c} END")} AS {c}'
                             for c in ['mean', *REPORT_COLS])},
       {', '.join(f'CASE WHEN large THEN round({c}, 0) ELSE round({c}, 2) END AS {c}' for c in TOPS)}
FROM b JOIN tp ON b.part = tp.part CROSS JOIN al""")
def split_distribution(spark, sf):
    out = sp.split_report(targets(spark, sf), ["part"], FREQ, "Exposure")
    return out.select("part", "n", *[rounded(F.col(c)).alias(c) for c in ["mean", *REPORT_COLS]],
                      *TOPS)


@query("quantile_split", f"""WITH {o.PREPARED},
e AS (SELECT list_sort(list_distinct(quantile_cont(ClaimTotalAmount_TRG,
      [{', '.join(str(i / 20) for i in range(21))}]))) AS edges FROM prep),
b AS (SELECT IDpol, greatest(len(list_filter(edges, lambda q : q < ClaimTotalAmount_TRG)) - 1, 0)
      AS bin FROM prep, e),
k AS (SELECT IDpol, row_number() OVER (PARTITION BY bin ORDER BY sha256('0-' || IDpol)) AS i,
             count(*) OVER (PARTITION BY bin) AS n FROM b)
SELECT IDpol, CASE WHEN i <= round(n * CAST(0.2 AS DOUBLE)) THEN 'test'
       WHEN i <= round(n * CAST(0.2 AS DOUBLE)) + round(n * CAST(0.3 AS DOUBLE)) THEN 'calib'
       ELSE 'train' END AS role FROM k""")
def quantile_split(spark, sf):
    return sp.quantile_split(targets(spark, sf), "IDpol", "ClaimTotalAmount_TRG", 0.2, 20, 0.3)


@query("split_balanced")
def split_balanced(spark, sf):
    out = sp.split_train_calib_test(targets(spark, sf), "IDpol", PREMIUM, 0.2, 0.2, w="Exposure")
    return out


@query("split_balanced_totals", f"""WITH {o.PREPARED}
SELECT role, CAST(round(share * n) AS BIGINT) AS n_rounded_1pct, CAST(share AS DOUBLE) AS sum_share
FROM (SELECT round(count(*) / 100, 0) AS n FROM prep),
     (VALUES ('train', 0.6), ('calib', 0.2), ('test', 0.2)) s(role, share)""")
def split_balanced_totals(spark, sf):
    """Row counts in hundreds and the share of the weighted target, per role."""
    rows = targets(spark, sf)
    parts = sp.split_train_calib_test(rows, "IDpol", PREMIUM, 0.2, 0.2, w="Exposure")
    amount = F.col(PREMIUM) * F.col("Exposure")
    total = rows.agg(F.sum(amount).alias("t"))
    out = rows.join(parts, "IDpol").groupBy("role").agg(
        F.round(F.count(F.lit(1)) / 100, 0).cast("long").alias("n_rounded_1pct"),
        F.sum(amount).alias("s"))
    return out.crossJoin(F.broadcast(total)).select(
        "role", "n_rounded_1pct", F.round(F.col("s") / F.col("t"), 2).alias("sum_share"))


@query("folds_balanced")
def folds_balanced(spark, sf):
    return sp.balanced_folds(targets(spark, sf), "IDpol", PREMIUM, 5, "Exposure")


@query("sample_stratified")
def sample_stratified(spark, sf):
    return sp.stratified_sample(targets(spark, sf), "IDpol", PREMIUM, 0.3, "Exposure")


@query("target_ratio_counts", f"""WITH {o.PREPARED},
f AS (SELECT part, count(*) AS n, count(*) FILTER (WHERE ClaimFreq_TRG > 0) AS e
      FROM prep GROUP BY part)
SELECT part, CAST(e AS BIGINT) AS n_events, CAST(round_even(e / CAST(0.8 AS DOUBLE), 0) AS BIGINT) AS n_obs,
       CAST(round_even(round_even(e / CAST(0.8 AS DOUBLE), 0) * CAST(0.8 AS DOUBLE), 0) AS BIGINT) AS events
FROM f""")
def target_ratio_counts(spark, sf):
    facts = prepared_view(spark, sf).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(FREQ) > 0).alias("e"))
    rows = []
    for part, n, events in facts.collect():
        counts = smp.ratio_counts(n, events, 0.8)
        rows.append((part, events, counts.n_obs, counts.n_events))
    return spark.createDataFrame(rows, "part string, n_events long, n_obs long, events long")


@query("sample_target_ratio")
def sample_target_ratio(spark, sf):
    rows = targets(spark, sf)
    return smp.sample_with_ratio(rows, "IDpol", FREQ, F.col(FREQ) > 0,
                                 Sampling(target_ratio=0.8), "Exposure")


@query("val_set_ops", f"""WITH {o.PREPARED}
SELECT IDpol, CASE WHEN IDpol % 3 = 0 THEN 'val' ELSE 'train' END AS role
FROM prep WHERE IDpol % 2 = 0""")
def val_set_ops(spark, sf):
    rows = targets(spark, sf)
    sample = rows.where("IDpol % 2 = 0").select("IDpol")
    calib = rows.where("IDpol % 3 = 0").select("IDpol")
    return smp.train_val_split(sample, calib, rows, "IDpol", FREQ,
                               Sampling(validation="calib_set"))


@query("key_union", f"""WITH {o.PREPARED}
SELECT DISTINCT IDpol FROM prep WHERE VehAge < 3 OR DrivAge > 70""")
def key_union(spark, sf):
    rows = prepared_view(spark, sf)
    return ks.union_keys(rows.where("VehAge < 3").select("IDpol"),
                         rows.where("DrivAge > 70").select("IDpol"))


@query("key_difference", f"""WITH {o.PREPARED}
SELECT IDpol FROM prep WHERE VehAge < 3 AND NOT DrivAge > 70""")
def key_difference(spark, sf):
    rows = prepared_view(spark, sf)
    return ks.minus_keys(rows.where("VehAge < 3").select("IDpol"),
                         rows.where("DrivAge > 70").select("IDpol"))


@query("key_intersection", f"""WITH {o.PREPARED}
SELECT IDpol FROM prep WHERE VehAge < 3 AND DrivAge > 70""")
def key_intersection(spark, sf):
    rows = prepared_view(spark, sf)
    return ks.common_keys(rows.where("VehAge < 3").select("IDpol"),
                          rows.where("DrivAge > 70").select("IDpol"))


@query("row_lookup", f"""WITH {o.PREPARED}
SELECT IDpol, Area, VehPower FROM prep WHERE BonusMalus > 150""")
def row_lookup(spark, sf):
    rows = prepared_view(spark, sf)
    keys = rows.where("BonusMalus > 150").select("IDpol")
    return ks.rows_of(rows.select("IDpol", "Area", "VehPower"), keys)


@query("column_concat", f"""WITH {o.PREPARED}
SELECT IDpol, Area, ClaimNb_TRG FROM prep""")
def column_concat(spark, sf):
    rows = prepared_view(spark, sf)
    return ks.join_columns(rows.select("IDpol", "Area"), rows.select("IDpol", "ClaimNb_TRG"),
                           ["IDpol"])


@query("part_concat", f"""WITH {o.PREPARED}
SELECT IDpol, part FROM prep""")
def part_concat(spark, sf):
    rows = prepared_view(spark, sf)
    return ks.stack_parts({p: rows.where(F.col("part") == p).select("IDpol") for p in "01234"})


@query("missing_keys", f"""WITH {o.PREPARED}
SELECT IDpol FROM pol WHERE IDpol NOT IN (SELECT IDpol FROM prep)""")
def missing_keys(spark, sf):
    from ...sources.portfolio_views import policies_view
    return ks.missing_keys(policies_view(spark, sf), prepared_view(spark, sf), ["IDpol"])


@query("attach_predictions", f"""WITH {o.PREPARED}
SELECT IDpol, pred_tied AS ClaimFreq_PRED FROM prep""")
def attach_predictions(spark, sf):
    from ...sources.portfolio_views import prediction_columns
    rows = prepared_view(spark, sf)
    return ks.with_prediction(rows, prediction_columns()["pred_tied"], "ClaimFreq_PRED").select(
        "IDpol", "ClaimFreq_PRED")
