"""Preparation, weights, outliers and rating by area."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .. import oracle as o
from ...config import Outliers, OutlierPolicy, Target, Weighting
from ...functions.columns import rounded
from ...operators import prep
from ...operators.sampling import event_ratio
from ...sources.portfolio_views import claims_view, policies_view, prepared_view

@query("portfolio_prep", f"""WITH {o.PREPARED}
SELECT IDpol, Area, DrivAge, VehAge, VehPower, BonusMalus, Density, Brand, Region, part,
       Exposure, ClaimCountWeight, ClaimNb_TRG, ClaimFreq_TRG, ClaimTotalAmount_TRG,
       ClaimSeverity_TRG, ClaimPurePremium_TRG FROM prep""")
def portfolio_prep(spark, sf):
    return prepared_view(spark, sf).drop("cust6")


@query("claim_consistency", f"""WITH {o.JOINED}
SELECT IDpol, ClaimNb, claim_count, claim_count >= 1 AS has_claims
FROM joined WHERE claim_count <> ClaimNb""")
def claim_consistency(spark, sf):
    return prep.claim_consistency(
        prep.join_claims(policies_view(spark, sf), claims_view(spark, sf)))


@query("claim_consistency_summary", f"""WITH {o.JOINED}
SELECT count(*) FILTER (WHERE claim_count <> ClaimNb) AS n_inconsistent,
       count(*) FILTER (WHERE claim_count <> ClaimNb AND claim_count >= 1)
         AS n_inconsistent_with_claims,
       count(*) AS n_policies FROM joined""")
def claim_consistency_summary(spark, sf):
    return prep.consistency_summary(
        prep.join_claims(policies_view(spark, sf), claims_view(spark, sf)))


@query("features_projection", f"""WITH {o.PREPARED}
SELECT IDpol, Area, DrivAge, VehAge, VehPower, BonusMalus, Density, Brand, Region, part
FROM prep""")
def features_projection(spark, sf):
    return prep.split_features_and_targets(prepared_view(spark, sf).drop("cust6"))[0]


@query("targets_projection", f"""WITH {o.PREPARED}
SELECT IDpol, Exposure, ClaimCountWeight, ClaimNb_TRG, ClaimFreq_TRG, ClaimTotalAmount_TRG,
       ClaimSeverity_TRG, ClaimPurePremium_TRG FROM prep""")
def targets_projection(spark, sf):
    return prep.split_features_and_targets(prepared_view(spark, sf))[1]


def rating(rows, level):
    e, n = F.sum("Exposure"), F.sum("ClaimNb_TRG")
    return rows.groupBy(level).agg(
        F.count(F.lit(1)).alias("n_policies"), rounded(e, 4).alias("exposure"),
        n.cast("long").alias("claims"),
        rounded(F.sum(F.col("ClaimFreq_TRG") * F.col("Exposure")) / e).alias("frequency"),
        rounded(F.sum(F.col("ClaimPurePremium_TRG") * F.col("Exposure")) / e, 4)
        .alias("pure_premium"))


RATING_SQL = """SELECT {level}, count(*) AS n_policies, round(sum(Exposure), 4) AS exposure,
       CAST(sum(ClaimNb_TRG) AS BIGINT) AS claims,
       round(sum(ClaimFreq_TRG * Exposure) / sum(Exposure), 6) AS frequency,
       round(sum(ClaimPurePremium_TRG * Exposure) / sum(Exposure), 4) AS pure_premium
FROM prep GROUP BY {level}"""


@query("area_rating", f"WITH {o.PREPARED} {RATING_SQL.format(level='Area')}")
def area_rating(spark, sf):
    return rating(prepared_view(spark, sf), "Area")


@query("region_rating", f"WITH {o.PREPARED} {RATING_SQL.format(level='Region')}")
def region_rating(spark, sf):
    return rating(prepared_view(spark, sf), "Region")


@query("severity_task", f"""WITH {o.PREPARED}
SELECT IDpol, ClaimSeverity_TRG AS y,
       CAST(greatest(ClaimCountWeight, 1) AS DOUBLE) AS w
FROM prep WHERE ClaimSeverity_TRG > 0""")
def severity_task(spark, sf):
    rows = prep.modelling_task(prepared_view(spark, sf), Target.SEVERITY)
    return rows.select("IDpol", F.col("ClaimSeverity_TRG").alias("y"),
                       prep.weight_column(Weighting.CLAIM_COUNT).alias("w"))


@query("event_rate", f"""WITH {o.PREPARED}
SELECT part, round(avg(CASE WHEN ClaimFreq_TRG > 0 THEN CAST(1 AS DOUBLE)
       ELSE CAST(0 AS DOUBLE) END), 4) AS event_ratio FROM prep GROUP BY part""")
def event_rate(spark, sf):
    event = prep.event_condition(Target.FREQUENCY)
    return event_ratio(prepared_view(spark, sf), event, ("part",))


CLIP = Outliers(OutlierPolicy.CLIP, 200.0, 9000.0)
DROP = Outliers(OutlierPolicy.DROP, 200.0, 9000.0)


@query("outlier_clip", f"""WITH {o.PREPARED}
SELECT IDpol, round(least(greatest(ClaimTotalAmount_TRG, 200.0), 9000.0), 4) AS amount
FROM prep""")
def outlier_clip(spark, sf):
    rows = prep.handle_outliers(prepared_view(spark, sf), "ClaimTotalAmount_TRG", CLIP)
    return rows.select("IDpol", F.round("ClaimTotalAmount_TRG", 4).alias("amount"))


@query("outlier_drop", f"""WITH {o.PREPARED}
SELECT IDpol, round(ClaimTotalAmount_TRG, 4) AS amount FROM prep
WHERE NOT (ClaimTotalAmount_TRG < 200.0 OR ClaimTotalAmount_TRG > 9000.0)""")
def outlier_drop(spark, sf):
    rows = prep.handle_outliers(prepared_view(spark, sf), "ClaimTotalAmount_TRG", DROP)
    return rows.select("IDpol", F.round("ClaimTotalAmount_TRG", 4).alias("amount"))


@query("outlier_report", f"""WITH {o.PREPARED}
SELECT IDpol, round(ClaimTotalAmount_TRG, 4) AS amount FROM prep
WHERE ClaimTotalAmount_TRG > 9000.0""")
def outlier_report(spark, sf):
    rule = Outliers(OutlierPolicy.KEEP, None, 9000.0)
    rows = prep.outlier_rows(prepared_view(spark, sf), "ClaimTotalAmount_TRG", rule)
    return rows.select("IDpol", F.round("ClaimTotalAmount_TRG", 4).alias("amount"))


@query("outlier_drop_features", f"""WITH {o.PREPARED}
SELECT IDpol, Area, Region FROM prep
WHERE NOT (ClaimTotalAmount_TRG < 200.0 OR ClaimTotalAmount_TRG > 9000.0)""")
def outlier_drop_features(spark, sf):
    features, targets = prep.split_features_and_targets(prepared_view(spark, sf))
    kept = prep.handle_outliers(targets, "ClaimTotalAmount_TRG", DROP)
    return features.join(kept.select("IDpol"), "IDpol", "left_semi").select(
        "IDpol", "Area", "Region")


@query("sample_weights", f"""WITH {o.PREPARED}
SELECT IDpol, Exposure AS w_exposure,
       CAST(greatest(ClaimCountWeight, 1) AS DOUBLE) AS w_claims,
       CAST(1 AS DOUBLE) AS w_one FROM prep""")
def sample_weights(spark, sf):
    return prepared_view(spark, sf).select(
        "IDpol", prep.weight_column(Weighting.EXPOSURE).alias("w_exposure"),
        prep.weight_column(Weighting.CLAIM_COUNT).alias("w_claims"),
        prep.weight_column(Weighting.ONE).alias("w_one"))
