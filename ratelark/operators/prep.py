"""Portfolio preparation: claims joined to policies, caps, and the five targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (CLAIM_AMOUNT, CLAIM_NB, CLAIM_WEIGHT, EXPOSURE, MAX_CLAIM_NB, POLICY_ID,
                      TARGET_COLUMN, TARGET_SIDE_COLUMNS, Outliers, OutlierPolicy, Target,
                      Weighting)


def claims_per_policy(claims: DataFrame) -> DataFrame:
    """Sum and count of claim amounts per policy (partial aggregation absorbs hot policies)."""
    return claims.groupBy(POLICY_ID).agg(
        F.sum(F.col(CLAIM_AMOUNT).cast("double")).alias("claim_sum"),
        F.count(CLAIM_AMOUNT).alias("claim_count"))


def join_claims(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Every policy with its claim sum and count, zero where it has none."""
    joined = policies.join(claims_per_policy(claims), POLICY_ID, "left")
    return joined.withColumns({
        "claim_sum": F.coalesce("claim_sum", F.lit(0.0)),
        "claim_count": F.coalesce("claim_count", F.lit(0).cast("long"))})


def duplicate_policies(policies: DataFrame) -> DataFrame:
    """Policy ids that occur more than once; must be empty before joining claims."""
    return policies.groupBy(POLICY_ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_policies(policies: DataFrame) -> None:
    bad = duplicate_policies(policies).first()
    if bad is not None:
        raise ValueError(f"policy {bad[POLICY_ID]} occurs {bad['n']} times")


def claim_consistency(joined: DataFrame) -> DataFrame:
    """Policies whose declared claim number differs from the claims table."""
    return (joined.where(F.col("claim_count") != F.col(CLAIM_NB))
            .select(POLICY_ID, CLAIM_NB, "claim_count",
                    (F.col("claim_count") >= 1).alias("has_claims")))


def consistency_summary(joined: DataFrame) -> DataFrame:
    differs = F.col("claim_count") != F.col(CLAIM_NB)
    return joined.agg(
        F.count_if(differs).alias("n_inconsistent"),
        F.count_if(differs & (F.col("claim_count") >= 1)).alias("n_inconsistent_with_claims"),
        F.count(F.lit(1)).alias("n_policies"))


def with_targets(joined: DataFrame) -> DataFrame:
    """Caps, filters, renames and the derived targets.

    The claim number is capped, the claim-count weight is not; frequency uses
    the capped declared number, severity the count from the claims table.
    """
    exposure = F.least(F.col(EXPOSURE).cast("double"), F.lit(1.0))
    number = F.least(F.col(CLAIM_NB).cast("long"), F.lit(MAX_CLAIM_NB).cast("long"))
    amount, count = F.col("claim_sum"), F.col("claim_count")
    kept = joined.where(F.col(EXPOSURE) > 0)
    carried = [c for c in joined.columns
               if c not in (POLICY_ID, CLAIM_NB, EXPOSURE, "claim_sum", "claim_count")]
    return kept.select(
        F.col(POLICY_ID).cast("long").alias(POLICY_ID), *carried,
        exposure.alias(EXPOSURE),
        count.alias(CLAIM_WEIGHT),
        number.alias(TARGET_COLUMN[Target.CLAIMS_NUMBER]),
        (number / exposure).alias(TARGET_COLUMN[Target.FREQUENCY]),
        amount.alias(TARGET_COLUMN[Target.TOTAL_AMOUNT]),
        (amount / F.greatest(count, F.lit(1))).alias(TARGET_COLUMN[Target.SEVERITY]),
        (amount / exposure).alias(TARGET_COLUMN[Target.PURE_PREMIUM]))


def prepare(policies: DataFrame, claims: DataFrame) -> DataFrame:
    return with_targets(join_claims(policies, claims))


def split_features_and_targets(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    features = [c for c in prepared.columns if c not in TARGET_SIDE_COLUMNS]
    return prepared.select(*features), prepared.select(POLICY_ID, *TARGET_SIDE_COLUMNS)


def modelling_task(targets: DataFrame, target: Target) -> DataFrame:
    """Severity is modelled on policies with a positive severity only."""
    if target is Target.SEVERITY:
        return targets.where(F.col(TARGET_COLUMN[target]) > 0)
    return targets


def event_condition(target: Target) -> Column | None:
    """Whether the target counts as an event; undefined for severity."""
    return None if target is Target.SEVERITY else F.col(TARGET_COLUMN[target]) > 0


def weight_column(weighting: Weighting) -> Column:
    if weighting is Weighting.EXPOSURE:
        return F.col(EXPOSURE).cast("double")
    if weighting is Weighting.CLAIM_COUNT:
        return F.greatest(F.col(CLAIM_WEIGHT), F.lit(1)).cast("double")
    return F.lit(1.0)


def _outside(column: str, rule: Outliers) -> Column:
    value = F.col(column)
    out = F.lit(False)
    if rule.lower is not None:
        out = out | (value < rule.lower)
    if rule.upper is not None:
        out = out | (value > rule.upper)
    return out


def outlier_rows(df: DataFrame, column: str, rule: Outliers) -> DataFrame:
    """Rows outside the bounds, for the report, lowest value first."""
    return df.where(_outside(column, rule)).orderBy(column)


def handle_outliers(df: DataFrame, column: str, rule: Outliers,
                    keys: DataFrame | None = None) -> DataFrame:
    """Keep, drop or clip rows outside strict bounds, optionally after a key restriction."""
    if keys is not None:
        df = df.join(keys, keys.columns, "left_semi")
    if rule.policy is OutlierPolicy.DROP:
        return df.where(~_outside(column, rule))
    if rule.policy is OutlierPolicy.CLIP:
        value = F.col(column)
        if rule.lower is not None:
            value = F.when(F.col(column).isNotNull(), F.greatest(value, F.lit(rule.lower)))
        if rule.upper is not None:
            value = F.when(F.col(column).isNotNull(), F.least(value, F.lit(rule.upper)))
        return df.withColumn(column, value)
    return df
