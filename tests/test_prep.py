import pytest
from pyspark.sql import functions as F

from ratelark.config import (Calibration, Job, Outliers, OutlierPolicy, Sampling, Split, Target,
                             Tuning, Weighting, task_weighting)
from ratelark.operators import prep


@pytest.fixture(scope="module")
def portfolio(spark):
    policies = spark.createDataFrame(
        [(1, 2, 0.5, "A"), (2, 6, 1.4, "B"), (3, 1, 0.0, "C"), (4, 0, 0.25, "A")],
        "IDpol long, ClaimNb long, Exposure double, Area string")
    claims = spark.createDataFrame([(1, 100.0), (1, 50.0), (99, 7.0), (4, 0.0)],
                                   "IDpol long, ClaimAmount double")
    return policies, claims


def test_hand_case(portfolio):
    rows = {r.IDpol: r for r in prep.prepare(*portfolio).collect()}
    assert set(rows) == {1, 2, 4}
    one, two, four = rows[1], rows[2], rows[4]
    assert (one.ClaimTotalAmount_TRG, one.ClaimCountWeight, one.ClaimFreq_TRG) == (150, 2, 4)
    assert (one.ClaimPurePremium_TRG, one.ClaimSeverity_TRG) == (300, 75)
    assert (two.ClaimNb_TRG, two.Exposure, two.ClaimFreq_TRG, two.ClaimSeverity_TRG) == (4, 1, 4, 0)
    assert (four.ClaimCountWeight, four.ClaimTotalAmount_TRG) == (1, 0)


def test_consistency_keeps_rows(portfolio):
    joined = prep.join_claims(*portfolio)
    assert joined.count() == 4
    assert {r.IDpol for r in prep.claim_consistency(joined).collect()} == {2, 3, 4}
    s = prep.consistency_summary(joined).first()
    assert (s.n_inconsistent, s.n_inconsistent_with_claims, s.n_policies) == (3, 1, 4)


def test_duplicate_policies_are_an_error(portfolio):
    policies, _ = portfolio
    with pytest.raises(ValueError):
        prep.assert_unique_policies(policies.union(policies.limit(1)))
    prep.assert_unique_policies(policies)


def test_outlier_policies(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "IDpol long, y double")
    rule = dict(lower=1.0, upper=4.0)
    values = lambda d: sorted(r.y for r in d.collect())
    assert values(prep.handle_outliers(df, "y", Outliers())) == [0, 1, 2, 3, 4, 5]
    assert values(prep.handle_outliers(df, "y", Outliers(OutlierPolicy.DROP, **rule))) == [1, 2, 3, 4]
    assert values(prep.handle_outliers(df, "y", Outliers(OutlierPolicy.CLIP, **rule))) == [
        1, 1, 2, 3, 4, 4]
    keys = df.where("IDpol < 2").select("IDpol")
    assert values(prep.handle_outliers(df, "y", Outliers(OutlierPolicy.DROP, **rule), keys)) == [1]
    assert [r.y for r in prep.outlier_rows(df, "y", Outliers(**rule)).collect()] == [0, 5]


def test_features_exclude_the_target_side(portfolio):
    features, targets = prep.split_features_and_targets(prep.prepare(*portfolio))
    assert features.columns == ["IDpol", "Area"]
    assert "Exposure" in targets.columns


def test_weights_follow_the_target():
    assert task_weighting(Target.SEVERITY) is Weighting.CLAIM_COUNT
    assert task_weighting(Target.FREQUENCY) is Weighting.EXPOSURE
    assert task_weighting(Target.FREQUENCY, False) is Weighting.ONE
    assert prep.event_condition is not None


def test_severity_has_no_event(spark):
    assert prep.event_condition(Target.SEVERITY) is None


@pytest.mark.parametrize("bad", [
    lambda: Split(cv_folds=1), lambda: Split(test_size=0.7, calib_size=0.4),
    lambda: Split(test_size=1.0), lambda: Outliers(lower=2.0, upper=1.0),
    lambda: Job(split=Split(calib_enabled=False)),
    lambda: Job(split=Split(shared_train_calib=True), sampling=Sampling(calib_in_sample=True)),
    lambda: Job(tuning=Tuning(enabled=True)), lambda: Sampling(validation="x"),
    lambda: Calibration(rebalance="x"), lambda: Tuning(validation="cross_validation", folds=1)])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        bad()
