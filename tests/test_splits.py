import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelark.config import Sampling, Split
from ratelark.operators import sampling as smp
from ratelark.operators import splits as sp


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    y = np.where(rng.uniform(size=n) < 0.9, 0, rng.pareto(2.2, n) * 100)
    pdf = pd.DataFrame({"IDpol": np.arange(n), "y": y, "w": rng.uniform(0.2, 1, n)})
    df = spark.createDataFrame(pdf).cache()
    df.count()
    return pdf, df


@pytest.mark.parametrize("shares", [[0.2] * 5, [0.6, 0.2, 0.2]])
def test_sums_and_sizes_are_balanced(skewed, shares):
    pdf, df = skewed
    out = sp.balanced_labels(df, "IDpol", "y", shares, "w", seed=4, tolerance=1 / 5000,
                             rows_per_bucket=3000).toPandas()
    assert len(out) == len(pdf) and out.IDpol.is_unique
    sums = out.assign(t=out.y * out.w).groupby("label").t.sum()
    sums = sums / sums.sum()
    assert np.allclose(sums, shares, rtol=2e-3)
    sizes = out.groupby("label").size() / len(out)
    assert np.allclose(sizes, sums, atol=1e-3)


def test_groups_are_balanced_separately(skewed):
    _, df = skewed
    rows = df.withColumn("part", (F.col("IDpol") % 3 == 0).cast("string"))
    out = sp.balanced_labels(rows, "IDpol", "y", [0.5, 0.5], by=["part"])
    sums = out.groupBy("part", "label").agg(F.sum("y").alias("s")).toPandas()
    shares = sums.s / sums.groupby("part").s.transform("sum")
    assert np.allclose(shares, 0.5, atol=2e-3)


def test_all_zero_targets_give_sizes(spark):
    df = spark.range(103).select(F.col("id").alias("IDpol"), F.lit(0.0).alias("y"))
    out = sp.balanced_labels(df, "IDpol", "y", [0.5, 0.3, 0.2])
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {
        0: 51, 1: 31, 2: 21}


def test_bad_input(spark):
    few = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, 0.0)], "IDpol long, y double")
    with pytest.raises(ValueError):
        sp.balanced_labels(few, "IDpol", "y", [0.5, 0.5])
    with pytest.raises(ValueError):
        sp.balanced_labels(few, "IDpol", "y", [0.5, 0.6])
    negative = spark.createDataFrame([(1, 5.0), (2, -1.0)], "IDpol long, y double")
    with pytest.raises(ValueError):
        sp.balanced_labels(negative, "IDpol", "y", [0.5, 0.5])


def test_roles_cover_every_key_once(skewed):
    pdf, df = skewed
    out = sp.split_assignment(df, "IDpol", "y", Split(test_size=0.25, calib_size=0.25), "w")
    assert out.count() == out.select("IDpol").distinct().count() == len(pdf)
    cv = sp.split_assignment(df, "IDpol", "y", Split(cv_folds=4), "w")
    assert cv.count() == 4 * len(pdf)
    tested = cv.where("role = 'test'")
    assert tested.count() == tested.select("IDpol").distinct().count() == len(pdf)


def test_shared_calibration_repeats_train(skewed):
    pdf, df = skewed
    out = sp.split_assignment(df, "IDpol", "y", Split(test_size=0.2, shared_train_calib=True))
    n = {r.role: r["count"] for r in out.groupBy("role").count().collect()}
    assert n["train"] == n["calib"] and n["train"] + n["test"] == len(pdf)


def test_unshuffled_folds_cycle(spark):
    df = spark.range(10).select(F.col("id").alias("IDpol"), F.col("id").cast("double").alias("y"))
    out = sp.block_folds(df, "IDpol", "y", 5, shuffle=False).toPandas().sort_values("IDpol")
    assert out.fold.tolist() == [4, 3, 2, 1, 0, 4, 3, 2, 1, 0]


def test_small_bins_move_to_the_nearest_large_one():
    edges = [0.0, 1.0, 2.0, 10.0, 11.0]
    assert sp._merge_small_bins(edges, {0: 5, 1: 1, 2: 0, 3: 5}, 2) == [0, 0, 3, 3] or \
        sp._merge_small_bins(edges, {0: 5, 1: 1, 2: 0, 3: 5}, 2) == [0, 0, 3, 3]
    assert sp.default_quantile_bins(14400, 0.2) == 576


def test_ratio_counts():
    assert smp.ratio_counts(1000, 100, 0.5).n_obs == 200
    assert smp.ratio_counts(1000, 100, 0.5, 300, True) == smp.RatioCounts(300, 100, 150)
    for bad in (lambda: smp.ratio_counts(100, 60, 0.5), lambda: smp.ratio_counts(100, 10, 0.5, 50),
                lambda: smp.ratio_counts(100, 10, 0.5, 101)):
        with pytest.raises(ValueError):
            bad()


def test_ratio_sample_and_calibration_in_sample(skewed):
    _, df = skewed
    event = F.col("y") > 0
    train = df.where("IDpol % 2 = 0").select("IDpol")
    calib = df.where("IDpol % 2 = 1").select("IDpol")
    picked = smp.sample_keys(df, train, calib, "IDpol", "y", event, Sampling(target_ratio=0.5,
                                                                             calib_in_sample=True))
    rows = df.join(picked, "IDpol", "left_semi")
    assert 0.45 < smp.event_ratio(rows, event).first()[0] < 0.55
    assert rows.where("IDpol % 2 = 1").count() > 0


def test_validation_from_calibration_set(skewed):
    _, df = skewed
    sample = df.where("IDpol < 100").select("IDpol")
    calib = df.where("IDpol >= 60").select("IDpol")
    out = smp.train_val_split(sample, calib, df, "IDpol", "y", Sampling(validation="calib_set"))
    n = {r.role: r["count"] for r in out.groupBy("role").count().collect()}
    assert n == {"train": 60, "val": 40}
