import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelark.config import Features
from ratelark.functions.columns import escape_name, kernel_weight, round_significant
from ratelark.operators import features as ft
from ratelark.operators.feature_model import FeatureModel


def column(spark, counts):
    rows = [(f"cat_{i}",) for i, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "c string")


BOTH = dict(max_categories=3, min_frequency=2, join_exceeding="other")
RARE = dict(min_frequency=2, join_infrequent="infrequent")


@pytest.mark.parametrize("counts, settings, want", [
    ([(i, 2) for i in range(1, 6)], BOTH, {"cat_1": 2, "cat_2": 2, "cat_3": 2, "other": 4}),
    ([(1, 2)] + [(i, 1) for i in range(2, 10)], BOTH, {"cat_1": 2, "other": 8}),
    ([(1, 3), (2, 2)] + [(i, 1) for i in range(3, 8)], RARE,
     {"cat_1": 3, "cat_2": 2, "infrequent": 5}),
    ([(i, 1) for i in range(1, 11)], RARE, {"infrequent": 10}),
    ([(i, 2) for i in range(1, 6)], RARE, {f"cat_{i}": 2 for i in range(1, 6)}),
    ([(i, 1) for i in range(1, 11)], dict(max_categories=5, min_frequency=2, join_exceeding="other",
                                          join_infrequent="infrequent"), {"other": 10}),
])
def test_category_reducer(spark, counts, settings, want):
    df = column(spark, counts)
    out = ft.apply_category_map(df, ft.fit_category_map(df, [], ["c"], **settings), [], ["c"])
    assert {r.c: r["count"] for r in out.groupBy("c").count().collect()} == want


def test_unseen_and_dropped_categories_become_null(spark):
    mapping = ft.fit_category_map(column(spark, [(1, 3), (2, 1)]), [], ["c"], max_categories=1)
    out = ft.apply_category_map(column(spark, [(1, 1), (2, 1), (9, 1)]), mapping, [], ["c"])
    assert sorted(str(r.c) for r in out.collect()) == ["None", "None", "cat_1"]


def test_names_are_escaped(spark):
    text = "C'mon, Ćma \"Dziwna\" chodziła nocą po łące    'ł.ą.c.k.a' !!! O Matko."
    out = spark.createDataFrame([(text,)], "t string").select(escape_name(F.col("t"))).first()[0]
    assert out == "Cmon_Cma_Dziwna_chodzila_noca_po_lace_lacka_O_Matko"


def test_names_in_other_scripts_stay_apart(spark):
    names = ["Москва", "Киев", "Щука", "Αθήνα", "Ψυχή"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    out = [r[0] for r in df.select(escape_name(F.col("t"))).collect()]
    assert out == ["Moskva", "Kiev", "Shchuka", "Athena", "Psukhe"]


def test_bin_edges(spark):
    df = spark.createDataFrame([(17,), (18,), (70,), (71,), (50,), (51,), (200,)], "v long")
    age = [r[0] for r in df.select(ft.driver_age_bins("v")).collect()]
    assert age[:4] == [None, "[18,21)", "[51,71)", "[71,infty)"]
    bm = [r[0] for r in df.select(ft.bonus_malus_bins("v")).collect()]
    assert bm[4:] == [None, "(50,51]", "(100,infty]"]


def test_area_order_rejects_other_letters(spark):
    df = spark.createDataFrame([("A",), ("F",)], "Area string")
    assert [r[0] for r in df.select(ft.area_order()).collect()] == [1, 6]
    with pytest.raises(Exception):
        spark.createDataFrame([("G",)], "Area string").select(ft.area_order()).collect()


def test_one_hot_is_fitted_once(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "p string, q string")
    levels = ft.fit_levels(train, [], ["p", "q"], {"p": "b"}, drop_binary=True).collect()
    new = spark.createDataFrame([("a", "y"), ("zzz", None)], "p string, q string")
    out = ft.one_hot(new, [], levels)
    assert out.columns == ["p_a", "p_c", "q_y"]
    assert [tuple(r) for r in out.collect()] == [(1, 0, 1), (0, 0, 0)]


def test_missing_reference_level_is_an_error(spark):
    train = spark.createDataFrame([("a",), ("b",)], "p string")
    with pytest.raises(Exception, match="never seen"):
        ft.fit_levels(train, [], ["p"], {"p": "110"}).collect()


def test_rare_levels_share_a_column(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)], "p string")
    levels = ft.fit_levels(train, [], ["p"], min_frequency=3).collect()
    out = ft.one_hot(train, [], levels)
    assert out.columns == ["p_a", "p_infrequent_sklearn"]
    assert out.agg(F.sum("p_infrequent_sklearn")).first()[0] == 3


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    rows = ft.scaler_values(df, [], ["a", "b"], "standard").collect()
    out = ft.apply_scaler(df, [], ft._table(rows, [], "column", "shift"),
                          ft._table(rows, [], "column", "factor"))
    assert [tuple(r) for r in out.collect()] == [(0, -1), (0, 1)]


def test_polynomial_names():
    names = [n for n, _ in ft.polynomial_terms(["a", "b"], 2, include_bias=True)]
    assert names == ["1", "a", "b", "a^2", "a b", "b^2"]
    assert [n for n, _ in ft.polynomial_terms(["a", "b"], 2, True)] == ["a", "b", "a b"]


def test_other_types_are_rejected(spark):
    with pytest.raises(TypeError):
        ft.split_types(spark.createDataFrame([(True,)], "a boolean"), [])


def test_significant_digits(spark):
    df = spark.createDataFrame([(123456.0,), (0.0012349,), (0.0,)], "v double")
    assert [r[0] for r in df.select(round_significant(F.col("v"), 3)).collect()] == [
        123000.0, 0.00123, 0.0]


def test_kernel_at_zero_bandwidth(spark):
    one = spark.range(1).select(kernel_weight(F.lit(0.0), F.lit(0.0), "gaussian")).first()[0]
    assert one == 1.0


def test_feature_chain_per_part(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i % 2), i, float(rng.normal()), None if i % 7 == 0 else float(i % 5),
             "xy"[i % 2] if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "part string, IDpol long, a double, b double, c string")
    model = FeatureModel(Features(numeric_imputer="mean", scaler="standard", drop_first=False,
                                  polynomial_degree=2, interaction_only=True,
                                  blacklist=("c_x",))).fit(df)
    out = model.transform(df)
    assert out.count() == 200
    assert set(model.columns) >= {"a", "b", "a b", "c_y"} and "c_x" not in model.columns
    means = out.groupBy("part").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in means)
    assert out.where("b IS NULL OR a IS NULL").count() == 0
    lists = model.feature_lists(spark)
    assert lists.where("kind = 'final'").count() == len(model.columns)


def test_feature_chain_with_components(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i % 2), i, *map(float, rng.normal(size=3))) for i in range(100)]
    df = spark.createDataFrame(rows, "part string, IDpol long, a double, b double, c double")
    model = FeatureModel(Features(pca=2)).fit(df)
    assert model.columns == ["PC0", "PC1"]
    got = model.transform(df).groupBy("part").agg(F.corr("PC0", "PC1").alias("r")).collect()
    assert all(abs(r.r) < 1e-9 for r in got)
