"""Bucketed order operators against one-frame numpy results, with heavy ties."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelark.operators.groups import weighted_quantiles
from ratelark.operators.ordered import (Buckets, assign_bucket, exact_quantiles, hot_join,
                                        nearest_value, ordered_prefix, plan_buckets, tie_hash)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({
        "part": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "IDpol": np.arange(n), "w": rng.uniform(0.1, 1, n),
        # a third zeros, many repeats, a few extreme values
        "v": np.where(rng.uniform(size=n) < 0.35, 0.0, np.round(rng.pareto(1.5, n), 1))})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def hashed(i):
    return hashlib.sha256(f"-{i}".encode()).hexdigest()


@pytest.mark.parametrize("size", [150, 10_000])
def test_ranks_and_sums_match_one_sorted_frame(frame, size):
    pdf, df = frame
    out = ordered_prefix(df.withColumn("tie", tie_hash("IDpol")), ["part"], "v", "tie",
                         sums={"cw": "w"}, totals={"tw": "w"}, count="n",
                         rows_per_bucket=size).toPandas().set_index("IDpol")
    want = pdf.assign(t=pdf.IDpol.map(hashed)).sort_values(["part", "v", "t"])
    want["rank"] = want.groupby("part").cumcount() + 1
    want["cw"] = want.groupby("part").w.cumsum()
    want = want.set_index("IDpol").loc[out.index]
    assert (out["rank"] == want["rank"]).all()
    assert np.allclose(out.cw, want.cw, rtol=1e-12)
    assert np.allclose(out.tw, want.groupby("part").w.transform("sum"))
    assert (out.n == want.groupby("part").w.transform("size")).all()


def test_a_heavy_value_is_cut_into_several_buckets(frame):
    _, df = frame
    keyed = df.withColumn("tie", tie_hash("IDpol"))
    buckets = plan_buckets(keyed, "v", ["part", "v", "tie"], 100)
    assert max(buckets.shares) > 5
    sizes = assign_bucket(keyed, "v", "tie", buckets, "b", "s").groupBy("b", "s").count()
    assert sizes.agg(F.max("count")).first()[0] < 4000 / 10


def test_descending_zero_is_not_split_from_minus_zero(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 2 else -0.0) for i in range(300)], "k long, v double")
    from ratelark.operators.ordered import plain_zero
    df = df.withColumns({"v": plain_zero(-F.col("v")), "tie": tie_hash("k")})
    out = ordered_prefix(df, [], "v", "tie", rows_per_bucket=20).toPandas()
    order = out.sort_values("rank").k.tolist()
    assert order == sorted(range(300), key=hashed)


@pytest.mark.parametrize("size", [100, 10_000])
def test_exact_quantiles(frame, size):
    pdf, df = frame
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    out = exact_quantiles(df, ["part"], "v", probs, size).toPandas()
    for _, r in out.iterrows():
        assert r["quantile"] == pytest.approx(np.quantile(pdf[pdf.part == r.part].v, r.prob))


@pytest.mark.parametrize("size", [100, 10_000])
def test_weighted_quantiles(frame, size):
    pdf, df = frame
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    out = weighted_quantiles(df, ["part"], "v", "w", probs, rows_per_bucket=size).toPandas()
    assert len(out) == 15
    for part, g in pdf.assign(t=pdf.IDpol.map(hashed)).sort_values(["v", "t"]).groupby("part"):
        at = (g.w.cumsum() - g.w / 2) / g.w.sum()
        got = out[out.part == part].set_index("prob")["quantile"]
        assert np.allclose(got.loc[probs], np.interp(probs, at, g.v))


@pytest.mark.parametrize("size", [50, 10_000])
def test_nearest_value(spark, size):
    rng = np.random.default_rng(1)
    knots = np.unique(np.round(rng.normal(size=200), 3))
    asked = np.round(rng.normal(size=1000) * 1.5, 2)
    table = spark.createDataFrame([("p", float(x), float(i)) for i, x in enumerate(knots)],
                                  "part string, x double, y double")
    queries = spark.createDataFrame([("p", float(x)) for x in asked], "part string, x double")
    out = nearest_value(queries, table, ["part"], "x", "y", size).toPandas()
    assert len(out) == len(np.unique(asked))
    best = np.abs(out.x.values[:, None] - knots[None, :]).min(axis=1)
    assert np.allclose(np.abs(out.x - knots[out.y.astype(int)]), best)


def test_hot_join_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
                                    .alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = hot_join(rows, table, ["k"], max_hot=10)
    assert out.count() == 3000
    assert out.where("v <> 2 * k").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5, -3.0]), min_size=2, max_size=60))
def test_splits_are_increasing(values):
    from itertools import groupby
    edges = sorted(values)
    assert [k for k, _ in groupby(edges)] == sorted(set(values))
    assert Buckets().single


@pytest.mark.parametrize("size", [7, None])
def test_following_value_crosses_buckets(spark, size):
    import pyspark.sql.functions as F
    df = spark.range(60).select((F.col("id") % 2).cast("string").alias("part"), "id",
                                (F.col("id") % 19).cast("double").alias("x"),
                                tie_hash("id").alias("tie"))
    rows = ordered_prefix(df, ["part"], "x", "tie", rows_per_bucket=size, following="next").collect()
    for part in "01":
        mine = sorted((r.rank, r.x, r.next) for r in rows if r.part == part)
        assert [r[2] for r in mine] == [r[1] for r in mine[1:]] + [None]


def test_late_columns_are_not_shuffled(spark, capsys):
    """Rows meet one shuffle, which carries neither hash nor products; heavy values stay cut."""
    from ratelark.operators.ordered import ordered_prefix, tie_hash
    for share in (1, 3):                     # without and with a value that fills several buckets
        df = spark.range(900).select(
            F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"),
            F.when(F.col("id") % 3 < share, F.col("id") / 7).otherwise(F.lit(5.0)).alias("v"),
            (F.col("id") % 11).cast("double").alias("w"))
        late = {"t": tie_hash("k"), "wv": F.col("w") * F.col("v")}
        kw = dict(sums={"c": "wv"}, totals={"all": "wv"}, count="n", rows_per_bucket=50, key="k")
        want = ordered_prefix(df.withColumns(late), ["g"], "v", "t", **kw)
        got = ordered_prefix(df, ["g"], "v", "t", late=late, **kw)
        assert got.columns == want.columns
        rows = [{r.k: r for r in x.collect()} for x in (got, want)]
        assert rows[0].keys() == rows[1].keys() and all(
            r.t == rows[1][k].t and r["rank"] == rows[1][k]["rank"] and r.n == 450
            and abs(r.c - rows[1][k].c) < 1e-6 and abs(r["all"] - rows[1][k]["all"]) < 1e-6
            for k, r in rows[0].items())
        capsys.readouterr()
        got.drop("t").explain()
        plan = capsys.readouterr().out.splitlines()
        dealt = next(i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
        window = next(i for i, line in enumerate(plan) if "Window" in line)
        assert not any("Exchange" in line for line in plan[window:dealt])
        assert "sha2" in "".join(plan[window:dealt])
