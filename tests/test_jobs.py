"""Stage tables, search and a small end-to-end run."""

import math

import pytest
from pyspark.sql import functions as F

from ratelark.config import (Calibration, Features, Job, Sampling, Split, Target, Tuning)
from ratelark.operators import tuning as tn
from ratelark.plans.jobs import Run, recompute_metrics
from ratelark.plans.registry import model_kind
from ratelark.sources import portfolio as src
from ratelark.sources.portfolio_views import claims_view, policies_view
from ratelark.sources.stages import StageStore


def test_raw_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "IDpol,ClaimNb,Exposure,Area,VehPower,VehAge,DrivAge,BonusMalus,VehBrand,VehGas,Density,"
        "Region\n1,1,0.5,D,5,0,55,50,B12,Regular,1217,R82\n")
    (tmp_path / "c.csv").write_text("IDpol,ClaimAmount\n1,995.2\n")
    assert src.read_policies(spark, str(tmp_path / "p.csv")).first().Density == 1217.0
    assert src.read_claims(spark, str(tmp_path / "c.csv")).first().ClaimAmount == 995.2


def test_text_inputs(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# listed features\nDensity # skewed\n\n  Region\n")
    names = [r.feature for r in src.read_blacklist(spark, str(tmp_path / "b.txt")).collect()]
    assert names == ["Density", "Region"]
    (tmp_path / "r.yml").write_text('DrivAge: "4151" # [41,51)\nRegion: "Centre"\n')
    assert src.read_reference_categories(spark, str(tmp_path / "r.yml")) == {
        "DrivAge": "4151", "Region": "Centre"}


def test_store_keeps_nothing_of_an_earlier_run(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    role = "part string, role string, IDpol long"
    store.write(spark.createDataFrame([("0", "train", 1), ("4", "calib", 2)], role), "a",
                ["part", "role"])
    store.write(spark.createDataFrame([("0", "train", 3)], role), "a", ["part", "role"])
    assert [(r.part, r.IDpol) for r in store.read("a").collect()] == [("0", 3)]
    data = "dataset string, part string, IDpol long"
    store.write_predictions(spark.createDataFrame(
        [("train", "0", 1), ("test", "0", 2), ("test", "1", 3)], data))
    store.write_predictions(spark.createDataFrame([("test", "0", 9)], data))
    assert sorted(r.IDpol for r in store.read_predictions().collect()) == [1, 9]
    first = spark.createDataFrame([("00", 1), ("1", 2)], "part string, IDpol long")
    store.write_parts(first, "t")
    store.write_parts(spark.createDataFrame([("1", 9)], "part string, IDpol long"), "t")
    assert sorted((r.part, r.IDpol) for r in store.read("t").collect()) == [("1", 9)]
    assert store.read_part("t", "00").count() == 0
    keys = spark.createDataFrame([(5,)], "IDpol long")
    store.write_parts(spark.createDataFrame([("2", 5), ("2", 6)], "part string, IDpol long"), "t",
                      keys)
    assert store.read_part("t", "2").count() == 1


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    store = StageStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1.0,)], "a double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="v")]).fit(df)
    store.save_model(model, "0", "features")
    assert store.load_model("0", "features").transform(df).count() == 1


def test_search(spark):
    space = tn.search_space(tn.SPACES["boosted_trees"], {"subsample": 1.0}, ("max_bin",))
    tried = tn.candidates(space, 5, 3)
    assert tried == tn.candidates(space, 5, 3) and "max_bin" not in tried[0]
    assert all(c["n_estimators"] % 50 == 0 and c["subsample"] == 1.0 for c in tried)
    assert all(1e-5 <= c["reg_alpha"] <= 10 for c in tried)
    with pytest.raises(ValueError):
        tn.Uniform(2, 1)
    assert len({tn.repeated_split_seed(s, f) for s in range(9) for f in range(9)}) == 81

    points = [{"x": v} for v in (3.0, 1.0, 1.0, 2.0)]

    def evaluate(part, params, fold):
        if params["x"] == 2.0:
            raise ArithmeticError("no fit")
        return params["x"], params["x"] + fold

    scores = tn.run_trials(spark, ["0"], points, 2, evaluate, False, 0.5, threads=2)
    losses = {r.trial: (r.status, r.loss) for r in tn.trial_losses(scores, False, 0.5).collect()}
    assert losses[0] == ("ok", 3.75) and losses[3][0] == "fail" and losses[3][1] is None
    best = tn.best_trials(tn.trial_losses(scores, False, 0.5))
    assert best.first().trial == 1
    assert tn.best_parameters(spark, best, points).first().value == "1.0"
    few = tn.run_trials(spark, ["0"], [{"x": 1.0}] * 20, 1, evaluate, False, stop_after=3,
                        threads=1)
    assert few.select("trial").distinct().count() == 4


def test_unknown_models():
    with pytest.raises(KeyError):
        model_kind("nothing")
    assert model_kind("ratelark.plans.registry:MODELS")["mean"].metric == "RMSE"


def test_run_end_to_end(spark, sf, tmp_path):
    job = Job(target=Target.FREQUENCY, model="poisson_glm",
              split=Split(test_size=0.25, calib_size=0.25),
              sampling=Sampling(validation="split_train_val", val_size=0.25),
              features=Features(custom=("driver_age_bins", "log_density"), scaler="standard",
                                drop_first=True, blacklist=("VehPower",)),
              selector=("lasso", {"alpha": 1e-4, "max_n_features": 8}),
              calibration=Calibration(model="equal_bins_means", rebalance="scale"))
    store = StageStore(spark, str(tmp_path))
    run = Run(job, store)
    run.run(policies_view(spark, sf).drop("part"), claims_view(spark, sf))
    stored = store.read_predictions()
    n = store.read("targets").count()
    assert stored.where("dataset IN ('train', 'test', 'calib')").count() == n
    assert len(run.fitted.selected["0"]) <= 8
    by_part, cv = store.read_metrics()
    value = {(r.dataset, r.prefix, r.metric): r.value for r in by_part.collect()}
    assert abs(value["calib", "calibrated", "ewMBD"]) < 1e-9
    assert all(v is not None and math.isfinite(v) for k, v in value.items()
               if k[0] == "train" and k[1] == "calibrated")
    assert {r.dataset for r in by_part.select("dataset").distinct().collect()} == {
        "sample_train", "sample_valid", "calib", "train", "test"}
    for table in ("curves", "lift", "auto_calibration", "mean_calibration_curves"):
        assert store.read(table).count() > 0
    before = {(r.dataset, r.IDpol): r.pred for r in stored.where("dataset = 'test'").collect()}
    fresh = Run(job, store)
    fresh.run(start="test", stop="test")
    after = {(r.dataset, r.IDpol): r.pred for r in store.read_predictions("test").collect()}
    assert after.keys() == before.keys()
    assert all(abs(after[k] - v) < 1e-9 for k, v in before.items())
    again, _ = recompute_metrics(store, job)
    redone = {(r.dataset, r.prefix, r.metric): r.value for r in again.collect()}
    assert redone.keys() == value.keys()
    assert all((a is None) == (redone[k] is None) and (a is None or abs(a - redone[k]) < 1e-9)
               for k, a in value.items())


def test_tuned_run_with_folds(spark, sf, tmp_path):
    job = Job(target=Target.FREQUENCY, model="ridge_poisson_glm",
              split=Split(cv_folds=2, shared_train_calib=True), target_transform=None,
              features=Features(custom=("log_density",), categorical_imputer=None, scaler="standard",
                                drop_first=True),
              tuning=Tuning(enabled=True, max_evals=2, validation="cross_validation", folds=2),
              calibration=Calibration(enabled=False))
    store = StageStore(spark, str(tmp_path))
    run = Run(job, store)
    run.run(policies_view(spark, sf).drop("part"), claims_view(spark, sf), stop="model")
    assert store.read("trials").count() == 2 * 2 * 2 * 2
    assert store.read("hyper_parameters").where("param = 'alpha'").count() == 2
    assert set(run.fitted.models) == {"0", "1"}


def test_sources_are_read_once_and_scores_need_two_joins(spark, tmp_path, capsys):
    seen = spark.sparkContext.accumulator(0)

    def look(key):
        seen.add(1)
        return key

    n = 60
    look = F.udf(look, "long").asNondeterministic()
    policies = spark.range(n).select(
        look("id").alias("IDpol"), (F.col("id") % 3).alias("ClaimNb"),
        (F.col("id") % 4 / 4).alias("Exposure"), (20 + F.col("id") % 50).alias("DrivAge"))
    claims = spark.range(n).select((F.col("id") % 20).alias("IDpol"),
                                   F.lit(10.0).alias("ClaimAmount"))
    job = Job(target=Target.FREQUENCY, model="poisson_glm",
              split=Split(cv_folds=2, shared_train_calib=True),
              features=Features(numeric_imputer="median", polynomial_degree=2),
              calibration=Calibration(enabled=False))
    run = Run(job, StageStore(spark, str(tmp_path)))
    run.run(policies, claims, stop="preprocess")
    assert seen.value == n
    assert run.store.read("features").count() == run.store.read("targets").count() == 45
    run.run(start="split", stop="model")
    assert run.fitted.features.columns == ["DrivAge", "DrivAge^2"]
    keys = spark.createDataFrame([("a", "0", 1), ("b", "0", 1), ("a", "1", 2), ("a", "1", 0)],
                                 "dataset string, part string, IDpol long")
    scored = run.predict(keys)
    capsys.readouterr()
    scored.explain()
    plan = capsys.readouterr().out
    assert plan.count("HashJoin") + plan.count("SortMergeJoin") == 2
    out = {(r.dataset, r.part, r.IDpol): r for r in scored.collect()}
    assert set(out) == {("a", "0", 1), ("b", "0", 1), ("a", "1", 2)}
    assert out["a", "0", 1].pred == out["b", "0", 1].pred and out["a", "1", 2].y == 4.0
    twice = policies.where("IDpol < 5").union(policies.where("Exposure = 0"))
    with pytest.raises(ValueError, match="occurs 2 times"):
        run.preprocess(twice, claims)


def test_a_run_leaves_only_its_store_and_calibrator(spark, sf, tmp_path, monkeypatch):
    from ratelark import session
    from ratelark.operators import ordered
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 200)
    job = Job(target=Target.FREQUENCY, model="poisson_glm",
              split=Split(cv_folds=2, shared_train_calib=True),
              features=Features(custom=("log_density",), scaler="standard", drop_first=True),
              calibration=Calibration(model="equal_bins_means", rebalance="scale"))
    run = Run(job, StageStore(spark, str(tmp_path / "store")))
    run.run(policies_view(spark, sf).drop("part"), claims_view(spark, sf), stop="test")
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "ratelark").iterdir()}
    assert left == {"bin_means", "rebalance"}
    values = {(r.dataset, r.prefix, r.part, r.metric): r.value
              for r in run.store.read_metrics()[0].collect()}
    assert all(v is not None and math.isfinite(v) for k, v in values.items() if k[0] != "calib")
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 10 ** 9)
    again, _ = recompute_metrics(run.store, job)
    whole = {(r.dataset, r.prefix, r.part, r.metric): r.value for r in again.collect()}
    assert whole.keys() == values.keys()
    assert all(abs(whole[k] - v) < 1e-9 for k, v in values.items() if v is not None)


def test_stage_tables_pass(spark, tmp_path, monkeypatch):
    from ratelark import session
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))

    def left():
        return {p.name.rsplit("-", 1)[0] for p in (tmp_path / "ratelark").iterdir()}
    df = spark.range(3)
    session.stage(df, "before")
    with pytest.raises(ZeroDivisionError), session.passing(spark):
        session.stage(df, "a")
        with session.passing(spark):
            session.stage(df, "b")
            with session.outer():
                session.stage(df, "c")
            assert left() == {"before", "a", "b", "c"}
        assert left() == {"before", "a", "c"}
        with session.outer():
            kept = session.stage(df, "d")
        raise ZeroDivisionError
    assert left() == {"before", "d"} and kept.count() == 3
