"""Models, selection, tuning and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .curves import (ABC_SQL, CCI_SQL, GINI_SQL, POINT_SQL, SPEARMAN_SQL, staged_predictions,
                     strict_groups)
from .. import oracle as o
from ..jobs import Run
from ...config import (Calibration, Features, Job, Sampling, Split, Target, Tuning, Weighting)
from ...functions.columns import rounded
from ...operators import boost, glm
from ...operators import candidates as cd
from ...operators import features as ft
from ...operators import metrics as m
from ...operators import selection as sel
from ...operators import tuning as tn
from ...operators.pca import PrincipalComponents
from ...session import new_folder, stage
from ...sources.portfolio_views import claims_view, policies_view, prepared_view
from ...sources.stages import StageStore

PARTS = [str(i) for i in range(5)]
NUMERIC = ["VehAge10", "VehPower10", "BonusMalus100", "LogDensity"]


def model_rows(spark, sf, target=Target.FREQUENCY):
    """Scaled numeric features with target and weight."""
    rows = prepared_view(spark, sf)
    if target is Target.SEVERITY:
        y, w, rows = F.col("ClaimSeverity_TRG"), F.greatest("ClaimCountWeight", F.lit(1)), \
            rows.where("ClaimSeverity_TRG > 0")
    elif target is Target.PURE_PREMIUM:
        y, w = F.col("ClaimPurePremium_TRG"), F.col("Exposure")
    else:
        y, w = F.col("ClaimFreq_TRG"), F.col("Exposure")
    return stage(rows.select(
        "part", "IDpol", (F.col("VehAge") / 10).alias("VehAge10"),
        (F.col("VehPower") / 10).alias("VehPower10"),
        (F.col("BonusMalus") / 100).alias("BonusMalus100"),
        F.log("Density").alias("LogDensity"),
        y.cast("double").alias("y"), w.cast("double").alias("w")), "model_rows", ["part"])


@query("mean_predictor", f"""WITH {o.PREPARED}
SELECT part, round(sum(ClaimFreq_TRG * Exposure) / sum(Exposure), 6) AS pred
FROM prep GROUP BY part""")
def mean_predictor(spark, sf):
    return glm.mean_predictor(prepared_view(spark, sf), ["part"], "ClaimFreq_TRG", "Exposure") \
        .withColumn("pred", rounded(F.col("pred")))


def glm_query(name, spec, target=Target.FREQUENCY, scored=False):
    @query(name)
    def run(spark, sf):
        rows = model_rows(spark, sf, target)
        models = glm.fit_parts(rows, PARTS, NUMERIC, "y", "w", spec)
        if scored:
            return models.predict(rows).select("part", "IDpol", rounded(F.col("pred")).alias("pred"))
        return models.coefficients(spark)

    features = ", ".join(f"('{f}')" for f in ["(constant)", *NUMERIC])
    keep = " WHERE ClaimSeverity_TRG > 0" if target is Target.SEVERITY else ""

    @query(f"{name}_optimality", f"""WITH {o.PREPARED}
SELECT DISTINCT part, feature, CAST(0 AS DOUBLE) AS residual
FROM prep, (VALUES {features}) fe(feature){keep}""")
    def optimality(spark, sf):
        """The score equations hold at the fitted coefficients, to a thousandth of their terms."""
        rows = model_rows(spark, sf, target)
        models = glm.fit_parts(rows, PARTS, NUMERIC, "y", "w", spec)
        return models.score_residuals(rows, spec, "y", "w").withColumn(
            "residual", rounded(F.col("residual"), 3))
    return run


glm_query("glm_gaussian", glm.GlmSpec("gaussian", "identity"))
glm_query("glm_poisson", glm.GlmSpec("poisson"), scored=True)
glm_query("glm_poisson_ridge", glm.GlmSpec("poisson", l2=0.1))
glm_query("glm_gamma_log", glm.GlmSpec("gamma", "log", target_divisor="mean"), Target.SEVERITY)
glm_query("glm_gamma_inverse", glm.GlmSpec("gamma", "inverse", target_divisor="mean"),
          Target.SEVERITY)
glm_query("glm_gamma_ridge", glm.GlmSpec("gamma", "log", l2=0.1), Target.SEVERITY)
glm_query("glm_tweedie", glm.GlmSpec("tweedie", "log", 1.5), Target.PURE_PREMIUM)
glm_query("glm_tweedie_ridge", glm.GlmSpec("tweedie", "log", 1.5, l2=0.1, target_divisor="mean"),
          Target.PURE_PREMIUM)
glm_query("glm_elastic_net", glm.elastic_net_spec("poisson", 0.5, 0.02))


def saturated_query(name, target, y, w, spec):
    """With one indicator per area a GLM of any family and link fits the weighted area means."""
    digits = 3 if target is Target.PURE_PREMIUM else 5
    keep = f"WHERE {y} > 0" if target is Target.SEVERITY else ""

    @query(name, f"""WITH {o.PREPARED}, z AS (SELECT * FROM prep {keep}),
a AS (SELECT part, Area, sum({y} * {w}) / sum({w}) AS v FROM z GROUP BY part, Area)
SELECT z.part, IDpol, round(v, {digits}) AS pred FROM z JOIN a ON z.part = a.part AND z.Area = a.Area""")
    def run(spark, sf):
        base = prepared_view(spark, sf)
        base = base.where(f"{y} > 0") if target is Target.SEVERITY else base
        rows = stage(base.select("part", "IDpol", "Area", F.expr(y).cast("double").alias("y"),
                                 F.expr(w).cast("double").alias("w")), "areas", ["part"])
        levels = ft.fit_levels(rows, ["part"], ["Area"], drop_first=True).collect()
        coded = ft.one_hot(rows, ["part"], levels)
        names = [c for c in coded.columns if c.startswith("Area_")]
        models = glm.fit_parts(coded, PARTS, names, "y", "w", spec)
        # amounts have cents, so means lie on ties of the last digit: noise must not decide those
        return models.predict(coded).select(
            "part", "IDpol", F.round(F.round("pred", 9), digits).alias("pred"))
    return run


FREQUENCY = (Target.FREQUENCY, "ClaimFreq_TRG", "Exposure")
SEVERITY = (Target.SEVERITY, "ClaimSeverity_TRG", "greatest(ClaimCountWeight, 1)")
PREMIUM = (Target.PURE_PREMIUM, "ClaimPurePremium_TRG", "Exposure")
saturated_query("glm_areas_gaussian", *FREQUENCY, glm.GlmSpec("gaussian", "identity"))
saturated_query("glm_areas_poisson", *FREQUENCY, glm.GlmSpec("poisson", tol=1e-12))
saturated_query("glm_areas_gamma_log", *SEVERITY, glm.GlmSpec("gamma", "log", tol=1e-12))
saturated_query("glm_areas_gamma_inverse", *SEVERITY, glm.GlmSpec(
    "gamma", "inverse", target_divisor="mean", floor_at_min=False, tol=1e-14))
saturated_query("glm_areas_tweedie_log", *PREMIUM, glm.GlmSpec("tweedie", "log", 1.5, tol=1e-12))
saturated_query("glm_areas_tweedie_power", *PREMIUM, glm.GlmSpec(
    "tweedie", "power", 1.5, target_divisor="mean", tol=1e-14))


@query("boosted_poisson")
def boosted_poisson(spark, sf):
    rows = model_rows(spark, sf)
    spec = boost.BoostSpec(n_estimators=5, max_depth=3, learning_rate=0.3)
    model = boost.fit_booster(rows, NUMERIC, spec)
    return model.predict(rows).select("part", "IDpol", rounded(F.col("pred")).alias("pred"))


@query("boosted_tweedie")
def boosted_tweedie(spark, sf):
    rows = model_rows(spark, sf)
    spec = boost.BoostSpec("tweedie", n_estimators=5, max_depth=3, learning_rate=0.3)
    model = boost.fit_booster(rows, NUMERIC, spec)
    return model.predict(rows).select("part", "IDpol", rounded(F.col("pred")).alias("pred"))


@query("boosted_parts")
def boosted_parts(spark, sf):
    """All parts in the same passes, scored in one scan."""
    rows = model_rows(spark, sf)
    spec = boost.BoostSpec(n_estimators=5, max_depth=4, num_leaves=8, learning_rate=0.3)
    fits = boost.fit_boosters(rows, dict.fromkeys(PARTS, NUMERIC), dict.fromkeys(PARTS, spec))
    return rows.withColumn("pred", boost.score_expression(fits)).select(
        "part", "IDpol", rounded(F.col("pred")).alias("pred"))


@query("lasso_selection")
def lasso_selection(spark, sf):
    rows = model_rows(spark, sf)
    scores = glm.for_parts(PARTS, lambda p: sel.lasso_importance(
        rows.where(F.col("part") == p), NUMERIC, alpha=0.001))
    table = spark.createDataFrame(
        [(p, f, v) for p, s in scores.items() for f, v in s.items()],
        "part string, feature string, importance double")
    return sel.select_by_importance(table, 0.0, 3)


@query("importance_selection", f"""WITH {o.PREPARED},
u AS (SELECT part, unnest(['VehAge', 'VehPower', 'BonusMalus', 'DrivAge']) AS feature,
        unnest([abs(corr(VehAge, ClaimFreq_TRG)), abs(corr(VehPower, ClaimFreq_TRG)),
                abs(corr(BonusMalus, ClaimFreq_TRG)), abs(corr(DrivAge, ClaimFreq_TRG))])
        AS importance FROM prep GROUP BY part),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY importance DESC, feature) AS place
      FROM u WHERE importance > 0.001)
SELECT part, feature, round(importance, 6) AS importance, place FROM k WHERE place <= 2""")
def importance_selection(spark, sf):
    names = ["VehAge", "VehPower", "BonusMalus", "DrivAge"]
    wide = prepared_view(spark, sf).groupBy("part").agg(
        *[F.abs(F.corr(n, "ClaimFreq_TRG")).alias(n) for n in names])
    table = wide.unpivot("part", names, "feature", "importance")
    out = sel.select_by_importance(table, 0.001, 2)
    return out.withColumn("importance", F.round("importance", 6))


TRIALS_SQL = f"""{o.predictions('pred_signal')},
tr AS (SELECT CAST(k AS INT) AS trial, CAST(IDpol % 3 AS INT) AS fold, part,
         CASE WHEN VALTEST THEN 'val' ELSE 'train' END AS role,
         sqrt(sum(w * pow(y - pred * (CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * k), 2)) / sum(w))
         AS score
  FROM (SELECT *, IDpol % 2 = 1 AS VALTEST FROM t), range(6) kk(k) GROUP BY ALL),
ls AS (SELECT part, trial, avg(score) FILTER (WHERE role = 'val')
         + CAST(0.5 AS DOUBLE) * greatest(avg(score) FILTER (WHERE role = 'val')
         - avg(score) FILTER (WHERE role = 'train'), 0) AS loss FROM tr GROUP BY part, trial)"""


def trial_scores(spark, sf):
    """Six rescalings of one predictor scored on three folds."""
    rows = staged_predictions(spark, sf, pred="pred_signal")
    tried = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({
        "pred": F.col("pred") * (0.5 + 0.25 * F.col("trial")),
        "fold": (F.col("IDpol") % 3).cast("int"),
        "role": F.when(F.col("IDpol") % 2 == 1, "val").otherwise("train")})
    scores = m.pointwise_metrics(tried, ["part", "trial", "fold", "role"], ["RMSE"])
    return scores.select("part", "trial", "fold", "role", F.col("RMSE").alias("score"),
                         F.lit("ok").alias("status"))


@query("trial_losses", f"""WITH {TRIALS_SQL}
SELECT part, trial, 'ok' AS status, round(loss, 6) AS loss FROM ls""")
def trial_losses(spark, sf):
    return tn.trial_losses(trial_scores(spark, sf), False, 0.5).withColumn(
        "loss", F.round("loss", 6))


@query("best_trials", f"""WITH {TRIALS_SQL}
SELECT part, trial, round(loss, 6) AS loss FROM ls
QUALIFY row_number() OVER (PARTITION BY part ORDER BY loss, trial) = 1""")
def best_trials(spark, sf):
    losses = tn.trial_losses(trial_scores(spark, sf), False, 0.5)
    return tn.best_trials(losses).withColumn("loss", F.round("loss", 6))


@query("trial_summary", f"""WITH {TRIALS_SQL}
SELECT part, trial, {', '.join(
    f"round({fn}(score) FILTER (WHERE role = '{role}'), 6) + 0.0 AS {role}_{name}"
    for role in ('train', 'val') for fn, name in (('avg', 'mean'), ('stddev_pop', 'std')))}
FROM tr GROUP BY part, trial""")
def trial_summary(spark, sf):
    out = tn.trial_summary(trial_scores(spark, sf))
    return out.select("part", "trial", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


@query("trial_fold_scores", f"""WITH {TRIALS_SQL}
SELECT part, trial, role, {', '.join(f'round(max(score) FILTER (WHERE fold = {f}), 6) AS "{f}"'
                                     for f in range(3))} FROM tr GROUP BY part, trial, role""")
def trial_fold_scores(spark, sf):
    out = tn.fold_scores(trial_scores(spark, sf), 3)
    return out.select("part", "trial", "role", *[F.round(str(f), 6).alias(str(f)) for f in range(3)])


@query("random_search")
def random_search(spark, sf):
    """Ridge strength of a Poisson GLM on one split."""
    rows = model_rows(spark, sf).withColumn("is_val", F.col("IDpol") % 4 == 0)
    tried = tn.candidates(tn.SPACES["ridge_glm"], 3, 7)

    def together(tasks):
        return cd.glm_trials(rows, {t: glm.Problem(t[0], NUMERIC, glm.GlmSpec(
            "poisson", l2=tried[t[1]]["alpha"])) for t in tasks}, dict.fromkeys(tasks, "MPD"))

    scores = tn.run_trials(spark, PARTS, tried, 1, None, False, together=together)
    return tn.best_parameters(spark, tn.best_trials(tn.trial_losses(scores, False)), tried)


NAMES = m.metric_names(Target.FREQUENCY)


def all_metrics_sql() -> str:
    """Every frequency metric per part, long form."""
    def sub(body: str) -> str:
        return f"(WITH {o.predictions('pred_signal')}, {body})"

    bins = f"""{strict_groups()} SELECT part, n_bins, max(abs(mt - mp)) AS MAB,
        max(greatest(mt, mp) - mt) AS MOP, max(mt - least(mt, mp)) AS MUP
        FROM gm GROUP BY part, n_bins"""
    gini = f"""{GINI_SQL} SELECT a.part, lcgi AS LCGI, ccgi AS CCGI,
        CASE WHEN abs(best) <= 1e-5 THEN 0 ELSE ccgi / best END AS NCCGI
        FROM a JOIN b ON a.part = b.part JOIN d ON a.part = d.part"""
    abc = f"""{ABC_SQL} SELECT gc.part,
        sum(abs(gc.h - gl.h) * CASE WHEN gc.i IN (0, 4999) THEN 0.5 ELSE 1.0 END) / 4999 AS ABC,
        max(abs(gc.h - gl.h)) AS SDCL
        FROM gc JOIN gl ON gc.part = gl.part AND gc.i = gl.i GROUP BY gc.part"""
    pieces = [
        (f"(WITH {o.predictions('pred_signal')} SELECT part, {POINT_SQL} FROM t GROUP BY part)",
         ["MAE", "RMSE", "R2", "MBD", "MPD"]),
        (sub(SPEARMAN_SQL), ["SC"]), (sub(gini), ["LCGI", "CCGI", "NCCGI"]),
        (sub(abc), ["ABC", "SDCL"]), (sub(CCI_SQL), ["CCI", "COI", "CUI"])]
    out = [f"SELECT part, 'ew{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {q}"
           for q, ns in pieces for n in ns]
    out += [f"SELECT part, '{n}_' || n_bins || 'B' AS metric, {n} AS value FROM {sub(bins)}"
            for n in ("MAB", "MOP", "MUP")]
    return "\nUNION ALL\n".join(out).replace(", 6)", ", 13)")


def by_part_metrics(spark, sf):
    rows = staged_predictions(spark, sf, pred="pred_signal")
    return m.evaluate(rows, ["part"], NAMES, Weighting.EXPOSURE)


@query("metrics_by_part", f"""SELECT part, metric, round(value, 6) + 0.0 AS value
FROM ({all_metrics_sql()})""")
def metrics_by_part(spark, sf):
    return by_part_metrics(spark, sf).withColumn("value", rounded(F.col("value")))


@query("metrics_cv", f"""SELECT metric, round(avg(value), 6) + 0.0 AS cv_mean,
       round(stddev_samp(value), 6) + 0.0 AS cv_std FROM ({all_metrics_sql()}) GROUP BY metric""")
def metrics_cv(spark, sf):
    out = m.cv_summary(by_part_metrics(spark, sf), [])
    return out.select("metric", *[rounded(F.col(c)).alias(c) for c in ("cv_mean", "cv_std")])


@query("metrics_wide", f"""SELECT metric, {', '.join(
    f'''round(max(value) FILTER (WHERE part = '{p}'), 6) + 0.0 AS "{p}"''' for p in PARTS)}
FROM ({all_metrics_sql()}) GROUP BY metric""")
def metrics_wide(spark, sf):
    out = m.metrics_wide(by_part_metrics(spark, sf), [], PARTS)
    return out.select("metric", *[rounded(F.col(f"`{p}`")).alias(p) for p in PARTS])


def small_job() -> Job:
    return Job(
        target=Target.FREQUENCY, model="poisson_glm",
        split=Split(cv_folds=2, calib_enabled=True, shared_train_calib=True),
        sampling=Sampling(), features=Features(
            custom=("driver_age_bins", "log_density", "bonus_malus_cap"),
            scaler="standard", drop_first=True),
        calibration=Calibration(model="equal_bins_means", rebalance="scale"))


@query("pca_variance_pair", f"""WITH {o.PREPARED},
m AS (SELECT var_samp(VehAge) AS a, var_samp(VehPower) AS c, covar_samp(VehAge, VehPower) AS b
      FROM prep),
e AS (SELECT (a + c) AS s, sqrt((a - c) * (a - c) + 4 * b * b) AS d FROM m)
SELECT 'PC0' AS component, round((s + d) / 2 / s, 6) AS explained_variance FROM e
UNION ALL SELECT 'PC1', round((s - d) / 2 / s, 6) FROM e""")
def pca_variance_pair(spark, sf):
    rows = stage(prepared_view(spark, sf).select("VehAge", "VehPower"), "pair")
    out = PrincipalComponents.fit(rows, ["VehAge", "VehPower"], 2).explained_variance(spark)
    return out.select("component", F.round("explained_variance", 6).alias("explained_variance"))


@query("score_and_evaluate")
def score_and_evaluate(spark, sf):
    """Preparation to calibrated test metrics, two folds."""
    store = StageStore(spark, new_folder(spark, "run"))
    run = Run(small_job(), store)
    run.run(policies_view(spark, sf).drop("part"), claims_view(spark, sf), stop="test")
    return store.read_metrics()[1]
