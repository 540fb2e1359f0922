"""Models by name: fit one part's rows, predict a frame, report importances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_model
from ..functions.lookup import resolve
from ..operators.boost import Booster, BoostSpec, fit_booster, fit_boosters, score_expression
from ..operators.glm import GlmFit, GlmSpec, Problem, elastic_net_spec, fit_glm, fit_glms
from ..session import stage


@dataclass(frozen=True)
class MeanModel:
    """The weighted mean target."""

    mean: float

    def expression(self) -> Column:
        return F.lit(self.mean)

    def predict_frame(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.lit(self.mean))

    def importance(self) -> dict[str, float]:
        return {}


@dataclass(frozen=True)
class GlmModel:
    fit: GlmFit

    def expression(self) -> Column:
        return self.fit.predict()

    def predict_frame(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.fit.predict())

    def importance(self) -> dict[str, float]:
        return self.fit.importance()


@dataclass(frozen=True)
class BoostModel:
    """Boosted trees; the models of all parts score together."""

    fit: Booster

    def predict_frame(self, df: DataFrame, out: str) -> DataFrame:
        return self.fit.predict(df, out)

    def importance(self) -> dict[str, float]:
        return self.fit.importance()


def predict_parts(models: dict[str, object], rows: DataFrame, out: str = "pred") -> DataFrame:
    """Scores of all parts: one pass when every model is an expression, else part by part.

    A row of a part without a model is an error.
    """
    if all(hasattr(m, "expression") for m in models.values()):
        pred = no_model()
        for part, model in models.items():
            pred = F.when(F.col("part") == part, model.expression()).otherwise(pred)
        return rows.withColumn(out, pred)
    if all(isinstance(m, BoostModel) for m in models.values()):
        return rows.withColumn(out, score_expression({p: m.fit for p, m in models.items()}))
    rows = stage(rows, "score_rows", ["part"])
    known = F.coalesce(F.col("part").isin(list(models)), F.lit(False))
    done = rows.where(~known).withColumn(out, no_model())
    for part, model in models.items():
        mine = model.predict_frame(rows.where(F.col("part") == part), out)
        done = done.unionByName(mine.select(*rows.columns, out))
    return done


@dataclass(frozen=True)
class ModelKind:
    """How to fit a model and which metric tunes it.

    ``fit_all``, where there is one, fits all parts together: it takes their rows, and features and
    parameters by part.  ``glm_spec`` is the GLM of some parameters.
    """

    fit: Callable[[DataFrame, list[str], dict], object]
    metric: str
    fit_all: Callable[[DataFrame, dict, dict], dict] | None = None
    glm_spec: Callable[[dict], GlmSpec] | None = None

    def metric_of(self, params: dict) -> str:
        """The tuning metric; a Tweedie deviance takes the power that the model has."""
        if self.metric.startswith("MTD(") and params.get("power") is not None:
            return f"MTD({float(params['power']):g})"
        return self.metric


def _known(spec, params: dict):
    names = {f.name for f in fields(spec)}
    return replace(spec, **{k: v for k, v in params.items() if k in names})


def _mean(df: DataFrame, features: list[str], params: dict) -> MeanModel:
    row = df.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m")).first()
    return MeanModel(row["m"])


def _glm_kind(spec_of: Callable[[dict], GlmSpec], metric: str) -> ModelKind:
    def fit(df: DataFrame, features: list[str], params: dict) -> GlmModel:
        return GlmModel(fit_glm(df, features, "y", "w", spec_of(params)))

    def fit_all(df: DataFrame, features: dict, params: dict) -> dict:
        problems = {p: Problem(p, names, spec_of(params[p])) for p, names in features.items()}
        return {p: GlmModel(f) for p, f in fit_glms(df, problems, "y", "w").items()}

    return ModelKind(fit, metric, fit_all, spec_of)


def _glm(base: GlmSpec, metric: str) -> ModelKind:
    return _glm_kind(lambda params: _known(base, params), metric)


def _ridge(base: GlmSpec, metric: str) -> ModelKind:
    return _glm_kind(lambda params: _known(
        replace(base, floor_at_min=False), {**params, "l2": params.get("alpha", 1.0)}), metric)


def _elastic(family: str, metric: str) -> ModelKind:
    def spec_of(params: dict) -> GlmSpec:
        spec = elastic_net_spec(family, params.get("alpha", 0.5), params.get("reg_lambda", 1e-4))
        return _known(spec, {k: v for k, v in params.items()
                             if k in ("fit_intercept", "max_iter", "tol")})
    return _glm_kind(spec_of, metric)


def _boost_spec(loss: str, params: dict) -> BoostSpec:
    whole = {f.name: int(params[f.name]) for f in fields(BoostSpec)
             if f.name in params and params[f.name] is not None and f.name in (
                 "n_estimators", "max_depth", "num_leaves", "min_child_samples", "max_bin")}
    return _known(BoostSpec(loss=loss), {**params, **whole})


def _boost(loss: str) -> ModelKind:
    def val_of(df: DataFrame, params: dict) -> str | None:
        return "is_val" if "is_val" in df.columns and params.get("use_val", True) else None

    def fit(df: DataFrame, features: list[str], params: dict) -> BoostModel:
        return BoostModel(fit_booster(df, features, _boost_spec(loss, params), val=val_of(df, params)))

    def fit_all(df: DataFrame, features: dict, params: dict) -> dict:
        specs = {p: _boost_spec(loss, params[p]) for p in features}
        val = val_of(df, next(iter(params.values()), {}))
        return {p: BoostModel(m) for p, m in fit_boosters(df, features, specs, val=val).items()}

    metric = {"poisson": "MPD", "gamma": "MGD", "tweedie": "MTD(1.5)"}[loss]
    return ModelKind(fit, metric, fit_all)


MODELS: dict[str, ModelKind] = {
    "mean": ModelKind(_mean, "RMSE"),
    "gaussian_glm": _glm(GlmSpec("gaussian", "identity"), "RMSE"),
    "poisson_glm": _glm(GlmSpec("poisson", "log"), "MPD"),
    "gamma_glm": _glm(GlmSpec("gamma", "inverse"), "MGD"),
    "tweedie_glm": _glm(GlmSpec("tweedie", "log", 1.5), "CCGI"),
    "ridge_poisson_glm": _ridge(GlmSpec("poisson", "log"), "MPD"),
    "ridge_gamma_glm": _ridge(GlmSpec("gamma", "log"), "MGD"),
    "ridge_tweedie_glm": _ridge(GlmSpec("tweedie", "log", 1.5), "MTD(1.5)"),
    "elastic_poisson_glm": _elastic("poisson", "MPD"),
    "elastic_gamma_glm": _elastic("gamma", "MGD"),
    "boosted_poisson": _boost("poisson"),
    "boosted_gamma": _boost("gamma"),
    "boosted_tweedie": _boost("tweedie"),
}


def model_kind(name: str) -> ModelKind:
    """A registered name, or the path ``module:attribute`` of a :class:`ModelKind`."""
    return resolve(name, MODELS)
