"""Generalized linear models: all parts are fitted in the same passes and scored in one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_model, weighted_mean

MAX_ITER = 50
TOLERANCE = 1e-8
POWER = {"gaussian": 0.0, "poisson": 1.0, "gamma": 2.0}


@dataclass(frozen=True)
class GlmSpec:
    """A family (by variance power), a link and the penalty of one model.

    ``link`` is 'log', 'identity', 'inverse' or 'power' (``1 / (1 - power)``, the
    canonical one).  ``l1``/``l2`` multiply the L1 and half the squared L2 norm
    of the coefficients; the loss is half the weighted mean deviance.
    """

    family: str = "poisson"
    link: str = "log"
    power: float | None = None
    l1: float = 0.0
    l2: float = 0.0
    fit_intercept: bool = True
    intercept_scale: float | str = 1.0
    target_divisor: float | str = 1.0
    floor_at_min: bool | str = "auto"
    max_iter: int = MAX_ITER
    tol: float = TOLERANCE

    @property
    def variance_power(self) -> float:
        return float(self.power) if self.family == "tweedie" else POWER[self.family]

    @property
    def link_power(self) -> float:
        if self.link == "power":
            if self.variance_power == 1:
                raise ValueError("the power link needs a variance power other than 1")
            return 1.0 / (1.0 - self.variance_power)
        return {"log": 0.0, "identity": 1.0, "inverse": -1.0}[self.link]

    @property
    def floors(self) -> bool:
        return self.link == "inverse" if self.floor_at_min == "auto" else bool(self.floor_at_min)


@dataclass(frozen=True)
class GlmFit:
    features: list[str]
    coefficients: list[float]
    intercept: float
    link_power: float
    divisor: float = 1.0
    floor: float | None = None
    constant: float = 1.0
    iterations: int = 0
    loss: float = float("nan")

    def linear(self) -> Column:
        return _linear(self.features, self.coefficients, self.intercept)

    def predict(self) -> Column:
        mean = inverse_link(self.linear(), self.link_power) * self.divisor
        return mean if self.floor is None else F.greatest(mean, F.lit(self.floor))

    def importance(self) -> dict[str, float]:
        """Absolute coefficients; the constant is not a feature."""
        return {f: abs(c) for f, c in zip(self.features, self.coefficients)}

    def as_dict(self) -> dict:
        return asdict(self)


def _linear(features: list[str], coefficients: list[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for f, c in zip(features, coefficients):
        if c != 0.0:
            out = out + F.col(f"`{f}`").cast("double") * float(c)
    return out


def inverse_link(eta: Column, power: float) -> Column:
    if power == 0:
        return F.exp(eta)
    if power == 1:
        return eta
    return 1 / eta if power == -1 else F.pow(eta, F.lit(1 / power))


def _link_slope(mu: Column, power: float) -> Column:
    """Derivative of the link at the mean."""
    if power == 0:
        return 1 / mu
    return F.lit(1.0) if power == 1 else power * F.pow(mu, F.lit(power - 1))


def _quasi_loss(y: np.ndarray, mu: np.ndarray, power: float) -> np.ndarray:
    """Half the unit deviance without the terms that depend on ``y`` alone; zeros are fine."""
    if power == 0:
        return (y - mu) ** 2 / 2
    if power == 1:
        return mu - y * np.log(mu)
    if power == 2:
        return np.log(mu) + y / mu
    return mu ** (2 - power) / (2 - power) - y * mu ** (1 - power) / (1 - power)


# --- fitting --------------------------------------------------------------------------

@dataclass(frozen=True)
class Problem:
    """A model to fit on the rows of one part, from some of the features."""

    part: str
    features: list[str]
    spec: GlmSpec = GlmSpec()


@dataclass(frozen=True)
class _Trial:
    """What a task needs to sum one model's equations; ``coefs`` is None before the first step."""

    part: str
    columns: np.ndarray
    center: np.ndarray
    coefs: np.ndarray | None
    intercept: bool
    divisor: float
    mean: float
    power: float
    link: float

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Upper triangle of X'WX, the score, the loss and the rows outside the link's domain."""
        x = x[:, self.columns] - self.center
        if self.intercept:
            x = np.column_stack([np.ones(len(x)), x])
        y, p, q = y / self.divisor, self.power, self.link
        if self.coefs is None:
            mu = (y + self.mean) / 2
            eta = np.log(mu) if q == 0 else mu ** q
            outside = 0
        else:
            eta = x @ self.coefs
            inside = eta > 0 if q not in (0, 1) or (q == 1 and p != 0) else np.isfinite(eta)
            outside = len(eta) - np.count_nonzero(inside)
            eta = np.where(inside, eta, 1.0)
            mu = np.exp(eta) if q == 0 else eta ** (1 / q)
        slope = 1 / mu if q == 0 else q * mu ** (q - 1)
        weight = w / (mu ** p * slope ** 2)
        pull = weight * (y - mu) * slope
        if self.coefs is None:
            pull = pull + weight * eta
        hessian = x.T @ (x * weight[:, None])
        loss = (w * _quasi_loss(y, mu, p)).sum()
        return np.concatenate([hessian[np.triu_indices(x.shape[1])], x.T @ pull, [loss, outside]])


class _Fitting:
    """One model on the driver: where it stands and the step that the next pass tries.

    Features are centred if there is an intercept, so the equations stay well conditioned.
    """

    def __init__(self, name, problem: Problem, facts, columns: list[int]):
        if facts is None:
            raise ValueError(f"there are no rows to fit {name!r} on")
        if facts["broken"]:
            raise ValueError(f"{facts['broken']} rows of {name!r} hold a null or NaN")
        spec = self.spec = problem.spec
        self.problem, self.columns = problem, np.array(columns, dtype=int)
        self.divisor = facts["mean"] if spec.target_divisor == "mean" else float(spec.target_divisor)
        self.constant = facts["mean"] if spec.intercept_scale == "mean" else float(
            spec.intercept_scale)
        self.low, self.sum_w = facts["low"], facts["sw"]
        self.mean = mean = facts["wmean"] / self.divisor
        self.center = np.array([facts[f"m{i}"] if spec.fit_intercept else 0.0 for i in columns])
        self.size = len(columns) + spec.fit_intercept
        #: Intercepts are not penalised.
        self.penalised = np.ones(self.size)
        self.at, self.loss, self.trial = None, math.inf, None
        self.iterations, self.halvings, self.done = 0, 0, False
        if spec.fit_intercept:
            self.penalised[0] = 0.0
            q = spec.link_power
            self.trial = np.zeros(self.size)
            self.trial[0] = {0.0: math.log(mean) if mean > 0 else 0.0, 1.0: mean}.get(
                q, mean ** q if mean > 0 else 1.0)
            self.iterations = -1

    def told(self) -> _Trial:
        return _Trial(self.problem.part, self.columns, self.center, self.trial,
                      self.spec.fit_intercept, self.divisor, self.mean, self.spec.variance_power,
                      self.spec.link_power)

    def advance(self, sums: np.ndarray) -> None:
        """Accept, halve or end, from the sums of one pass."""
        k, upper = self.size, np.triu_indices(self.size)
        hessian = np.zeros((k, k))
        hessian[upper] = sums[:len(upper[0])]
        hessian = (hessian + np.triu(hessian, 1).T) / self.sum_w
        score = sums[len(upper[0]):-2] / self.sum_w
        if self.trial is None:
            self.trial = self._minimum(np.zeros(k), hessian, score)
            return
        slopes = self.trial * self.penalised
        value = (sums[-2] / self.sum_w + self.spec.l1 * np.abs(slopes).sum()
                 + self.spec.l2 / 2 * (slopes ** 2).sum())
        if sums[-1] or not np.isfinite(sums).all():
            value = math.inf
        slack = abs(self.loss) + 0.1
        if value > self.loss + 1e-12 * slack or (math.isinf(value) and self.at is not None):
            if self.halvings < 30:
                self.trial, self.halvings = (self.at + self.trial) / 2, self.halvings + 1
                return
            if not math.isinf(value):
                self.done = True
                return
        if math.isinf(value):
            raise ArithmeticError("the linear predictor left the domain of the link")
        self.at, self.loss, self.halvings = self.trial, value, 0
        self.iterations += 1
        self.trial = self._minimum(self.at, hessian, score)
        move = self.trial - self.at
        gain = move @ hessian @ move
        if gain <= max(self.spec.tol ** 2, 1e-20) * (abs(value) + 0.1):
            self.at, self.done = self.trial, True
        elif self.iterations >= self.spec.max_iter:
            self.done = True

    def _minimum(self, at: np.ndarray, hessian: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Where the penalised quadratic around ``at`` is least.

        Columns are brought to one scale.  Directions without information (a constant
        column, collinear columns) get the shortest solution.
        """
        a = hessian + self.spec.l2 * np.diag(self.penalised)
        target = hessian @ at + score
        size = np.sqrt(np.diag(a))
        scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
        a, target = a * np.outer(scale, scale), target * scale
        if self.spec.l1 == 0:
            return scale * (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ target)
        limit = self.spec.l1 * self.penalised * scale
        b = at * size
        rest = target - a @ b
        for _ in range(20_000):
            most = 0.0
            for j in np.flatnonzero(scale):
                free = rest[j] + b[j]
                new = math.copysign(max(abs(free) - limit[j], 0.0), free)
                if new != b[j]:
                    rest -= a[:, j] * (new - b[j])
                    most, b[j] = max(most, abs(new - b[j])), new
            if most <= 1e-13 * (1e-3 + np.abs(b).max()):
                break
        return scale * b

    def result(self) -> GlmFit:
        slopes = self.at[1:] if self.spec.fit_intercept else self.at
        intercept = self.at[0] - self.center @ slopes if self.spec.fit_intercept else 0.0
        return GlmFit(list(self.problem.features), [float(c) for c in slopes], float(intercept),
                      self.spec.link_power, self.divisor, self.low if self.spec.floors else None,
                      self.constant, self.iterations, float(self.loss))


def fit_glms(df: DataFrame, problems: dict, y: str, w: str | None = None,
             part: str | None = "part", failed: dict | None = None) -> dict:
    """Fit any number of models together; the keys of ``problems`` name the fits.

    Reweighted least squares.  A pass reads the rows once, whatever the number of parts and
    models: each task sums the normal equations, the loss and the rows outside the link's domain
    of every model that is not done yet, at the step that it tries; the sums are added by Spark
    and the driver solves them (models x features^2 numbers).  A step is halved while it leaves
    the domain or raises the penalised loss.  One more pass finds means and lowest targets, so
    pass a stage table.

    A null or NaN in a feature, target or weight and a part without rows are errors.
    Collinear features share their effect; a constant one gets 0.  With ``failed`` given, the
    error of a model goes there by key and the others are still fitted.
    """
    names = sorted({f for p in problems.values() for f in p.features})
    place = {f: i for i, f in enumerate(names)}
    rows = df.select(
        (F.lit("") if part is None else F.col(part).cast("string")).alias("part"),
        F.col(y).cast("double").alias("y"),
        (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"),
        *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(names)])
    rows = rows.where(F.col("part").isin(sorted({p.part for p in problems.values()})))
    broken = F.lit(False)
    for c in rows.columns[1:]:
        broken = broken | F.col(c).isNull() | F.isnan(c)
    facts = {r["part"]: r for r in rows.groupBy("part").agg(
        F.avg("y").alias("mean"), F.min("y").alias("low"), F.sum("w").alias("sw"),
        weighted_mean(F.col("y"), F.col("w")).alias("wmean"),
        F.count_if(broken).alias("broken"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))]).collect()}
    fits: dict = {}

    def attempt(key, step) -> None:
        try:
            step()
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as why:
            if failed is None:
                raise
            failed[key] = why
            fits.pop(key, None)

    for k, p in problems.items():
        attempt(k, lambda: fits.update({k: _Fitting(
            k, p, facts.get(p.part), [place[f] for f in p.features])}))
    while todo := [k for k, f in fits.items() if not f.done]:
        for k, sums in zip(todo, _pass(rows, [fits[k].told() for k in todo])):
            attempt(k, lambda: fits[k].advance(sums))
    return {k: f.result() for k, f in fits.items()}


def _pass(rows: DataFrame, trials: list[_Trial]) -> list[np.ndarray]:
    """The sums of every trial, from one scan."""
    mine: dict[str, list[int]] = {}
    for i, t in enumerate(trials):
        mine.setdefault(t.part, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                code = batch.column(0).dictionary_encode()
                values = np.column_stack([c.to_numpy(zero_copy_only=False)
                                          for c in batch.columns[1:]])
                at = code.indices.to_numpy(zero_copy_only=False)
                for i, part in enumerate(code.dictionary.to_pylist()):
                    own = values[at == i]
                    for t in mine[part]:
                        sums = trials[t].sums(own[:, 2:], own[:, 0], own[:, 1])
                        total[t] = total[t] + sums if t in total else sums
        for t, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), t, dtype=np.int32)),
                 pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                names=["trial", "slot", "value"])

    needed = rows.where(F.col("part").isin(list(mine)))
    found = needed.mapInArrow(run, "trial int, slot int, value double").groupBy(
        "trial", "slot").agg(F.sum("value").alias("value")).toArrow()
    trial, slot, value = (found.column(c).to_numpy() for c in ("trial", "slot", "value"))
    out = []
    for t in range(len(trials)):
        sums = np.zeros(np.count_nonzero(trial == t))
        sums[slot[trial == t]] = value[trial == t]
        out.append(sums)
    return out


def fit_glm(df: DataFrame, features: list[str], y: str, w: str | None = None,
            spec: GlmSpec = GlmSpec()) -> GlmFit:
    """One model on all rows of ``df``."""
    return fit_glms(df, {"": Problem("", features, spec)}, y, w, part=None)[""]


def _residuals(row, fit: GlmFit, spec: GlmSpec, place: dict[str, int]) -> dict[str, float]:
    penalised = dict(zip(fit.features, fit.coefficients))
    out = {}
    for name in [*fit.features, *(["(constant)"] if spec.fit_intercept else [])]:
        slope, size = (row[f"{c}{place[name]}"] / row["sw"] for c in "st")
        coef = penalised.get(name, 0.0)
        l1 = spec.l1 if name in penalised else 0.0
        slope += spec.l2 * coef if name in penalised else 0.0
        left = abs(slope + math.copysign(l1, coef)) if coef else max(0.0, abs(slope) - l1)
        out[name] = left / size if size else left
    return out


def elastic_net_spec(family: str, alpha: float, reg_lambda: float, **kw) -> GlmSpec:
    """``alpha`` is the L1 share of the penalty ``reg_lambda``."""
    kw.setdefault("floor_at_min", False)
    return GlmSpec(family, "log", l1=alpha * reg_lambda, l2=(1 - alpha) * reg_lambda, **kw)


@dataclass(frozen=True)
class PartModels:
    """One fitted GLM per part."""

    fits: dict[str, GlmFit] = field(default_factory=dict)

    def coefficients(self, spark) -> DataFrame:
        rows = [(p, name, float(c)) for p, f in self.fits.items()
                for name, c in [("(constant)", f.intercept / (f.constant or 1.0)),
                                *zip(f.features, f.coefficients)]]
        return spark.createDataFrame(rows, "part string, feature string, coefficient double")

    def importance(self, spark) -> DataFrame:
        rows = [(p, k, float(v)) for p, f in self.fits.items() for k, v in f.importance().items()]
        return spark.createDataFrame(rows, "part string, feature string, importance double")

    def score_residuals(self, df: DataFrame, spec: GlmSpec, y: str, w: str | None = None
                        ) -> DataFrame:
        """What is left of the optimality condition of each part's coefficients, 0 at the optimum.

        The slope of the penalised loss (with an L1 part, its distance from 0 over all
        subgradients), relative to the mean size of the terms that it sums.  One scan.
        """
        names = ["(constant)", *sorted({f for fit in self.fits.values() for f in fit.features})]
        place = {f: i for i, f in enumerate(names)}
        mu, divisor = F.lit(None).cast("double"), F.lit(1.0)
        for part, fit in self.fits.items():
            hit = F.col("part") == part
            mu = F.when(hit, inverse_link(fit.linear(), fit.link_power)).otherwise(mu)
            divisor = F.when(hit, F.lit(float(fit.divisor))).otherwise(divisor)
        wt = F.col(w).cast("double") if w else F.lit(1.0)
        rows = df.where(F.col("part").isin(list(self.fits))).select(
            "part", wt.alias("w"), (F.col(y).cast("double") / divisor).alias("y"), mu.alias("mu"),
            *[(F.col(f"`{f}`").cast("double") if i else F.lit(1.0)).alias(f"x{i}")
              for i, f in enumerate(names)])
        mu = F.col("mu")
        term = F.col("w") * (mu - F.col("y")) / (
            F.pow(mu, F.lit(spec.variance_power)) * _link_slope(mu, spec.link_power))
        table = rows.withColumn("term", term).groupBy("part").agg(
            F.sum("w").alias("sw"), *[s for i in range(len(names)) for s in (
                F.sum(F.col("term") * F.col(f"x{i}")).alias(f"s{i}"),
                F.sum(F.abs(F.col("term") * F.col(f"x{i}"))).alias(f"t{i}"))])
        left = [(r["part"], f, float(v)) for r in table.collect()
                for f, v in _residuals(r, self.fits[r["part"]], spec, place).items()]
        return df.sparkSession.createDataFrame(left, "part string, feature string, residual double")

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Scores of all parts as one expression; parts may use different features."""
        pred = None
        for part, fit in self.fits.items():
            hit = F.col("part") == part
            pred = F.when(hit, fit.predict()) if pred is None else pred.when(hit, fit.predict())
        return df.withColumn(out, no_model() if pred is None else pred.otherwise(no_model()))


def for_parts(parts: list[str], job, threads: int = 8) -> dict:
    """Run one driver job per part side by side; Spark schedules their tasks."""
    with ThreadPoolExecutor(max_workers=min(threads, len(parts))) as pool:
        return dict(zip(parts, pool.map(job, parts)))


def fit_parts(df: DataFrame, parts: list[str], features: list[str], y: str, w: str | None,
              spec: GlmSpec) -> PartModels:
    return PartModels(fit_glms(df, {p: Problem(p, features, spec) for p in parts}, y, w))


def mean_predictor(df: DataFrame, by: list[str], y: str, w: str | None = None) -> DataFrame:
    """The (weighted) mean target of each part."""
    value = F.avg(y) if w is None else weighted_mean(F.col(y), F.col(w))
    return df.groupBy(*by).agg(value.alias("pred"))
