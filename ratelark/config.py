"""Job settings as plain dataclasses; every rule is checked before a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Target(str, Enum):
    CLAIMS_NUMBER = "claims_number"
    FREQUENCY = "frequency"
    TOTAL_AMOUNT = "total_amount"
    SEVERITY = "severity"
    PURE_PREMIUM = "pure_premium"


class OutlierPolicy(str, Enum):
    KEEP = "keep"
    DROP = "drop"
    CLIP = "clip"


class Weighting(str, Enum):
    EXPOSURE = "exposure"
    CLAIM_COUNT = "claim_count"
    ONE = "one"


# Column names every stage table uses.
POLICY_ID, CLAIM_NB, CLAIM_AMOUNT, EXPOSURE = "IDpol", "ClaimNb", "ClaimAmount", "Exposure"
CLAIM_WEIGHT = "ClaimCountWeight"
TARGET_COLUMN = {
    Target.CLAIMS_NUMBER: "ClaimNb_TRG",
    Target.FREQUENCY: "ClaimFreq_TRG",
    Target.TOTAL_AMOUNT: "ClaimTotalAmount_TRG",
    Target.SEVERITY: "ClaimSeverity_TRG",
    Target.PURE_PREMIUM: "ClaimPurePremium_TRG",
}
TARGET_SIDE_COLUMNS = [EXPOSURE, CLAIM_WEIGHT, *TARGET_COLUMN.values()]
MAX_CLAIM_NB = 4
GROUP_BINS = [10, 20, 30, 50, 100]
TWEEDIE_POWERS = [1.2, 1.5, 1.7, 1.9]


def task_weighting(target: Target, weighted: bool = True) -> Weighting:
    """Severity is weighted by claim count, every other target by exposure."""
    if not weighted:
        return Weighting.ONE
    return Weighting.CLAIM_COUNT if target is Target.SEVERITY else Weighting.EXPOSURE


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Outliers:
    policy: OutlierPolicy = OutlierPolicy.KEEP
    lower: float | None = None
    upper: float | None = None

    def __post_init__(self):
        if self.lower is not None and self.upper is not None:
            _require(self.lower < self.upper, "the lower bound must be below the upper bound")


@dataclass(frozen=True)
class Split:
    cv_folds: int | None = None
    test_size: float = 0.2
    calib_size: float = 0.2
    calib_enabled: bool = True
    shared_train_calib: bool = False
    stratify_column: str | None = None
    seed: int = 0

    def __post_init__(self):
        if self.cv_folds is not None:
            _require(self.cv_folds > 1, "cross-validation needs at least two folds")
            return
        _require(0 < self.test_size < 1, "test_size must lie in (0, 1)")
        if self.calib_enabled and not self.shared_train_calib:
            _require(0 < self.calib_size < 1, "calib_size must lie in (0, 1)")
            _require(self.test_size + self.calib_size < 1,
                     "test_size and calib_size must sum below 1")


@dataclass(frozen=True)
class Sampling:
    n_obs: int | None = None
    target_ratio: float | None = None
    allow_lower_ratio: bool = False
    calib_in_sample: bool = False
    validation: str = "none"          # none | calib_set | split_train_val
    val_size: float = 0.2
    seed: int = 0

    def __post_init__(self):
        _require(self.validation in ("none", "calib_set", "split_train_val"),
                 f"unknown validation scheme {self.validation!r}")
        if self.target_ratio is not None:
            _require(0 < self.target_ratio <= 1, "target_ratio must lie in (0, 1]")
        if self.validation == "split_train_val":
            _require(0 < self.val_size < 1, "val_size must lie in (0, 1)")


@dataclass(frozen=True)
class Features:
    custom: tuple[str, ...] = ()
    numeric_imputer: str | None = "median"
    numeric_fill: float = 0.0
    categorical_imputer: str | None = "most_frequent"
    categorical_fill: str = "missing"
    scaler: str | None = None
    reduce_categories: bool = False
    max_categories: int | None = None
    min_frequency: int | None = None
    join_exceeding: str | None = None
    join_infrequent: str | None = None
    one_hot: bool = True
    drop_reference: bool = False
    reference_categories: dict[str, str] = field(default_factory=dict)
    drop_first: bool = False
    drop_binary: bool = False
    ohe_max_categories: int | None = None
    ohe_min_frequency: int | None = None
    blacklist: tuple[str, ...] = ()
    polynomial_degree: int | None = None
    interaction_only: bool = False
    include_bias: bool = False
    pca: float | int | None = None


@dataclass(frozen=True)
class Tuning:
    enabled: bool = False
    max_evals: int = 50
    validation: str = "sample_val_set"     # sample_val_set | cross_validation | repeated_split
    folds: int = 5
    val_size: float = 0.2
    overfit_penalty: float = 0.0
    metric: str | None = None
    seed: int = 0
    stop_after: int | None = None
    percent_increase: float = 0.0

    def __post_init__(self):
        _require(self.validation in ("sample_val_set", "cross_validation", "repeated_split"),
                 f"unknown tuning validation {self.validation!r}")
        if self.validation != "sample_val_set":
            _require(self.folds > 1, "tuning needs at least two folds")


@dataclass(frozen=True)
class Calibration:
    enabled: bool = True
    model: str = "pure"
    params: dict = field(default_factory=dict)
    rebalance: str | None = None           # scale | shift
    outliers: Outliers = Outliers()

    def __post_init__(self):
        _require(self.rebalance in (None, "scale", "shift"),
                 f"unknown rebalancing method {self.rebalance!r}")


@dataclass(frozen=True)
class Job:
    """All settings of one modelling run."""

    target: Target = Target.FREQUENCY
    weighted: bool = True
    split: Split = Split()
    sampling: Sampling = Sampling()
    sample_outliers: Outliers = Outliers()
    test_outliers: Outliers = Outliers()
    features: Features = Features()
    target_transform: tuple[str, dict] | None = None
    selector: tuple[str, dict] | None = None
    model: str = "poisson_glm"
    hparams: dict = field(default_factory=dict)
    tuning: Tuning = Tuning()
    calibration: Calibration = Calibration()
    run_id: str = "run"

    def __post_init__(self):
        has_calib = self.split.calib_enabled
        if self.calibration.enabled:
            _require(has_calib, "calibration needs a calibration set")
        if self.split.shared_train_calib:
            _require(has_calib, "a shared calibration set must be enabled")
            _require(not self.sampling.calib_in_sample,
                     "a calibration set shared with train is already part of the sample")
        if self.sampling.validation == "calib_set" or self.sampling.calib_in_sample:
            _require(has_calib, "the sample refers to a calibration set that does not exist")
        if self.tuning.enabled and self.tuning.validation == "sample_val_set":
            _require(self.sampling.validation != "none",
                     "tuning on the given split needs a validation set in the sample")

    @property
    def weighting(self) -> Weighting:
        return task_weighting(self.target, self.weighted)

    @property
    def target_column(self) -> str:
        return TARGET_COLUMN[self.target]
